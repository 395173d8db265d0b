"""Matrices in long form (i, j, v), and the quadratic estimator on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Order of the dense blocks that products over a long inner side are taken in.
BLOCK = 256
#: Order of the tiles of a product, the longest inner side of a strip, and bytes of a factor's strips that are broadcast.
TILE, WIDE, BROADCAST = 1024, 2048, 1 << 26
#: Tiles that one task makes at most, and the fewest tasks.
TASK_TILES, TASKS = 16, 24


class Tile(NamedTuple):
    """Rows from r * size, columns from c * size: the values of each part, 0 where there is no entry, and where there is one."""

    r: int
    c: int
    parts: dict[int, np.ndarray]
    there: np.ndarray


class Tiles:
    """One matrix or several (parts 0, 1, ...) in dense tiles, which a task makes and uses in one go: no tile is shuffled or written.

    source: a row for each tile, with its place (r, c); load: a Tile of such a row.
    """

    def __init__(self, source: DataFrame, load: Callable[[dict], Tile], size: int):
        self.source, self.load, self.size = source, load, size

    def split(self, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Tiles:
        """The matrices f(v, same), where there are entries; same: 1 on the diagonal, else 0."""
        load = self.load

        def parts(row: dict) -> Tile:
            t = load(row)
            got = f(t.parts[0], np.eye(*t.there.shape) if t.r == t.c else np.zeros((1, 1)))
            return t._replace(parts={m: v if t.there.all() else np.where(t.there, v, 0.0) for m, v in enumerate(got)})

        return Tiles(self.source, parts, self.size)

    def diagonal(self) -> Tiles:
        """The tiles on the diagonal."""
        return Tiles(self.source.where("r = c"), self.load, self.size)

    def beside(self, name: str, x: DataFrame) -> Tiles:
        """With the numbers x (i, x) of each tile's rows and columns, as columns of the source."""
        blocks = x.groupBy(F.floor(F.col("i") / self.size).alias("at")).agg(F.collect_list(F.struct((F.col("i") % self.size).cast("int").alias("i"), F.col("x").cast("double").alias("x"))).alias("e"))
        source = self.source
        for side in "rc":
            own = blocks.select(F.col("at").alias(side), F.col("e.i").alias(f"{name}_{side}_i"), F.col("e.x").alias(f"{name}_{side}_x"))
            source = source.join(F.broadcast(own), side, "left")
        return Tiles(source, self.load, self.size)

    def run(self, of: Callable[[Iterator[tuple[Tile, dict]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """of(tiles with their rows of the source) in each task."""
        load = self.load

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tile, dict]]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
                    yield load(row), row

        return self.source.mapInArrow(lambda batches: of(each(batches)), schema)

    def entries(self) -> DataFrame:
        """(i, j, v) of the first part."""
        size = self.size

        def out(tiles: Iterator[tuple[Tile, dict]]) -> Iterator[pa.RecordBatch]:
            for t, _ in tiles:
                yield from _listed(t.r * size, t.c * size, t.parts[0], t.there)

        return self.run(out, "i long, j long, v double")


def _listed(i0: int, j0: int, values: np.ndarray, there: np.ndarray, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(values), rows):
        i, j = np.nonzero(there[at : at + rows])
        if len(i):
            yield pa.record_batch([pa.array(i + (i0 + at)), pa.array(j + j0), pa.array(values[at : at + rows][i, j])], names=["i", "j", "v"])


def _side(row: dict, name: str, side: str, n: int) -> np.ndarray:
    """What beside() put there, 0 where it has no number."""
    out = np.zeros(n)
    i, x = row[f"{name}_{side}_i"], row[f"{name}_{side}_x"]
    if i.is_valid:
        i, x = (v.values.to_numpy(zero_copy_only=False) for v in (i, x))
        out[i[i < n]] = x[i < n]
    return out


def extent(df: DataFrame, *names: str) -> list[int]:
    """One more than the largest of each column (0: no rows)."""
    return [0 if x is None else int(x) + 1 for x in df.agg(*(F.max(c) for c in names)).first()]


def _strips(df: DataFrame, row: str, inner: str, size: int, wide: int) -> DataFrame:
    """(s, data, there): `size` rows of an (i, j, v) matrix each, dense, `wide` numbers a row; there is null if all are."""
    cell = F.struct((F.col(row) % size).cast("int").alias("i"), F.col(inner).cast("int").alias("k"), F.col("v").cast("double").alias("v"))
    each = df.where(F.col(inner) < wide).groupBy(F.floor(F.col(row) / size).alias("s")).agg(F.collect_list(cell).alias("e"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, k, v = (batch.column(x)[at].values.to_numpy(zero_copy_only=False) for x in (1, 2, 3))
                values, there = np.zeros((int(i.max()) + 1, wide)), np.zeros((int(i.max()) + 1, wide), bool)
                np.add.at(values, (i, k), v)
                there[i, k] = True
                mask = None if there.all() else np.packbits(there).tobytes()
                yield pa.record_batch([batch.column(0).slice(at, 1), pa.array([values.tobytes()], pa.binary()), pa.array([mask], pa.binary())], names=["s", "data", "there"])

    return each.select("s", F.col("e.i").alias("i"), F.col("e.k").alias("k"), F.col("e.v").alias("v")).mapInArrow(dense, "s long, data binary, there binary")


def product(a: DataFrame, b: DataFrame, left: str = "N", right: str = "N", size: int = TILE, upper: bool = False, shape: tuple[int, int, int] | None = None) -> Tiles:
    """Product of two (i, j, v) matrices of which the inner side is short enough for whole strips; upper: only i <= j.

    Each tile comes from one strip of rows and one of columns, so partial
    products need no sum.  shape: rows, inner side and columns; by default they are looked up.
    """
    ai, ak = ("i", "j") if left == "N" else ("j", "i")
    bk, bj = ("i", "j") if right == "N" else ("j", "i")
    if shape is None:
        (n, wide), (most, m) = extent(a, ai, ak), extent(b, bk, bj)
        shape = n, min(wide, most), m
    n, wide, m = shape
    spark, rows, cols = a.sparkSession, -(-n // size), -(-m // size)
    many = rows * (rows + 1) // 2 if upper else rows * cols
    if upper:
        j = F.floor((F.sqrt(8.0 * F.col("id") + 1) - 1) / 2)
        j = F.when(j * (j + 1) / 2 > F.col("id"), j - 1).when((j + 1) * (j + 2) / 2 <= F.col("id"), j + 1).otherwise(j)
        place = [(F.col("id") - (j * (j + 1) / 2).cast("long")).alias("r"), j.cast("long").alias("c")]
    else:
        place = [F.floor(F.col("id") / max(1, cols)).alias("r"), (F.col("id") % max(1, cols)).alias("c")]
    places = spark.range(0, many, 1, max(min(TASKS, many), -(-many // TASK_TILES), 1)).select(*place)
    held = lambda x, length: F.broadcast(x) if 8 * wide * length <= BROADCAST else x
    p = held(_strips(a, ai, ak, size, wide), n).select(F.col("s").alias("r"), F.col("data").alias("p"), F.col("there").alias("p_there"))
    q = held(_strips(b, bj, bk, size, wide), m).select(F.col("s").alias("c"), F.col("data").alias("q"), F.col("there").alias("q_there"))

    def load(row: dict) -> Tile:
        r, c = row["r"].as_py(), row["c"].as_py()
        x, u = (np.frombuffer(row[k].as_buffer()).reshape(-1, wide) for k in "pq")
        v, there = x @ u.T, np.ones((len(x), len(u)), bool)
        if row["p_there"].is_valid or row["q_there"].is_valid:
            y, w = (np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=z.size).reshape(z.shape).astype(np.float32) if m.is_valid else np.ones(z.shape, np.float32) for m, z in ((row["p_there"], x), (row["q_there"], u)))
            there = y @ w.T > 0
        if upper and r == c:
            v, there = np.triu(v), np.triu(there)
        return Tile(r, c, {0: v}, there)

    return Tiles(places.join(p, "r").join(q, "c"), load, size)


def multiply(a: DataFrame, b: DataFrame, left: str = "N", right: str = "N", size: int | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Product of two (i, j, v) matrices; left and right: 'T' takes the transpose.

    A product exists where a pair of entries does.  With an inner side of up to
    WIDE it is made tile by tile and nothing of it is shuffled (see product);
    beyond that by blocks, whose partial products are summed.
    """
    ai, ak = ("i", "j") if left == "N" else ("j", "i")
    bk, bj = ("i", "j") if right == "N" else ("j", "i")
    if shape is None:
        (n, wide), (most, m) = extent(a, ai, ak), extent(b, bk, bj)
        shape = n, min(wide, most), m
    if shape[1] <= WIDE:
        return product(a, b, left, right, size or TILE, shape=shape).entries()
    return _by_blocks(a, b, (ai, ak), (bk, bj), size or BLOCK)


def _blocks(df: DataFrame, row: str, col: str, value: str, size: int) -> DataFrame:
    """(r, c, i, j, v): the entries of each block of order `size`, as arrays; a block's rows never leave one task once combined."""
    place = lambda x: F.floor(F.col(x) / size)
    cell = F.struct((F.col(row) % size).cast("int").alias("i"), (F.col(col) % size).cast("int").alias("j"), F.col(value).cast("double").alias("v"))
    each = df.groupBy(place(row).alias("r"), place(col).alias("c")).agg(F.collect_list(cell).alias("e"))
    return each.select("r", "c", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.v").alias("v"))


def _dense(i, j, v, size: int) -> tuple[np.ndarray, np.ndarray]:
    values, there = np.zeros((size, size)), np.zeros((size, size), np.float32)
    np.add.at(values, (i, j), v)
    there[i, j] = 1
    return values, there


def _by_blocks(a: DataFrame, b: DataFrame, a_names: tuple[str, str], b_names: tuple[str, str], size: int) -> DataFrame:
    """Entries meet by blocks of order `size`, so the join has a row for each pair of blocks and not for each product."""
    (ai, ak), (bk, bj) = a_names, b_names
    p = _blocks(a, ai, ak, "v", size).select("r", F.col("c").alias("k"), *(F.col(x).alias(f"a{x}") for x in "ijv"))
    q = _blocks(b, bk, bj, "v", size).select(F.col("r").alias("k"), "c", *(F.col(x).alias(f"b{x}") for x in "ijv"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r, c, *e = (batch.column(k)[at] for k in range(8))
                e = [x.values.to_numpy(zero_copy_only=False) for x in e]
                (x, y), (u, w) = _dense(*e[:3], size), _dense(*e[3:], size)
                out, there = x @ u, y @ w > 0
                yield pa.record_batch([pa.array([r.as_py()]), pa.array([c.as_py()]), pa.array([out.tobytes()], pa.binary()), pa.array([np.packbits(there).tobytes()], pa.binary())], names=["r", "c", "v", "there"])

    def total(group: pa.Table) -> pa.Table:
        r, c = group.column("r")[0].as_py(), group.column("c")[0].as_py()
        out, there = np.zeros((size, size)), np.zeros((size, size), bool)
        for v, t in zip(group.column("v").to_pylist(), group.column("there").to_pylist(), strict=True):
            out += np.frombuffer(v).reshape(size, size)
            there |= np.unpackbits(np.frombuffer(t, np.uint8), count=size * size).reshape(size, size) > 0
        i, j = np.nonzero(there)
        return pa.table([pa.array(i + r * size), pa.array(j + c * size), pa.array(out[i, j])], names=["i", "j", "v"])

    both = p.join(q, "k").select("r", "c", "ai", "aj", "av", "bi", "bj", "bv")
    parts = both.mapInArrow(products, "r long, c long, v binary, there binary")
    return parts.groupBy("r", "c").applyInArrow(total, "i long, j long, v double")


def apply_to(a: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix (i, j, v) times vector (j, x): (i, y)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def project_tiles(modes: DataFrame, s: DataFrame, size: int = TILE) -> Tiles | None:
    """Upper triangle of B S B^T for modes (i, a, v) and a cell matrix (i, j, v), in tiles; None if the cells are too many for strips."""
    n, cells = extent(modes, "i", "a")
    if cells > WIDE:
        return None
    b = modes.select("i", F.col("a").alias("j"), "v")
    wide = max(cells, extent(s, "j")[0])
    if wide > WIDE:
        return None
    return product(multiply(b, s, shape=(n, cells, wide)), b, right="T", size=size, upper=True, shape=(n, cells, n))


def project(modes: DataFrame, s: DataFrame) -> DataFrame:
    """Upper triangle of B S B^T for modes (i, a, v) and a cell matrix (i, j, v)."""
    tiles = project_tiles(modes, s)
    if tiles is not None:
        return tiles.entries()
    b = modes.select("i", F.col("a").alias("j"), "v")
    return multiply(multiply(b, s), b, right="T").where("i <= j")


def packed(i: Column, j: Column) -> Column:
    """Place of (i, j), i <= j, in a packed upper triangle."""
    return (j * (j + 1) / 2 + i).cast("long")


def unpack(k: Column) -> tuple[Column, Column]:
    """(i, j) of a place in a packed upper triangle."""
    j = F.floor((F.sqrt(8.0 * k + 1) - 1) / 2)
    j = F.when(j * (j + 1) / 2 > k, j - 1).when((j + 1) * (j + 2) / 2 <= k, j + 1).otherwise(j)
    return (k - (j * (j + 1) / 2).cast("long")), j


def trace(a: DataFrame) -> DataFrame:
    return a.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("trace"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"), F.sum("v").alias("total"))


def gathered(derivs: DataFrame, size: int = 256) -> Tiles:
    """Tiles of packed derivatives (m, i, j, v), each read from one shuffle of the rows."""
    cell = F.struct(F.col("m").cast("int").alias("m"), (F.col("i") % size).cast("int").alias("i"), (F.col("j") % size).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    place = lambda x: F.floor(F.col(x) / size)
    each = derivs.groupBy(place("i").alias("r"), place("j").alias("c")).agg(F.collect_list(cell).alias("e"))

    def load(row: dict) -> Tile:
        m, i, j, v = (row[x].values.to_numpy(zero_copy_only=False) for x in "mijv")
        there = np.zeros((size, size), bool)
        there[i, j] = True
        parts = {int(k): np.zeros((size, size)) for k in np.unique(m)}
        for k, values in parts.items():
            np.add.at(values, (i[m == k], j[m == k]), v[m == k])
        return Tile(row["r"].as_py(), row["c"].as_py(), parts, there)

    return Tiles(each.select("r", "c", *(F.col(f"e.{x}").alias(x) for x in "mijv")), load, size)


def _numbers(params: DataFrame) -> dict[int, float]:
    got = params.select("m", "p").toArrow()
    return dict(zip(got.column("m").to_pylist(), got.column("p").to_pylist(), strict=True))


def residual(evals: DataFrame, derivs: DataFrame | Tiles, params: DataFrame) -> DataFrame:
    """(i, j, v) of R = C - sum_p p D_p, with C = diag(1 + lambda) and packed derivatives (m, i, j, v) or tiles of them."""
    c = evals.select(F.col("i"), F.col("i").alias("j"), (1 + F.col("lambda")).alias("v"))
    if isinstance(derivs, Tiles):
        size, p = derivs.size, _numbers(params)

        def out(tiles: Iterator[tuple[Tile, dict]]) -> Iterator[pa.RecordBatch]:
            for t, row in tiles:
                v = _rest(t, p, _side(row, "c", "r", t.there.shape[0]))
                yield from _listed(t.r * size, t.c * size, v, t.there)

        rows = derivs.beside("c", c.select("i", F.col("v").alias("x"))).run(out, "i long, j long, v double")
        return rows.unionByName(c.join(derivs.diagonal().entries().where("i = j").select("i"), "i", "left_anti").select("i", "j", "v"))
    d = derivs.join(params, "m").select("i", "j", (-F.col("p") * F.col("v")).alias("v"))
    return c.unionByName(d).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _rest(t: Tile, p: dict[int, float], c: np.ndarray) -> np.ndarray:
    v = np.zeros(t.there.shape)
    for m, d in t.parts.items():
        if m in p:
            v -= p[m] * d
    if t.r == t.c:
        k = np.arange(min(v.shape))
        v[k, k] += c[: len(k)]
    return v


def _sums(derivs: DataFrame | Tiles, evals: DataFrame, fisher: bool = False, y: DataFrame | None = None, params: DataFrame | None = None) -> DataFrame:
    """(kind, m, n, v): the Fisher matrix (0), with y the quadratic estimates (1), with params the bias by the residual (2), from one pass over the derivatives."""
    tiles = (derivs if isinstance(derivs, Tiles) else gathered(derivs)).beside("c", evals.select("i", (1 + F.col("lambda")).alias("x")))
    tiles = tiles if y is None else tiles.beside("y", y.select("i", F.col("y").alias("x")))
    p, with_y = None if params is None else _numbers(params), y is not None

    def out(each: Iterator[tuple[Tile, dict]]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], float] = {}
        for t, row in each:
            h, w = t.there.shape
            c = _side(row, "c", "r", h), _side(row, "c", "c", w)
            by_row, by_col = (np.divide(1.0, x, out=np.zeros(len(x)), where=x != 0) for x in c)
            rest = None if p is None else _rest(t, p, c[0]).ravel()
            for m, d in t.parts.items():
                u = d * by_row[:, None] * by_col
                if t.r == t.c:
                    k = np.arange(min(h, w))
                    u[k, k] /= 2
                found = {(0, m, n): u.ravel() @ e.ravel() for n, e in t.parts.items()} if fisher else {}
                if with_y:
                    found[1, m, 0] = _side(row, "y", "r", h) @ u @ _side(row, "y", "c", w)
                if rest is not None:
                    found[2, m, 0] = u.ravel() @ rest
                for key, v in found.items():
                    sums[key] = sums.get(key, 0.0) + float(v)
        if sums:
            yield pa.record_batch([*(pa.array([key[k] for key in sums], pa.int64()) for k in range(3)), pa.array(list(sums.values()))], names=["kind", "m", "n", "v"])

    return tiles.run(out, "kind long, m long, n long, v double").groupBy("kind", "m", "n").agg(F.sum("v").alias("v"))


def fisher(derivs: DataFrame | Tiles, evals: DataFrame) -> DataFrame:
    """(m, n, f): F_mn = Tr[C^-1 D_m C^-1 D_n] / 2 from packed derivatives (m, i, j, v) or tiles of them."""
    return _sums(derivs, evals, fisher=True).select("m", "n", F.col("v").alias("f"))


def whitened(derivs: DataFrame, evals: DataFrame) -> DataFrame:
    """(m, i, j, v, u): u = v / (C_i C_j)."""
    c = evals.select("i", (1 + F.col("lambda")).alias("c"))
    other = c.select(F.col("i").alias("j"), F.col("c").alias("e"))
    return derivs.join(c, "i").join(other, "j").withColumn("u", F.col("v") / (F.col("c") * F.col("e"))).drop("c", "e")


def _weight() -> Column:
    return F.when(F.col("i") == F.col("j"), 0.5).otherwise(1.0)


def bias(derivs: DataFrame, evals: DataFrame, rest: DataFrame) -> DataFrame:
    """(m, b): Tr[C^-1 D_m C^-1 R] / 2 for any packed matrix R (i, j, v)."""
    r = rest.select("i", "j", F.col("v").alias("w"))
    return whitened(derivs, evals).join(r, ["i", "j"]).groupBy("m").agg(F.sum(_weight() * F.col("u") * F.col("w")).alias("b"))


def bias_of_residual(derivs: DataFrame | Tiles, evals: DataFrame, params: DataFrame) -> DataFrame:
    """(m, b): the bias for R = residual(evals, derivs, params), which is not written down."""
    return _sums(derivs, evals, params=params).select("m", F.col("v").alias("b"))


def quadratic(derivs: DataFrame | Tiles, evals: DataFrame, y: DataFrame) -> DataFrame:
    """(m, q): y^T C^-1 D_m C^-1 y / 2."""
    return _sums(derivs, evals, y=y).select("m", F.col("v").alias("q"))


def parameters(derivs: DataFrame | Tiles, evals: DataFrame, y: DataFrame, params: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fisher matrix, quadratic estimates and bias by the residual of n parameters, on the driver, from one pass over the derivatives."""
    if n * n > DRIVER_ENTRIES:
        raise ValueError(f"a table of order {n} is too large for the driver")
    got = _sums(derivs, evals, fisher=True, y=y, params=params).toArrow()
    kind, m, k, v = (got.column(x).to_numpy() for x in ("kind", "m", "n", "v"))
    f, q, b = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    f[m[kind == 0], k[kind == 0]], q[m[kind == 1]], b[m[kind == 2]] = v[kind == 0], v[kind == 1], v[kind == 2]
    return f, q, b


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(a)


def square_root(a: np.ndarray) -> np.ndarray:
    """Symmetric square root of a symmetric matrix without negative eigenvalues."""
    w, v = np.linalg.eigh(a)
    return (v * np.sqrt(np.clip(w, 0, None))) @ v.T


def mixing(f: np.ndarray, kind: str = "inverse") -> np.ndarray:
    """M of kind 'inverse', 'root' or 'identity', its rows scaled so that those of W = M F sum to 1."""
    m = {"inverse": lambda: inverse(f), "root": lambda: inverse(square_root(f)), "identity": lambda: np.eye(len(f))}[kind]()
    return m / (m @ f).sum(axis=1, keepdims=True)


def estimate(f: np.ndarray, q: np.ndarray, b: np.ndarray, kind: str = "inverse") -> dict[str, np.ndarray]:
    """Band powers and their covariance, window and mixing matrices; all of the size of the parameters."""
    m = mixing(f, kind)
    return {"phat": m @ (q - b), "cov": m @ f @ m.T, "fisher": f, "window": m @ f, "mixing": m, "q": q, "bias": b}


#: Entries that `small` brings to the driver at most (16 to 24 bytes each).
DRIVER_ENTRIES = 1_000_000


def small(df: DataFrame, n: int, *names: str) -> np.ndarray:
    """An n or n x n table of parameters, of DRIVER_ENTRIES at most, as an array on the driver, in Arrow columns."""
    *at, v = names
    if n ** len(at) > DRIVER_ENTRIES:
        raise ValueError(f"a table of order {n} is too large for the driver")
    out = np.zeros((n,) * len(at))
    got = df.select(*names).toArrow()
    out[tuple(got.column(c).to_numpy().astype(np.int64) for c in at)] = got.column(v).to_numpy()
    return out


class Solver(Protocol):
    """What finds the largest eigenvalues: (values, vectors as rows) of a symmetric operator of order n."""

    def solve(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]: ...


class DenseSolver:
    """All eigenvalues of a matrix (i, j, v), on the driver; for orders up to the root of DRIVER_ENTRIES."""

    def __init__(self, s: DataFrame):
        self.s = s

    def solve(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        a = small(self.s, n, "i", "j", "v")
        w, v = np.linalg.eigh((a + a.T) / 2)
        order = np.argsort(-w)[:k]
        return w[order], v[:, order].T


def matvec(s: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """x (n x columns) -> S x for a matrix (i, j, v): the matrix stays where it is, in rows of arrays; the vectors (n numbers a column) travel."""
    rows = s.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("e")).select("i", F.col("e.j").alias("j"), F.col("e.v").alias("v")).persist()

    def apply(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                j, v = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (1, 2))
                ends = batch.column(1).offsets.to_numpy()
                sums = np.add.reduceat(np.append(v[:, None] * x[j], np.zeros((1, x.shape[1])), axis=0), ends[:-1], axis=0)
                yield pa.record_batch([batch.column(0), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "y"])

        got = rows.mapInArrow(run, "i long, y array<double>").toArrow()
        out = np.zeros_like(x)
        if got.num_rows:
            out[got.column("i").to_numpy()] = np.stack(got.column("y").to_numpy())
        return out

    return apply


class KrylovSolver:
    """Thick-restarted block Lanczos (Wu & Simon 2000) on an operator that is only applied to vectors.

    apply: n x columns -> n x columns.  ncv: vectors kept at most, by default
    2 k and a block, n at most; tol: of the residual against the eigenvalue;
    restarts at most before it raises.  which: 'LA' the largest, 'SA' the
    smallest, 'LM' the largest in size.  block: vectors applied at once, so
    that a pass over the matrix serves several.
    """

    def __init__(self, apply: Callable[[np.ndarray], np.ndarray], tol: float = 1e-5, ncv: int | None = None, restarts: int = 1000, which: str = "LA", block: int = 4, seed: int = 1):
        self.apply, self.tol, self.ncv, self.restarts, self.which, self.block, self.seed = apply, tol, ncv, restarts, which, block, seed
        self.applied = 0

    def _order(self, w: np.ndarray) -> np.ndarray:
        return np.argsort({"LA": -w, "SA": w, "LM": -np.abs(w)}[self.which], kind="stable")

    def solve(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        k, block = min(k, n), min(self.block, n)
        most = min(n, self.ncv or 2 * k + 2 * block)
        rng = np.random.default_rng(self.seed)
        basis, image = np.zeros((n, 0)), np.zeros((n, 0))
        new = rng.standard_normal((n, block))
        for _ in range(self.restarts):
            while basis.shape[1] < most:
                new = _orthogonal(basis, new, rng)[:, : most - basis.shape[1]]
                got = self.apply(new)
                self.applied += 1
                basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, got], axis=1)
                new = got
            t = basis.T @ image
            w, u = np.linalg.eigh((t + t.T) / 2)
            order = self._order(w)
            w, u = w[order], u[:, order]
            values, vectors, images = w[:k], basis @ u[:, :k], image @ u[:, :k]
            rest = images - vectors * values
            error = np.linalg.norm(rest, axis=0)
            if most == n or (error <= self.tol * np.maximum(np.abs(values), 1e-300 + self.tol * np.abs(w).max())).all():
                return values, vectors.T
            keep = min(most - block, k + block)
            basis, image = basis @ u[:, :keep], image @ u[:, :keep]
            new = rest[:, np.argsort(-error)[:block]]
        raise ArithmeticError(f"no convergence after {self.restarts} restarts")


def _orthogonal(basis: np.ndarray, new: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span new without basis; a column that vanishes is drawn again."""
    out = []
    for col in new.T:
        while True:
            for _ in range(2):
                col = col - basis @ (basis.T @ col)
                for o in out:
                    col = col - o * (o @ col)
            size = np.linalg.norm(col)
            if size > 1e-10 * max(1.0, np.abs(new).max()):
                out.append(col / size)
                break
            col = rng.standard_normal(len(col))
        if basis.shape[1] + len(out) == len(col):
            break
    return np.stack(out, axis=1)


def singular_values(a: DataFrame, n: int, k: int, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Largest k singular values and right vectors (rows) of a matrix (i, j, v) of n columns, from A^T A applied twice."""
    right, left = matvec(a), matvec(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    rows = int(a.agg(F.max("i")).first()[0]) + 1

    def apply(x: np.ndarray) -> np.ndarray:
        wide = np.zeros((max(rows, n), x.shape[1]))
        wide[: len(x)] = x
        return left(right(wide))[:n]

    w, v = KrylovSolver(apply, tol).solve(n, k)
    return np.sqrt(np.maximum(w, 0)), v


SOLVERS: dict[str, Callable[[DataFrame], Solver]] = {"dense": DenseSolver, "krylov": lambda s: KrylovSolver(matvec(s))}
#: Order of a matrix up to which all its eigenvectors are found on the driver.
DRIVER = 1000


def top_modes(s: DataFrame, n: int, k: int, solver: str | Solver | None = None) -> tuple[DataFrame, DataFrame]:
    """Largest k eigenvalues (i, lambda), descending, and eigenvectors (i, a, v) of a symmetric matrix (i, j, v) of order n.

    solver: a name of SOLVERS or any Solver; by default dense up to DRIVER rows
    and beyond that Krylov, with the matrix in the tasks and k vectors of n
    numbers on the driver.
    """
    spark = s.sparkSession
    found = SOLVERS[solver or ("dense" if n <= DRIVER else "krylov")](s) if solver is None or isinstance(solver, str) else solver
    w, v = found.solve(n, min(k, n))
    evals = spark.createDataFrame(pa.table({"i": np.arange(len(w)), "lambda": w}))
    modes = spark.createDataFrame(pa.table({"i": np.repeat(np.arange(len(w)), n), "a": np.tile(np.arange(n), len(w)), "v": np.ascontiguousarray(v).ravel()}))
    return evals, modes


def generated(spark: SparkSession, n: int, entry: Callable[[Column, Column], Column], m: int | None = None) -> DataFrame:
    """(i, j, v) of an n x m matrix (m: n) whose entries are a function of their places."""
    m = m or n
    places = spark.range(n * m).select(F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"))
    return places.select("i", "j", entry(F.col("i"), F.col("j")).cast("double").alias("v"))


def random_symmetric(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, j, v): a symmetric matrix of uniform numbers of (0, 1), the same under any partitioning."""
    from ..functions.special import uniform

    return generated(spark, n, lambda i, j: uniform(seed, F.least(i, j), F.greatest(i, j)))


def submatrix(a: DataFrame, i0: int, j0: int, rows: int, cols: int) -> DataFrame:
    """The part of an (i, j, v) matrix from (i0, j0), numbered from 0."""
    some = a.where((F.col("i") >= i0) & (F.col("i") < i0 + rows) & (F.col("j") >= j0) & (F.col("j") < j0 + cols))
    return some.select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")
