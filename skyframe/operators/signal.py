"""Integrals over cells and the signal matrix."""

from __future__ import annotations

import heapq
import inspect
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import sky_rmu

def nodes(n: int) -> tuple[list[float], list[float]]:
    """Gauss-Legendre nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return ((x + 1) / 2).tolist(), (w / 2).tolist()


def with_nodes(df: DataFrame, n: int, axes: int = 3, prefix: str = "t") -> DataFrame:
    """A row for each tensor node: t1, t2, ... in [0, 1] and their weight."""
    x, w = nodes(n)
    one = F.array(*(F.struct(F.lit(a).alias("t"), F.lit(b).alias("w")) for a, b in zip(x, w, strict=True)))
    weight = F.lit(1.0)
    for k in range(1, axes + 1):
        df = df.withColumn(f"_{prefix}{k}", F.explode(one)).withColumn(f"{prefix}{k}", F.col(f"_{prefix}{k}.t"))
        weight = weight * F.col(f"_{prefix}{k}.w")
    return df.withColumn(f"{prefix}_weight", weight).drop(*(f"_{prefix}{k}" for k in range(1, axes + 1)))


def cell_integral(cells: DataFrame, density: Callable[..., Column], n: int = 4, spherical: bool = False) -> DataFrame:
    """cells with nbar: the integral of a density over each cell, with n nodes an axis (in r**3 / 3 for spherical cells)."""
    each = with_nodes(cells.select("g", "min1", "max1", "min2", "max2", "min3", "max3"), n)
    at = lambda k: F.col(f"min{k}") + F.col(f"t{k}") * (F.col(f"max{k}") - F.col(f"min{k}"))
    cube = lambda c: F.col(c) * F.col(c) * F.col(c)
    first = F.cbrt(cube("min1") + F.col("t1") * (cube("max1") - cube("min1"))) if spherical else at(1)
    side = (cube("max1") - cube("min1")) / 3.0 if spherical else F.col("max1") - F.col("min1")
    volume = side * (F.col("max2") - F.col("min2")) * (F.col("max3") - F.col("min3"))
    sums = each.groupBy("g").agg(F.sum(F.col("t_weight") * volume * density(first, at(2), at(3))).alias("nbar"))
    return cells.join(sums, "g")


#: xi(r), or xi(r, mu) with mu the cosine of the separation and the line of sight.
Xi = Callable[..., Column]


def of_separation(xi: Callable, r, mu):
    """xi at a separation, whether it takes mu or not."""
    some = [p for p in inspect.signature(xi).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    return xi(r, mu) if len(some) > 1 else xi(r)


def _bins(cells: DataFrame, *axes: int) -> DataFrame:
    """A row for each combination of absolute differences of the bins along the axes (o1, ...), and the side of a cell along each (h1, ...)."""
    ends = cells.agg(*(f(F.col(f"d{k}")).alias(f"{n}{k}") for k in axes for f, n in ((F.min, "a"), (F.max, "b"))), *(F.max(F.col(f"max{k}") - F.col(f"min{k}")).alias(f"h{k}") for k in axes))
    for k in axes:
        ends = ends.where(F.col(f"a{k}").isNotNull()).withColumn(f"o{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"b{k}") - F.col(f"a{k}"))))
    return ends.select(*(f"o{k}" for k in axes), *(f"h{k}" for k in axes))


def _pairs(cells: DataFrame, keep: list[str], rows: Column | None, cols: Column | None, stride: int) -> DataFrame:
    """Pairs of cells: Ncells**2 rows, as many as the matrix has."""
    pick = lambda df, c: df if c is None else df.where(c)
    p, q = (pick(cells, c).where(F.col("a") % stride == 0) if stride > 1 else pick(cells, c) for c in (rows, cols))
    p, q = (df.select(*(F.col(c).alias(f"{c}_{s}") for c in keep)) for df, s in ((p, "i"), (q, "j")))
    return p.crossJoin(q)


def signal_matrices(cells: DataFrame, functions: list[Xi], n: int = 3, rows: Column | None = None, cols: Column | None = None, spherical: bool = False, stride: int = 1) -> DataFrame:
    """(m, i, j, v): for each function, sqrt(N_i N_j) times its mean over the pairs of points of two cells, by n nodes an axis.

    Of equal box cells the mean depends on the absolute offsets of the bins
    only, of spherical ones on both (r, mu) bins and the offset in phi; it is
    integrated once for each such class, for all functions in one pass, and
    joined to the pairs.  mu is along the third axis of a box, and the pair's
    own line of sight on the sphere.  rows and cols select a block, stride
    every so manieth cell.
    """
    weight = F.col("t_weight") * F.col("u_weight")
    if not spherical:
        key = ["o1", "o2", "o3"]
        each = with_nodes(with_nodes(_bins(cells, 1, 2, 3), n, prefix="t"), n, prefix="u")
        d = [(F.col(f"o{k}") + F.col(f"u{k}") - F.col(f"t{k}")) * F.col(f"h{k}") for k in (1, 2, 3)]
        each = each.select(*key, weight.alias("w"), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("s"), d[2].alias("along"))
        each = each.withColumn("mu", F.coalesce(F.try_divide("along", "s"), F.lit(0.0)))
        both = _pairs(cells, ["a", "d1", "d2", "d3", "nbar"], rows, cols, stride).withColumns({f"o{k}": F.abs(F.col(f"d{k}_i") - F.col(f"d{k}_j")) for k in (1, 2, 3)})
    else:
        key = ["d1_i", "d2_i", "d1_j", "d2_j", "o3"]
        bounds = [f"{m}{k}" for k in (1, 2) for m in ("min", "max")]
        ring = cells.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in bounds))
        p, q = (ring.select(*(F.col(c).alias(f"{c}_{s}") for c in ("d1", "d2", *bounds))) for s in "ij")
        each = with_nodes(with_nodes(p.crossJoin(q).crossJoin(_bins(cells, 3)), n, prefix="t"), n, prefix="u")
        cube = lambda c: F.col(c) * F.col(c) * F.col(c)
        r = lambda s, t: F.cbrt(cube(f"min1_{s}") + F.col(f"{t}1") * (cube(f"max1_{s}") - cube(f"min1_{s}")))
        at = lambda s, t: F.col(f"min2_{s}") + F.col(f"{t}2") * (F.col(f"max2_{s}") - F.col(f"min2_{s}"))
        turn = (F.col("o3") + F.col("u3") - F.col("t3")) * F.col("h3")
        each = each.select(*key, weight.alias("w"), r("i", "t").alias("r1"), r("j", "u").alias("r2"), at("i", "t").alias("m1"), at("j", "u").alias("m2"), turn.alias("turn"))
        s, mu = sky_rmu(("r1", "m1", F.lit(0.0)), ("r2", "m2", "turn"))
        each = each.select(*key, "w", s.alias("s"), F.coalesce(mu, F.lit(0.0)).alias("mu"))
        both = _pairs(cells, ["a", "d1", "d2", "d3", "nbar"], rows, cols, stride).withColumn("o3", F.abs(F.col("d3_i") - F.col("d3_j")))
    means = each.groupBy(*key).agg(F.array(*(F.sum(F.col("w") * of_separation(f, F.col("s"), F.col("mu"))) for f in functions)).alias("means"))
    out = both.join(means, key).select(F.col("a_i").alias("i"), F.col("a_j").alias("j"), F.sqrt(F.col("nbar_i") * F.col("nbar_j")).alias("scale"), F.posexplode("means").alias("m", "mean"))
    return out.select(F.col("m").cast("long").alias("m"), "i", "j", (F.col("scale") * F.col("mean")).alias("v"))


def signal_matrix(cells: DataFrame, xi: Xi, n: int = 3, dedup: bool = True, rows: Column | None = None, cols: Column | None = None, stride: int = 1) -> DataFrame:
    """(i, j, v) of one function of box cells, as in signal_matrices; without dedup, each pair is integrated for itself."""
    if dedup:
        return signal_matrices(cells, [xi], n, rows, cols, False, stride).drop("m")
    both = _pairs(cells, ["a", "nbar", *(f"{m}{k}" for k in (1, 2, 3) for m in ("min", "max"))], rows, cols, stride)
    each = with_nodes(with_nodes(both, n, prefix="t"), n, prefix="u")
    at = lambda k, s, t: F.col(f"min{k}_{s}") + F.col(f"{t}{k}") * (F.col(f"max{k}_{s}") - F.col(f"min{k}_{s}"))
    d = [at(k, "j", "u") - at(k, "i", "t") for k in (1, 2, 3)]
    s = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    each = each.select("a_i", "a_j", F.sqrt(F.col("nbar_i") * F.col("nbar_j")).alias("scale"), (F.col("t_weight") * F.col("u_weight")).alias("w"), s.alias("s"), F.coalesce(F.try_divide(d[2], s), F.lit(0.0)).alias("mu"))
    mean = F.sum(F.col("w") * of_separation(xi, F.col("s"), F.col("mu")))
    return each.groupBy("a_i", "a_j", "scale").agg(mean.alias("mean")).select(F.col("a_i").alias("i"), F.col("a_j").alias("j"), (F.col("scale") * F.col("mean")).alias("v"))


def spherical_signal(cells: DataFrame, xi: Xi, n: int = 3) -> DataFrame:
    """(i, j, v) of one function of spherical cells, as in signal_matrices."""
    return signal_matrices(cells, [xi], n, spherical=True).drop("m")


def adaptive_signal(cells: DataFrame, xi: Callable[..., np.ndarray], epsrel: float = 1e-5, epsabs: float = 1e-10, most: int = 2_000_000) -> DataFrame:
    """(i, j, v, error) of box cells by adaptive quadrature; xi takes arrays r, or r and mu.

    The mean over the pairs of points of two equal boxes is, exactly, that over
    their difference with weights that fall linearly from its middle: three
    dimensions in place of six, cut where the weights bend.  Each class of
    offsets is integrated once, class by class in the tasks.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = []
            for row in pdf.itertuples():
                o, h = np.array([row.o1, row.o2, row.o3]), np.array([row.h1, row.h2, row.h3])

                def f(p: np.ndarray, o: np.ndarray, h: np.ndarray, signs: np.ndarray) -> np.ndarray:
                    d = (o + signs * p) * h
                    r = np.sqrt((d * d).sum(axis=1))
                    mu = np.divide(d[:, 2], r, out=np.zeros_like(r), where=r > 0)
                    return of_separation(xi, r, mu) * (1 - p).prod(axis=1)

                parts = [adaptive(lambda p, g=np.array(g): f(p, o, h, g), [0.0] * 3, [1.0] * 3, epsabs / 8, epsrel, most) for g in itertools.product((-1, 1), repeat=3)]  # noqa: B023
                got.append((row.o1, row.o2, row.o3, sum(p[0] for p in parts), sum(p[1] for p in parts)))
            yield pd.DataFrame(got, columns=["o1", "o2", "o3", "mean", "error"])

    means = _bins(cells, 1, 2, 3).repartition("o1", "o2", "o3").mapInPandas(run, "o1 long, o2 long, o3 long, mean double, error double")
    both = _pairs(cells, ["a", "d1", "d2", "d3", "nbar"], None, None, 1).withColumns({f"o{k}": F.abs(F.col(f"d{k}_i") - F.col(f"d{k}_j")) for k in (1, 2, 3)})
    scale = F.sqrt(F.col("nbar_i") * F.col("nbar_j"))
    return both.join(means, ["o1", "o2", "o3"]).select(F.col("a_i").alias("i"), F.col("a_j").alias("j"), (scale * F.col("mean")).alias("v"), (scale * F.col("error")).alias("error"))


def adaptive(f: Callable[[np.ndarray], np.ndarray], lo: list[float], hi: list[float], epsabs: float = 0.0, epsrel: float = 1e-5, most: int = 2_000_000) -> tuple[float, float]:
    """Integral of f (an array of points to values) over a box, and an error estimate.

    Splits the region of largest error in two along the axis where the values
    bend most, until the errors sum to epsabs or epsrel of the value, or `most`
    points are used.  Each region has Gauss rules of 5 and 7 points an axis (3
    and 4 beyond three axes); their difference is its error.
    """
    lo, hi, dims = np.array(lo, float), np.array(hi, float), len(lo)
    small, large = (5, 7) if dims <= 3 else (3, 4)

    def grid(n: int) -> tuple[np.ndarray, np.ndarray]:
        x, w = (np.array(v) for v in nodes(n))
        return np.stack([m.ravel() for m in np.meshgrid(*[x] * dims, indexing="ij")], axis=1), np.prod([m.ravel() for m in np.meshgrid(*[w] * dims, indexing="ij")], axis=0)

    rules = [grid(small), grid(large)]

    def region(a: np.ndarray, b: np.ndarray):
        volume = (b - a).prod()
        values = [f(a + x * (b - a)) for x, _ in rules]
        got = [volume * (w * v).sum() for (_, w), v in zip(rules, values, strict=True)]
        cube = values[1].reshape((large,) * dims)
        bend = [np.abs(np.diff(cube, 2, axis=k)).sum() for k in range(dims)]
        return -abs(got[1] - got[0]), got[1], a, b, int(np.argmax(bend))

    count, used = 0, len(rules[0][1]) + len(rules[1][1])
    heap = [(*region(lo, hi)[:1], 0, region(lo, hi)[1:])]
    while True:
        total, error = sum(h[2][0] for h in heap), -sum(h[0] for h in heap)
        if error <= max(epsabs, epsrel * abs(total)) or used >= most:
            return total, error
        _, _, (_, a, b, k) = heapq.heappop(heap)
        mid = (a[k] + b[k]) / 2
        for c, d in ((a, np.where(np.arange(dims) == k, mid, b)), (np.where(np.arange(dims) == k, mid, a), b)):
            count += 1
            used += len(rules[0][1]) + len(rules[1][1])
            r = region(c, d)
            heapq.heappush(heap, (r[0], count, r[1:]))


def adaptive_integral(cells: DataFrame, f: Callable[[np.ndarray], np.ndarray], epsrel: float = 1e-5) -> DataFrame:
    """(g, nbar, error): adaptive integral of f over each box cell, cell by cell in the tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [adaptive(f, [r.min1, r.min2, r.min3], [r.max1, r.max2, r.max3], epsrel=epsrel) for r in pdf.itertuples()]
            yield pd.DataFrame({"g": pdf["g"], "nbar": [v for v, _ in got], "error": [e for _, e in got]})

    return cells.select("g", "min1", "max1", "min2", "max2", "min3", "max3").mapInPandas(run, "g long, nbar double, error double")


def transform(pk: DataFrame, r: DataFrame, order: int, power: int, damp: float) -> DataFrame:
    """(r, xi): integral over k of k**power P(k) j_order(k r) exp(-(k / damp)**2) / (2 pi**2), by Simpson's rule.

    pk: (i, k, p) on an even number of equal steps, i = 0, 1, ...; what depends
    on k only is computed once for each k, before it meets the r.
    """
    from ..functions.special import bessel

    ends = pk.agg(F.max("i").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    k = F.col("k")
    term = F.lit(1.0)
    for _ in range(power):
        term = term * k
    simpson = F.when((F.col("i") == 0) | (F.col("i") == F.col("n")), 1.0).when(F.col("i") % 2 == 1, 4.0).otherwise(2.0)
    side = pk.crossJoin(F.broadcast(ends)).select("k", (simpson * (F.col("k1") - F.col("k0")) / F.col("n") / 3.0 * term * F.col("p") * F.exp(-(k / F.lit(float(damp))) * (k / F.lit(float(damp))))).alias("c"))
    return r.crossJoin(side).groupBy("r").agg((F.sum(F.col("c") * bessel(order, k * F.col("r"))) / F.lit(2 * np.pi**2)).alias("xi"))


def shell_coefficients(spark: SparkSession, xi: Callable[[Column], Column], radius: float, orders: int, points: int = 200) -> DataFrame:
    """(n, a): Legendre coefficients of xi between two points of a thin shell, over the cosine of their angle, at midpoints."""
    from ..functions.special import legendre_any

    x = F.lit(-1.0) + (F.col("i") + 0.5) * F.lit(2.0 / points)
    each = spark.range(orders).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("n", x.alias("x"))
    r = F.lit(float(radius)) * F.sqrt(F.greatest(2 - 2 * F.col("x"), F.lit(0.0)))
    sums = each.groupBy("n").agg(F.sum(xi(r) * legendre_any(F.col("n"), F.col("x")) * F.lit(2.0 / points)).alias("a"))
    return sums.select(F.col("n").cast("long").alias("n"), (F.col("a") * (2 * F.col("n") + 1) / 2).alias("a"))
