"""Catalogues on a grid: cells, counts, mode amplitudes, mass deposit and power."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class Grid:
    """Equal bins of a box or of spherical coordinates (r, mu, phi)."""

    lo: tuple[float, float, float]
    hi: tuple[float, float, float]
    n: tuple[int, int, int]
    spherical: bool = False

    def bins(self, *x: str) -> list[Column]:
        return [g.axis_index(c, a, b, n) for c, a, b, n in zip(x, self.lo, self.hi, self.n, strict=True)]

    def index(self, *x: str) -> Column:
        return g.grid_index(*self.bins(*x), self.n[1], self.n[2])

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell: grid index g, bins, bounds and volume."""
        n1, n2, n3 = self.n
        df = spark.range(n1 * n2 * n3).withColumnRenamed("id", "g")
        d = g.grid_coords(F.col("g"), n2, n3)
        df = df.select("g", *(x.cast("long").alias(f"d{k}") for k, x in enumerate(d, 1)))
        for k, (a, b, n) in enumerate(zip(self.lo, self.hi, self.n, strict=True), 1):
            df = df.withColumns({f"min{k}": g.edge(F.col(f"d{k}"), a, b, n), f"max{k}": g.edge(F.col(f"d{k}") + 1, a, b, n)})
        sides = [(F.col(f"min{k}"), F.col(f"max{k}")) for k in (1, 2, 3)]
        return df.withColumn("veff", g.sphere_volume(*sides) if self.spherical else g.box_volume(*sides))


def numbered(df: DataFrame, slab: str, order: list[str], name: str) -> DataFrame:
    """df with a number 0, 1, ... in the order of slab, then of order.

    Two passes in place of one sort in one task: rows per slab are counted, and
    a slab's rows are numbered from the sum of the slabs before (one row, with
    an entry for each slab).
    """
    from pyspark.sql import Window

    slabs = df.groupBy(slab).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col(slab).alias("s"), "n"))).alias("_slabs"))
    before = F.aggregate(F.filter("_slabs", lambda s: s["s"] < F.col(slab)), F.lit(0).cast("long"), lambda t, s: t + s["n"])
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(slab).orderBy(*order)) - 1)
    return placed.crossJoin(F.broadcast(slabs)).withColumn(name, (F.col("_at") + before).cast("long")).drop("_at", "_slabs")


def number_cells(cells: DataFrame) -> DataFrame:
    """Drop empty cells and number the rest 0, 1, ... in grid order."""
    return numbered(cells.where("nbar > 0"), "d1", ["g"], "a")


def cell_counts(points: DataFrame, cells: DataFrame, grid: Grid, xyz: tuple[str, str, str] = ("x", "y", "z"), weight: str = "w") -> DataFrame:
    """(a, n): weighted count of every cell; points in no cell are counted at a = -1."""
    by_g = points.groupBy(grid.index(*xyz).alias("g")).agg(F.sum(F.col(weight).cast("double")).alias("n"))  # combined before any join
    got = by_g.join(cells.select("g", "a"), "g", "left").groupBy(F.coalesce("a", F.lit(-1).cast("long")).alias("a")).agg(F.sum("n").alias("n"))
    return cells.select("a").union(cells.sparkSession.range(1).select(F.lit(-1).cast("long"))).distinct().join(got, "a", "left").select("a", F.coalesce("n", F.lit(0.0)).alias("n"))


def overdensity(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, x): (N - Nbar) / sqrt(Nbar) of each cell."""
    return counts.join(cells.select("a", "nbar"), "a").select("a", ((F.col("n") - F.col("nbar")) / F.sqrt("nbar")).alias("x"))


def amplitudes(pixels: DataFrame, modes: DataFrame) -> DataFrame:
    """(i, y): sum over cells of B_ia x_a, for modes (i, a, v)."""
    return modes.join(pixels, "a").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def cic_deposit(points: DataFrame, n: int, size: float, xyz: tuple[str, str, str] = ("x", "y", "z"), weight: str = "w") -> DataFrame:
    """(ix, iy, iz, rho): each point's weight shared by the eight nearest nodes of a periodic grid."""
    u = [F.col(c) / F.lit(size / n) for c in xyz]
    base = points.select(F.col(weight).cast("double").alias("w"), *(F.floor(x).alias(f"b{k}") for k, x in enumerate(u)), *((x - F.floor(x)).alias(f"f{k}") for k, x in enumerate(u)))
    corner = F.array(*(F.struct(F.lit(a).alias("e0"), F.lit(b).alias("e1"), F.lit(c).alias("e2")) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    each = base.select("*", F.inline(corner))
    share = F.col("w")
    for k in range(3):
        share = share * F.when(F.col(f"e{k}") == 1, F.col(f"f{k}")).otherwise(1 - F.col(f"f{k}"))
    node = [F.pmod(F.col(f"b{k}") + F.col(f"e{k}"), F.lit(n)).alias(c) for k, c in enumerate(("ix", "iy", "iz"))]
    return each.select(*node, share.alias("s")).groupBy("ix", "iy", "iz").agg(F.sum("s").alias("rho"))


def contrast(field: DataFrame, n: int) -> DataFrame:
    """rho / mean - 1 over all n**3 nodes, nodes without a row counting as 0."""
    mean = field.agg((F.sum("rho") / F.lit(float(n**3))).alias("mean"))
    every = field.sparkSession.range(n**3).select(F.floor(F.col("id") / (n * n)).alias("ix"), (F.floor(F.col("id") / n) % n).alias("iy"), (F.col("id") % n).alias("iz"))
    full = every.join(field, ["ix", "iy", "iz"], "left")
    return full.crossJoin(F.broadcast(mean)).select("ix", "iy", "iz", (F.coalesce("rho", F.lit(0.0)) / F.col("mean") - 1).alias("delta"))  # mean is one row


def interpolate(points: DataFrame, field: DataFrame, n: int, size: float, value: str, xyz: tuple[str, str, str] = ("x", "y", "z"), id_col: str = "id") -> DataFrame:
    """(id, value): the field at each point, from its eight nearest nodes."""
    u = [F.col(c) / F.lit(size / n) for c in xyz]
    base = points.select(id_col, *(F.floor(x).alias(f"b{k}") for k, x in enumerate(u)), *((x - F.floor(x)).alias(f"f{k}") for k, x in enumerate(u)))
    corner = F.array(*(F.struct(F.lit(a).alias("e0"), F.lit(b).alias("e1"), F.lit(c).alias("e2")) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    each = base.select("*", F.inline(corner))
    share = F.lit(1.0)
    for k in range(3):
        share = share * F.when(F.col(f"e{k}") == 1, F.col(f"f{k}")).otherwise(1 - F.col(f"f{k}"))
    node = [F.pmod(F.col(f"b{k}") + F.col(f"e{k}"), F.lit(n)).alias(c) for k, c in enumerate(("ix", "iy", "iz"))]
    return each.select(id_col, *node, share.alias("s")).join(field, ["ix", "iy", "iz"]).groupBy(id_col).agg(F.sum(F.col("s") * F.col(value)).alias(value))


#: Values that one group of a transform holds, about.
SLAB = 1 << 21


def _over(axes: tuple[str, ...], n: int, inverse: bool, thick: int):
    def run(group: pa.Table) -> pa.Table:
        fixed = next(c for c in ("ix", "iy", "iz") if c not in axes)
        at = [group.column(c).to_numpy() for c in ("ix", "iy", "iz")]
        start = int(at["ix iy iz".split().index(fixed)][0]) // thick * thick
        shape = [thick if c == fixed else n for c in ("ix", "iy", "iz")]
        place = [x - start if c == fixed else x for c, x in zip(("ix", "iy", "iz"), at, strict=True)]
        cube = np.zeros(shape, complex)
        cube[tuple(place)] = group.column("re").to_numpy() + 1j * group.column("im").to_numpy()
        over = [("ix", "iy", "iz").index(c) for c in axes]
        cube = (np.fft.ifftn if inverse else np.fft.fftn)(cube, axes=over)
        out = np.indices(shape)
        cut = ("ix", "iy", "iz").index(fixed)
        out[cut] += start
        keep = out[cut].ravel() < n
        return pa.table([*(pa.array(x.ravel()[keep]) for x in out), pa.array(cube.real.ravel()[keep]), pa.array(cube.imag.ravel()[keep])], names=["ix", "iy", "iz", "re", "im"])

    return run


def fft(field: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """3-D discrete Fourier transform of (ix, iy, iz, re, im), in two shuffles: over (y, z) in slabs of planes, then along x in slabs of lines."""
    thick = max(1, min(n, SLAB // (n * n)))
    for axes, cut in ((("iy", "iz"), "ix"), (("ix",), "iy")):
        slab = F.floor(F.col(cut) / thick)
        field = field.groupBy(slab.alias("slab")).applyInArrow(_over(axes, n, inverse, thick), "ix long, iy long, iz long, re double, im double")
    return field


def frequency(i: str, n: int) -> Column:
    return F.when(F.col(i) > n // 2, F.col(i) - n).otherwise(F.col(i))


def power(modes: DataFrame, n: int, size: float, bins: int, kmax: float, shot: float = 0.0, deconvolve: bool = True, half: bool = False) -> DataFrame:
    """(bin, n_modes, pk) of modes (ix, iy, iz, re, im) in equal bins of |k|; the zero mode counts for nothing.

    With deconvolve, each mode is divided by its window of the mass deposit;
    shot is the noise 1 / density taken off.  half: only iz <= n / 2 is given
    (a real field), and modes with a mirror outside of it count twice.
    """
    from ..functions.special import cic_window

    f = [frequency(c, n) for c in ("ix", "iy", "iz")]
    unit = 2 * np.pi / size
    k = F.sqrt(sum((x * x for x in f[1:]), f[0] * f[0]).cast("double")) * F.lit(float(unit))
    w = cic_window(*(x * F.lit(unit * size / n) for x in f)) if deconvolve else F.lit(1.0)
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (w * w) * F.lit(size**3 / float(n) ** 6) - F.lit(shot)
    at = g.axis_index(k, 0.0, kmax, bins)
    many = F.when((F.col("iz") > 0) & (2 * F.col("iz") != n), 2).otherwise(1) if half else F.lit(1)
    some = modes.where(~((F.col("ix") == 0) & (F.col("iy") == 0) & (F.col("iz") == 0)))
    some = some.select(at.alias("bin"), p.alias("p"), many.cast("long").alias("many")).where("bin >= 0")
    return some.groupBy("bin").agg(F.sum("many").alias("n_modes"), (F.sum(F.col("p") * F.col("many")) / F.sum("many")).alias("pk"))


def rebinned(pk: DataFrame, lo: float, hi: float, bins: int, m: int = 2, log: bool = False) -> DataFrame:
    """(bin, p): means of P(k) with weights k**m, in equal bins of k, or of its logarithm."""
    k = F.col("k")
    at = g.axis_index(F.log(k), float(np.log(lo)), float(np.log(hi)), bins) if log else g.axis_index(k, lo, hi, bins)
    weight = F.pow(k, F.lit(float(m)))
    return pk.select(at.alias("bin"), weight.alias("w"), "p").where("bin >= 0").groupBy("bin").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def overlapping(df: DataFrame, value: str, weight: str, bins: DataFrame) -> DataFrame:
    """(bin, n, total, mean) of the rows in each bin (bin, lo, hi) of a short table; bins are half-open and may overlap or leave gaps."""
    each = df.select(F.col(value).alias("x"), F.col(weight).cast("double").alias("w"))
    # the bins' edges cut the line into pieces that lie wholly in or out of each bin: rows are summed by piece before they meet the bins
    edges = bins.select(F.explode(F.array("lo", "hi")).alias("e")).agg(F.array_sort(F.collect_set("e")).alias("edges"))
    piece = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    sums = each.crossJoin(F.broadcast(edges)).groupBy(piece.alias("piece"), F.get("edges", piece - 1).alias("from")).agg(F.count("*").alias("n"), F.sum("w").alias("total"))  # edges is one row
    got = sums.join(F.broadcast(bins), (F.col("from") >= F.col("lo")) & (F.col("from") < F.col("hi")))
    return got.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("mean", F.col("total") / F.col("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, density): normalised equal-bin histogram over [lo, hi)."""
    counts = df.select(g.axis_index(value, lo, hi, bins).alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / (F.col("total") * F.lit((hi - lo) / bins))).alias("density"))  # total is one row
