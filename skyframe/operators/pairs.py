"""Pairs of points within a separation, their histogram, and correlation estimators."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import wrap
from ..functions.special import legendre


def _bucketed(df: DataFrame, width: float, cells: int | None, side: str) -> DataFrame:
    axis = lambda c: F.floor(F.col(c) / F.lit(width)) if cells is None else F.pmod(F.floor(F.col(c) / F.lit(width)), F.lit(cells))
    return df.select(F.col("id").alias(f"id_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("x", "y", "z")), *(axis(c).alias(f"b{k}") for k, c in enumerate(("x", "y", "z"))))


#: Points of a cube that meet in one part; a cube of more is split.
CROWD = 4096


def _parts(points: DataFrame, keys: list[str]) -> int:
    """Parts that the fullest cube is split into."""
    most = points.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return -(-most // CROWD)


def pairs(left: DataFrame, right: DataFrame | None, smax: float, size: float | None = None, salt: int | None = None) -> DataFrame:
    """(s, mu) of point pairs closer than smax; right=None takes each unordered pair of left once.

    Points (id, x, y, z) are dealt to cubes of at least smax; one side is
    copied to the 27 cubes around its own and the sides meet by equality, so
    only neighbours are compared.  size makes the box periodic.  salt splits
    each cube of one side into that many parts and copies the other; by default
    as many as the fullest cube needs, which is counted.
    mu is the cosine with the third axis, null at s = 0.
    """
    cells = max(1, int(size / smax)) if size else None
    width = size / cells if size else smax
    own = right is None
    a, b = _bucketed(left, width, cells, "l"), _bucketed(left if own else right, width, cells, "r")
    steps = [(0, 0, 0)] if cells == 1 else list(itertools.product(*([range(-1, 2) if cells is None or cells > 2 else range(2)] * 3)))
    near = F.array(*(F.struct(*(F.lit(v).alias(f"e{k}") for k, v in enumerate(s))) for s in steps))
    b = b.select("*", F.inline(near))
    move = lambda k: F.col(f"b{k}") + F.col(f"e{k}") if cells is None else F.pmod(F.col(f"b{k}") + F.col(f"e{k}"), F.lit(cells))
    b = b.select(*(c for c in b.columns if c[0] not in "be"), *(move(k).alias(f"b{k}") for k in range(3)))
    keys = ["b0", "b1", "b2"]
    salt = salt or _parts(a, keys)
    if salt > 1:
        a = a.withColumn("part", F.pmod(F.xxhash64("id_l"), F.lit(salt)))
        b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        keys.append("part")
    both = a.join(b, keys)
    if own:
        both = both.where("id_l < id_r")
    d = [F.col(f"{c}_r") - F.col(f"{c}_l") for c in ("x", "y", "z")]
    if size:
        d = [wrap(x, size) for x in d]
    s = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return both.select(s.alias("s"), F.try_divide(d[2], s).alias("mu")).where(F.col("s") < F.lit(smax))


def _bin(x: Column, lo: float, hi: float, n: int) -> Column:
    return F.floor((x - F.lit(lo)) * F.lit(n / (hi - lo)))


def pair_histogram(found: DataFrame, smin: float, smax: float, ns: int, nmu: int = 1) -> DataFrame:
    """(i1, i2, n): pairs by separation in [smin, smax) and by |mu| in [0, 1); |mu| = 1 belongs to the last bin, no mu to the first."""
    i1 = _bin(F.col("s"), smin, smax, ns)
    i2 = F.least(F.lit(nmu - 1).cast("long"), F.coalesce(F.floor(F.abs("mu") * nmu), F.lit(0).cast("long")))
    some = found.where((F.col("s") >= smin) & (F.col("s") < smax))
    return some.select(i1.alias("i1"), i2.alias("i2")).groupBy("i1", "i2").agg(F.count("*").alias("n"))


def totals(nd: int, nr: int, legacy: bool = False) -> tuple[int, int, int]:
    """Numbers of pairs DD, DR and RR; legacy counts each point with itself."""
    own = (lambda n: n * (n + 1) // 2) if legacy else (lambda n: n * (n - 1) // 2)
    return own(nd), nd * nr, own(nr)


def weighed(dd: DataFrame, dr: DataFrame, rr: DataFrame, total: list[float] | tuple, kind: str = "ls") -> DataFrame:
    """(i1, i2, xi) of pair counts (i1, i2, n) over their totals: ph DD/RR - 1, ls (DD - 2 DR + RR) / RR, dp DD/DR - 1, ham DD RR / DR**2 - 1; 0 without the divisor."""
    keys = ["i1", "i2"]
    both = rr.withColumnRenamed("n", "rr").join(dd.withColumnRenamed("n", "dd"), keys, "full").join(dr.withColumnRenamed("n", "dr"), keys, "full")
    d, x, r = (F.coalesce(c, F.lit(0)) / F.lit(float(max(t, 1))) for c, t in zip(("dd", "dr", "rr"), total, strict=True))
    xi = {"ph": F.try_divide(d, r) - 1, "ls": F.try_divide(d - 2 * x + r, r), "dp": F.try_divide(d, x) - 1, "ham": F.try_divide(d * r, x * x) - 1}[kind]
    return both.select(*keys, F.coalesce(xi, F.lit(0.0)).alias("xi"))


def correlation(dd: DataFrame, dr: DataFrame, rr: DataFrame, nd: int, nr: int, kind: str = "ls") -> DataFrame:
    """weighed, with the totals of nd data and nr random points."""
    return weighed(dd, dr, rr, totals(nd, nr), kind)


def multipoles(xi: DataFrame, nmu: int, orders: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """(i1, xi0, xi2, ...): (2l + 1) sum over mu bins of xi P_l(mu) dmu."""
    mid = (F.col("i2") + 0.5) / F.lit(float(nmu))
    return xi.groupBy("i1").agg(*((F.sum(F.col("xi") * legendre(n, mid)) * F.lit((2 * n + 1) / nmu)).alias(f"xi{n}") for n in orders))


def converged(now: DataFrame, before: DataFrame, value: str, epsabs: float, epsrel: float) -> DataFrame:
    """One row: whether every bin moved by at most epsabs, or epsrel of its value."""
    both = now.select("i1", F.col(value).alias("n")).join(before.select("i1", F.col(value).alias("b")), "i1", "full")
    d = F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.bool_and((d <= epsabs) | (d <= F.lit(epsrel) * F.abs(F.coalesce("n", F.lit(0.0))))).alias("converged"))


def converge(sample: Callable[[int], tuple[DataFrame, DataFrame]], nmu: int, smin: float, smax: float, ns: int, tolerance: dict[int, tuple[float, float]], size: float | None = None, passes: int = 5, most: int = 1000, kind: str = "ls") -> tuple[DataFrame, int, bool]:
    """Correlation by repeated sampling until it holds still.

    sample(k) draws the k-th data and random points (id, x, y, z).  Pair counts
    of all samplings are summed; after each, the multipoles (tolerance: order
    to absolute and relative change) are compared with those before, and
    `passes` agreements in a row end the loop.  Returns (i1, xi0, ...), the
    number of samplings and whether they agreed.  Only sums by bin, ns * nmu
    rows, are carried from one sampling to the next.
    """
    spark, orders = None, sorted(tolerance)
    sums: dict[str, DataFrame] = {}
    total, before, agreed = [0.0, 0.0, 0.0], None, 0
    for k in range(most):
        data, random = sample(k)
        spark = data.sparkSession
        nd, nr = data.count(), random.count()
        total = [t + x for t, x in zip(total, totals(nd, nr), strict=True)]
        for name, (a, b) in {"dd": (data, None), "dr": (data, random), "rr": (random, None)}.items():
            new = pair_histogram(pairs(a, b, smax, size), smin, smax, ns, nmu)
            both = new.union(sums[name]).groupBy("i1", "i2").agg(F.sum("n").alias("n")) if name in sums else new
            sums[name] = spark.createDataFrame(both.toArrow(), "i1 long, i2 long, n long")
        now = multipoles(weighed(sums["dd"], sums["dr"], sums["rr"], total, kind), nmu, tuple(orders))
        now = spark.createDataFrame(now.toArrow())
        if before is not None:
            same = all(converged(now, before, f"xi{n}", *tolerance[n]).first()[0] for n in orders)
            agreed = agreed + 1 if same else 0
        before = now
        if agreed == passes:
            return now, k + 1, True
    return before, most, False
