"""Special functions, interpolation and correlation models as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Num, col, let


def bessel(order: int, x: Num) -> Column:
    """Spherical Bessel function of order 0 to 4; its series near 0."""
    x = col(x)
    y = x * x
    odd = math.prod(range(2 * order + 1, 0, -2))
    power = F.lit(1.0)
    for _ in range(order):
        power = power * x
    near = power / odd * (1 - y / (2 * (2 * order + 3)) + y * y / (8 * (2 * order + 3) * (2 * order + 5)))
    s, c = F.sin(x), F.cos(x)
    far = {
        0: F.try_divide(s, x),
        1: F.try_divide(s - x * c, y),
        2: F.try_divide((3 - y) * s - 3 * x * c, y * x),
        3: F.try_divide((15 - 6 * y) * s - (15 - y) * x * c, y * y),
        4: F.try_divide((105 - 45 * y + y * y) * s - (105 - 10 * y) * x * c, y * y * x),
    }[order]
    return F.when(y < (1e-4 if order < 2 else 1e-2), near).otherwise(far)


def legendre(order: int, x: Num) -> Column:
    """Legendre polynomial by its recursion, unrolled."""
    x = col(x)
    a, b = F.lit(1.0), x
    if order == 0:
        return a
    for n in range(1, order):
        a, b = b, ((2 * n + 1) * x * b - n * a) / (n + 1)
    return b


def legendre_any(order: Column, x: Column) -> Column:
    """Legendre polynomial of an order that is a column."""
    start = F.struct(F.lit(1.0).alias("a"), x.alias("b"))
    steps = F.when(order >= 2, F.sequence(F.lit(1), order - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, start, lambda s, n: F.struct(s["b"].alias("a"), (((2 * n + 1) * x * s["b"] - n * s["a"]) / (n + 1)).alias("b")), lambda s: s["b"])
    return F.when(order == 0, F.lit(1.0)).otherwise(last)


def cic_window(*kh: Num) -> Column:
    """Product of sinc(k h / 2)**2 over the axes."""
    out = F.lit(1.0)
    for k in kh:
        s = bessel(0, col(k) / 2)
        out = out * s * s
    return out


def kaiser(f: Num) -> tuple[Column, Column, Column]:
    """Factors of the multipoles 0, 2 and 4 of linear redshift distortions."""
    f = col(f)
    return 1 + 2 * f / 3 + f * f / 5, 4 * f / 3 + 4 * f * f / 7, 8 * f * f / 35


def tent(x: Num, lo: Num, mid: Num, hi: Num) -> Column:
    x, lo, mid, hi = col(x), col(lo), col(mid), col(hi)
    return F.when((x > lo) & (x <= mid), (x - lo) / (mid - lo)).when((x > mid) & (x < hi), (hi - x) / (hi - mid)).otherwise(0.0)


def test_xi(r: Num, amplitude: Num, rate: Num, kind: str) -> Column:
    """Simple correlations: A exp(-b r), A exp(-b r**2) or A r exp(-b r**2)."""
    r, a, b = col(r), col(amplitude), col(rate)
    return {"exp": a * F.exp(-b * r), "gauss": a * F.exp(-b * r * r), "ring": a * r * F.exp(-b * r * r)}[kind]


def trilinear(corners: dict[tuple[int, int, int], Column], u: tuple) -> Column:
    """Value at (u1, u2, u3) in the unit cube from its eight corners."""
    out = F.lit(0.0)
    for key, value in sorted(corners.items()):
        w = value
        for bit, x in zip(key, u, strict=True):
            w = w * (col(x) if bit else 1 - col(x))
        out = out + w
    return out


def spline_table(x: list[float], y: list[float], kind: str = "linear") -> list[tuple[float, ...]]:
    """(lo, hi, c0, c1, c2, c3) of each interval: the value is c0 + d (c1 + d (c2 + d c3)) at d = x - lo.

    kind: linear, cubic (third derivatives at the ends from the four end
    points), shifted (linear between points moved by tau = 0.21, so that the
    line prefilters itself) or constant (the left value).
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    h, n = np.diff(x), len(x)
    if n < 2 or (h <= 0).any():
        raise ValueError("abscissae must increase")
    zero = np.zeros(n - 1)
    if kind == "constant":
        c = (y[:-1], zero, zero, zero)
    elif kind == "linear" or n < 3 and kind == "cubic":
        c = (y[:-1], np.diff(y) / h, zero, zero)
    elif kind == "shifted":
        tau = 0.21
        moved = y.copy()
        for i in range(1, n):
            moved[i] = (y[i] - tau * moved[i - 1]) / (1 - tau)
        c = (moved[:-1], np.diff(moved) / h, zero, zero)
        return [tuple(map(float, r)) for r in zip(x[:-1] + tau * h, x[1:] + tau * np.append(h[1:], h[-1]), *c, strict=True)]
    elif kind == "cubic":
        slope = np.diff(y) / h
        a = np.zeros((n, n))
        b = np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = slope[i] - slope[i - 1]
        a[0, :2], a[-1, -2:] = (-h[0], h[0]), (h[-1], -h[-1])
        if n > 3:
            third = lambda i: ((slope[i + 2] - slope[i + 1]) / (x[i + 3] - x[i + 1]) - (slope[i + 1] - slope[i]) / (x[i + 2] - x[i])) / (x[i + 3] - x[i])
            b[0], b[-1] = h[0] ** 2 * third(0), -(h[-1] ** 2) * third(n - 4)
        s = np.linalg.solve(a, b)
        c = (y[:-1], slope - h * (s[1:] + 2 * s[:-1]), 3 * s[:-1], np.diff(s) / h)
    else:
        raise ValueError(kind)
    return [tuple(map(float, r)) for r in zip(x[:-1], x[1:], *c, strict=True)]


def spline_frame(spark: SparkSession, table: list[tuple[float, ...]]) -> DataFrame:
    return spark.createDataFrame(table, "lo double, hi double, c0 double, c1 double, c2 double, c3 double")


def band_mean(f: Callable[[Column], Column], lo: Num, hi: Num, points: int = 256) -> Column:
    """Mean of f at the midpoints of equal parts of [lo, hi)."""
    lo, step = col(lo), (col(hi) - col(lo)) / F.lit(float(points))
    return F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0.0), lambda s, i: s + f(lo + (i + 0.5) * step)) / F.lit(float(points))


#: Intervals of a spline that are broadcast at most (48 bytes each).
BROADCAST_INTERVALS = 1_000_000


def lookup(df: DataFrame, x: str, spline: DataFrame, out: str, bins: int | None = None, order: int = 0) -> DataFrame:
    """df with the spline's value at x, or its derivative of an order up to 2; 0 outside of [first lo, last hi).

    A range join by equality: intervals are dealt to equal bins that they
    touch, about one to a bin, and points to theirs.  A spline of more than
    BROADCAST_INTERVALS is joined by shuffle.  Its bounds are two numbers.
    """
    lo, hi, many = spline.agg(F.min("lo"), F.max("hi"), F.count("*")).first()
    bins = bins or max(64, min(2 * many, 1 << 30))
    small = F.broadcast if many <= BROADCAST_INTERVALS else lambda d: d
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int")))
    parts = spline.withColumn("_bin", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    inside = (F.col(x) >= lo) & (F.col(x) < hi)
    d = F.col(x) - F.col("lo")
    joined = df.withColumn("_bin", F.when(inside, at(F.col(x)))).alias("l").join(small(parts.alias("s")), (F.col("l._bin") == F.col("s._bin")) & (F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi")), "left")
    c = [F.col(f"c{k}") for k in range(4)]
    value = F.coalesce({0: c[0] + d * (c[1] + d * (c[2] + d * c[3])), 1: c[1] + d * (2 * c[2] + 3 * d * c[3]), 2: 2 * c[2] + 6 * d * c[3]}[order], F.lit(0.0))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), value.alias(out))


def qspline_nodes(n1: int, n2: int, x1: float, x2: float) -> list[float]:
    """n1 equal steps on [0, x1), then n2 equal steps of the logarithm up to x2."""
    return [x1 * i / n1 for i in range(n1)] + [x1 * (x2 / x1) ** (i / (n2 - 1)) for i in range(n2)]


def tabled(table: list[tuple[float, ...]], n1: int, n2: int, x1: float, x2: float) -> Callable[[Num], Column]:
    """The spline of qspline_nodes(n1, n2, x1, x2) as a function of a column: the interval follows from x, so nothing is joined; 0 outside."""
    lo, *c = (F.lit([r[k] for r in table]) for k in (0, 2, 3, 4, 5))
    step, rate = n1 / x1, (n2 - 1) / math.log(x2 / x1)

    def at(x: Column, i: Column) -> Column:
        d = x - F.get(lo, i)
        return F.when((x < 0) | (x >= x2), 0.0).otherwise(F.get(c[0], i) + d * (F.get(c[1], i) + d * (F.get(c[2], i) + d * F.get(c[3], i))))

    def of(x: Num) -> Column:
        x = col(x)
        place = F.when(x < x1, F.floor(x * step)).otherwise(n1 + F.floor(F.log(F.greatest(x, F.lit(x1)) / F.lit(x1)) * rate))
        return let(at, x=x, i=F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), place)).cast("int"))

    return of


def spline_maximum(spline: DataFrame) -> DataFrame:
    """One row (x, y): where a cubic or linear spline is largest, among its ends and the places where its derivative vanishes."""
    h, b, c, d = F.col("hi") - F.col("lo"), F.col("c1"), F.col("c2"), F.col("c3")
    root = F.sqrt(F.greatest(c * c - 3 * b * d, F.lit(0.0)))
    # the smaller root by the stable form; without curvature there is none
    turns = [F.try_divide(-c - root, 3 * d), F.try_divide(-c + root, 3 * d), F.when(F.abs(d) < 1e-300, F.try_divide(-b, 2 * c))]
    each = spline.select("lo", "c0", "c1", "c2", "c3", h.alias("h"), F.explode(F.array(F.lit(0.0), h, *turns)).alias("d")).where("d >= 0 and d <= h")
    y = F.col("c0") + F.col("d") * (b + F.col("d") * (c + F.col("d") * d))
    best = each.agg(F.max(F.struct(y.alias("y"), (-(F.col("lo") + F.col("d"))).alias("x"))).alias("m"))
    return best.select((-F.col("m.x")).alias("x"), F.col("m.y").alias("y"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key only, not on the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal(u: Column) -> Column:
    """Inverse of the normal distribution function, to a relative 1e-9, by Acklam's rational fractions (fixed values)."""
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def poly(k: list[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = u - 0.5
    tail = lambda p: F.sqrt(-2 * F.log(p))
    low, high = tail(F.least(u, F.lit(0.5))), tail(F.least(1 - u, F.lit(0.5)))
    return F.when(u < 0.02425, poly(c, low) / poly(d, low)).when(u > 1 - 0.02425, -poly(c, high) / poly(d, high)).otherwise(q * poly(a, q * q) / poly(b, q * q))


def exponential(u: Column, rate: Num) -> Column:
    return -F.log(1 - u) / col(rate)


def poisson(u: Column, mean: Column) -> Column:
    """Inverse of the Poisson distribution function, by its terms, for any mean.

    From a mean of 100 the sum starts ten deviations below it (what lies before
    is under 1e-22), at a term from Stirling's series.
    """
    def start(m: Column) -> Column:
        k = F.when(m < 100, F.lit(0)).otherwise(F.floor(m - 10 * F.sqrt(m))).cast("long")
        n = F.greatest(k, F.lit(1).cast("long")).cast("double")
        # ln n!: exact to 1e-16 from 10 on; 0 terms are taken without it
        factorial = n * F.log(n) - n + F.log(F.lit(2 * math.pi) * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0))) - 1 / (1680 * F.pow(n, F.lit(7.0)))
        p = F.exp(F.when(k == 0, -m).otherwise(k * F.log(m) - m - factorial))
        return F.struct(k.alias("k"), p.alias("p"))

    def walk(u: Column, m: Column, first: Column) -> Column:
        zero = F.struct(first["p"].alias("p"), first["p"].alias("sum"), first["k"].alias("k"))
        step = lambda s, i: F.when(s["sum"] >= u, s).otherwise(F.struct((s["p"] * m / i).alias("p"), (s["sum"] + s["p"] * m / i).alias("sum"), i.alias("k")))
        last = F.ceil(m + 12 * F.sqrt(m) + 12)
        k = F.aggregate(F.sequence(first["k"] + 1, last), zero, step, lambda s: s["k"]).cast("long")
        return F.when(u <= 0, F.lit(0).cast("long")).otherwise(k)

    return let(lambda u, m: let(walk, u=u, m=m, first=start(m)), u=u, m=mean)


def ramp(u: Column, f0: Column, f1: Column) -> Column:
    """Draw from a density on [0, 1] that is linear from f0 to f1."""
    root = F.sqrt(f0 * f0 * (1 - u) + f1 * f1 * u)
    return F.coalesce(F.try_divide(u * (f0 + f1), f0 + root), u)


def trilinear_draw(corners: dict[tuple[int, int, int], Column], u: tuple[Column, Column, Column]) -> Column:
    """(t1, t2, t3): a point of the unit cube from a density that is trilinear between its corners, from three uniform numbers.

    Axis by axis: the density summed over the axes to come is linear along one.
    """
    def first(*c: Column) -> Column:
        g = dict(zip(sorted(corners), c[:8], strict=True))
        face = [g[a, 0, 0] + g[a, 0, 1] + g[a, 1, 0] + g[a, 1, 1] for a in (0, 1)]
        return let(second, t1=ramp(c[8], *face), **{f"c{k}": x for k, x in enumerate(c[:8])}, u2=c[9], u3=c[10])

    def second(t1: Column, *c: Column) -> Column:
        g = dict(zip(sorted(corners), c[:8], strict=True))
        side = {(b, e): g[0, b, e] * (1 - t1) + g[1, b, e] * t1 for b in (0, 1) for e in (0, 1)}
        return let(third, t1=t1, t2=ramp(c[8], side[0, 0] + side[0, 1], side[1, 0] + side[1, 1]), **{f"s{b}{e}": v for (b, e), v in side.items()}, u3=c[9])

    def third(t1: Column, t2: Column, s00: Column, s01: Column, s10: Column, s11: Column, u3: Column) -> Column:
        return F.struct(t1.alias("t1"), t2.alias("t2"), ramp(u3, s00 * (1 - t2) + s10 * t2, s01 * (1 - t2) + s11 * t2).alias("t3"))

    return let(first, **{f"c{k}": corners[key] for k, key in enumerate(sorted(corners))}, u1=u[0], u2=u[1], u3=u[2])


#: Degree, coefficients and first odd values of the polynomials of the dimensions after the first (Joe & Kuo; fixed values).
SOBOL = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19])]


def sobol(index: Column, dims: int) -> list[Column]:
    """The coordinates of Sobol's point number index (skipping is counting), up to 10 dimensions."""
    return [sobol_column(index, sobol_directions(*p)) for p in [(0, 0, []), *SOBOL][:dims]]


def sobol_column(index: Column, directions: list[int]) -> Column:
    """Coordinate of a Sobol point: xor of the direction numbers at the bits of the index's Gray code, over 2**32."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(0).cast("long")
    for b, v in enumerate(directions):
        out = out.bitwiseXOR(F.shiftright(gray, b).bitwiseAND(F.lit(1).cast("long")) * F.lit(v).cast("long"))
    return out / F.lit(float(1 << 32))


def sobol_directions(degree: int, coefficients: int, first: list[int], bits: int = 32) -> list[int]:
    """Direction numbers from a primitive polynomial and first odd values (Joe & Kuo); degree 0 is the van der Corput sequence."""
    if degree == 0:
        return [1 << (31 - i) for i in range(bits)]
    m = list(first)
    for i in range(degree, bits):
        new = m[i - degree] ^ (m[i - degree] << degree)
        for k in range(1, degree):
            new ^= ((coefficients >> (degree - 1 - k)) & 1) * (m[i - k] << k)
        m.append(new)
    return [v << (31 - i) for i, v in enumerate(m)]
