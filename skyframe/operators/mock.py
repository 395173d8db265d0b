"""Mock catalogues: Gaussian fields, sampled points, thinning, radial density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.geometry import to_sphere
from ..functions.pixels import ring_pixel
from .grid import fft, frequency


def modes(spark: SparkSession, n: int, size: float, pk, seed: int, smooth: float = 0.0) -> DataFrame:
    """(ix, iy, iz, re, im) of a Gaussian field with power pk(k), smoothed by exp(-k**2 R**2 / 2).

    The draws of a mode depend on the seed and the mode only; a mode and its
    mirror share them, so the field is real.  The zero mode and those beyond
    the Nyquist frequency are 0.
    """
    df = spark.range(n**3).select(F.floor(F.col("id") / (n * n)).alias("ix"), (F.floor(F.col("id") / n) % n).alias("iy"), (F.col("id") % n).alias("iz"))
    mirror = [F.pmod(-F.col(c), F.lit(n)) for c in ("ix", "iy", "iz")]
    place = lambda a, b, c: (a * n + b) * n + c
    own, other = place(F.col("ix"), F.col("iy"), F.col("iz")), place(*mirror)
    key = F.least(own, other)
    unit = 2 * math.pi / size
    f = [frequency(c, n) for c in ("ix", "iy", "iz")]
    k = F.sqrt((f[0] * f[0] + f[1] * f[1] + f[2] * f[2]).cast("double")) * F.lit(unit)
    amplitude = F.when((own == 0) | (k > F.lit(unit * n / 2)), 0.0).otherwise(F.sqrt(pk(k) / 2) * F.exp(-k * k * F.lit(smooth * smooth / 2))) * F.lit(n**3 / size**1.5)
    a, b = sp.normal(sp.uniform(seed, key, F.lit(0))), sp.normal(sp.uniform(seed, key, F.lit(1)))
    re = F.when(own == other, a * math.sqrt(2)).otherwise(a)
    im = F.when(own == other, 0.0).when(own < other, b).otherwise(-b)
    return df.select("ix", "iy", "iz", (amplitude * re).alias("re"), (amplitude * im).alias("im"))


def density(field_modes: DataFrame, n: int, mean: float, bias: float = 1.0) -> DataFrame:
    """(ix, iy, iz, rho): mean * max(0, 1 + bias * delta)."""
    return fft(field_modes, n, inverse=True).select("ix", "iy", "iz", (F.lit(mean) * F.greatest(F.lit(0.0), 1 + F.lit(bias) * F.col("re"))).alias("rho"))


def velocity(field_modes: DataFrame, n: int, size: float, f: float, axis: int) -> DataFrame:
    """(ix, iy, iz, v) along an axis: the transform of i k f delta / k**2."""
    unit = 2 * math.pi / size
    w = [frequency(c, n) * F.lit(unit) for c in ("ix", "iy", "iz")]
    ratio = F.coalesce(F.try_divide(w[axis] * F.lit(f), w[0] * w[0] + w[1] * w[1] + w[2] * w[2]), F.lit(0.0))
    edge = F.col(("ix", "iy", "iz")[axis]) == n // 2 if n % 2 == 0 else F.lit(False)
    ratio = F.when(edge, 0.0).otherwise(ratio)
    turned = field_modes.select("ix", "iy", "iz", (-F.col("im") * ratio).alias("re"), (F.col("re") * ratio).alias("im"))
    return fft(turned, n, inverse=True).select("ix", "iy", "iz", F.col("re").alias("v"))


def sample(field: DataFrame, n: int, size: float, seed: int) -> DataFrame:
    """(id, x, y, z): a Poisson number of points in each cell, uniform within it."""
    h = size / n
    cell = (F.col("ix") * n + F.col("iy")) * n + F.col("iz")
    number = sp.poisson(sp.uniform(seed, cell), F.col("rho") * F.lit(h**3))
    each = field.select("ix", "iy", "iz", cell.alias("cell"), number.alias("number")).where("number > 0")
    each = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("number"))).alias("k"))
    at = lambda c, d: ((F.col(c) + sp.uniform(seed, F.col("cell"), F.col("k"), F.lit(d))) * F.lit(h)).alias("xyz"[d])
    return each.select(_point_id(), at("ix", 0), at("iy", 1), at("iz", 2))


def _point_id() -> Column:
    """Of point k of a cell: unique up to 2**31 cells of 2**32 points each."""
    return (F.shiftleft(F.col("cell"), 32) + F.col("k")).alias("id")


def corners(field: DataFrame, n: int, value: str = "rho") -> DataFrame:
    """(ix, iy, iz, v000 ... v111): the values at the eight nodes around each cell of a periodic grid; nodes without a row are 0."""
    step = F.array(*(F.struct(F.lit(a).alias("e0"), F.lit(b).alias("e1"), F.lit(c).alias("e2")) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    each = field.select("ix", "iy", "iz", F.col(value).alias("v"), F.inline(step))
    cell = [F.pmod(F.col(c) - F.col(f"e{k}"), F.lit(n)).alias(c) for k, c in enumerate(("ix", "iy", "iz"))]
    key = F.concat(*(F.col(f"e{k}").cast("string") for k in range(3))).alias("key")
    got = each.select(*cell, key, "v").groupBy("ix", "iy", "iz")
    return got.agg(*(F.coalesce(F.max(F.when(F.col("key") == f"{a}{b}{c}", F.col("v"))), F.lit(0.0)).alias(f"v{a}{b}{c}") for a in (0, 1) for b in (0, 1) for c in (0, 1)))


def sample_between(field: DataFrame, n: int, size: float, seed: int, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, x, y, z, ...): points whose density is trilinear between the nodes: a Poisson number for each cell, placed by its corners.

    extra: further fields (ix, iy, iz, v), such as velocities, that each point
    gets by the same interpolation, as columns of those names.
    """
    h = size / n
    names = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    column = lambda k, p="v": F.col(p + "".join(map(str, k)))
    cell = ((F.col("ix") * n + F.col("iy")) * n + F.col("iz")).alias("cell")
    each = corners(field, n).select("*", cell)
    for name, other in (extra or {}).items():
        of = corners(other, n, "v")
        each = each.join(of.select("ix", "iy", "iz", *(F.col(c).alias(f"{name}_{c[1:]}") for c in of.columns[3:])), ["ix", "iy", "iz"])
    mean = sum((column(k) for k in names[1:]), column(names[0])) / 8
    number = sp.poisson(sp.uniform(seed, F.col("cell")), mean * F.lit(h**3))
    each = each.withColumn("number", number).where("number > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("number"))))
    t = sp.trilinear_draw({k: column(k) for k in names}, tuple(sp.uniform(seed, F.col("cell"), F.col("k"), F.lit(d)) for d in range(3)))
    each = each.withColumn("t", t)
    u = tuple(F.col(f"t.t{d}") for d in (1, 2, 3))
    more = [sp.trilinear({k: column(k, f"{name}_") for k in names}, u).alias(name) for name in extra or {}]
    return each.select(_point_id(), *(((F.col(c) + x) * F.lit(h)).alias("xyz"[d]) for d, (c, x) in enumerate(zip(("ix", "iy", "iz"), u, strict=True))), *more)


def uniform_catalogue(spark: SparkSession, n: int, size: float, seed: int) -> DataFrame:
    """n uniform points of a box, weight 1."""
    return spark.range(n).select("id", *((sp.uniform(seed, F.col("id"), F.lit(d)) * F.lit(float(size))).alias("xyz"[d]) for d in range(3)), F.lit(1.0).alias("w"))


def uniform_shell(spark: SparkSession, n: int, r0: float, r1: float, seed: int) -> DataFrame:
    """n uniform points of a spherical shell: (id, r, mu, phi, w), the radius from the inverse of its distribution."""
    u = [sp.uniform(seed, F.col("id"), F.lit(d)) for d in range(3)]
    return spark.range(n).select("id", F.cbrt(F.lit(r0**3) + u[0] * F.lit(r1**3 - r0**3)).alias("r"), (2 * u[1] - 1).alias("mu"), (u[2] * F.lit(2 * math.pi)).alias("phi"), F.lit(1.0).alias("w"))


def thin(points: DataFrame, u1: Column, u2: Column, radial: Column, mask: Column, scale: Column) -> DataFrame:
    """Points that pass both draws: u1 < scale * radial and u2 < mask."""
    return points.where((u1 < scale * radial) & (u2 < mask))


def feasible_scale(spark: SparkSession, radial: DataFrame, wanted: float, mean: float, area: float) -> tuple[float, bool]:
    """(Q, whether Q * radial <= mean everywhere): Q makes Q * area * integral of r**2 radial(r) dr (trapezoids) the wanted number."""
    from pyspark.sql import Window

    w = Window.orderBy("r")  # a table of one function
    steps = radial.select("r", (F.col("r") * F.col("r") * F.col("nbar")).alias("f"), "nbar").select("*", F.lag("r").over(w).alias("r0"), F.lag("f").over(w).alias("f0"))
    total, top = steps.agg(F.sum((F.col("r") - F.col("r0")) * (F.col("f") + F.col("f0")) / 2), F.max("nbar")).first()
    q = wanted / (area * total)
    return q, q * top <= mean


def support(spark: SparkSession, radial: DataFrame, step: float = 10.0, most: float = 100_000.0) -> tuple[float, float]:
    """(first, last) of the connected support of a spline, on a grid: the node before it is positive, and the one where it is no more."""
    grid = spark.range(int(most / step) + 1).select((F.col("id") * F.lit(step)).alias("r"))
    on = sp.lookup(grid, "r", radial, "y").where("y > 0")
    first = on.agg(F.min("r")).first()[0]
    if first is None:
        raise ValueError("the radial density is zero everywhere")
    off = sp.lookup(grid, "r", radial, "y").where((F.col("y") <= 0) & (F.col("r") > first)).agg(F.min("r")).first()[0]
    return max(first - step, 0.0), off if off is not None else most


def realistic(points: DataFrame, size: float, radial: DataFrame, mask: DataFrame, nside: int, wanted: float, seed: int, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), r_range: tuple[float, float] | None = None, steps: int = 8192) -> DataFrame:
    """(id, r, mu, phi) of a mock survey: points (id, x, y, z) of a uniform box, thinned to a radial profile (a spline's shape) and a sky mask (ipix, value; ring order).

    The profile is scaled so that about `wanted` points remain; more than the
    box has anywhere is an error.
    """
    spark = points.sparkSession
    r0, r1 = r_range or support(spark, radial)
    grid = spark.range(steps + 1).select((F.lit(r0) + F.col("id") * F.lit((r1 - r0) / steps)).alias("r"))
    density = points.count() / size**3
    area = sky_area(mask).first()[0]
    q, fits = feasible_scale(spark, sp.lookup(grid, "r", radial, "nbar"), wanted, density, area)
    if not fits:
        raise ValueError(f"the box has too few points for {wanted} with this profile")
    moved = points.select("id", *((F.col(c) - F.lit(o)).alias(c) for c, o in zip(("x", "y", "z"), origin, strict=True)))
    r, mu, phi = to_sphere("x", "y", "z")
    sky = moved.select("id", r.alias("r"), mu.alias("mu"), phi.alias("phi")).where(F.col("r").between(r0, r1))
    placed = sp.lookup(sky, "r", radial, "nbar").withColumn("ipix", ring_pixel(nside, "mu", "phi")).join(mask, "ipix", "left")
    kept = thin(placed, sp.uniform(seed, F.col("id"), F.lit(0)), sp.uniform(seed, F.col("id"), F.lit(1)), F.col("nbar"), F.coalesce("value", F.lit(0.0)), F.lit(q / density))
    return kept.select("id", "r", "mu", "phi")


def radial_density(points: DataFrame, r0: float, r1: float, bins: int, area: float, weight: str = "w") -> DataFrame:
    """(bin, nbar): weighted count of each radial bin over its volume."""
    from ..functions.geometry import axis_index

    h = (r1 - r0) / bins
    counts = points.select(axis_index("r", r0, r1, bins).alias("bin"), F.col(weight).cast("double").alias("w")).where("bin >= 0").groupBy("bin").agg(F.sum("w").alias("n"))
    lo = F.lit(r0) + F.col("bin") * F.lit(h)
    hi = F.lit(r0) + (F.col("bin") + 1) * F.lit(h)
    return counts.select("bin", (F.col("n") / (F.lit(area / 3) * (hi * hi * hi - lo * lo * lo))).alias("nbar"))


def sky_area(mask: DataFrame) -> DataFrame:
    """One row: 4 pi times the mean of the mask."""
    return mask.agg((F.lit(4 * math.pi) * F.avg("value")).alias("area"))


def sigma_for(share: float, step: float = 1e-4) -> float:
    """The first sigma = 0.01, 0.01 + step, ... for which a Gaussian contrast is below -1 with a probability of `share` at least."""
    n = 0
    while 0.5 * math.erfc(1 / ((0.01 + n * step) * math.sqrt(2))) < share:
        n += 1
    return 0.01 + n * step


def smoothing_radius(pk: DataFrame, sigma: float, step: float = 0.01, most: float = 50.0) -> DataFrame:
    """One row (radius, sigma): the first R = 0, step, ... at which the field smoothed by exp(-k**2 R**2 / 2) varies by at most sigma.

    pk: (i, k, p) on equal steps; the variances (trapezoids of k**2 P / 2 pi**2)
    of all radii come from one pass over it.
    """
    ends = pk.agg(F.max("i").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    k = F.col("k")
    weight = F.when((F.col("i") == 0) | (F.col("i") == F.col("n")), 0.5).otherwise(1.0) * (F.col("k1") - F.col("k0")) / F.col("n")
    each = pk.crossJoin(F.broadcast(ends)).select("k", (weight * k * k * F.col("p") / F.lit(2 * math.pi**2)).alias("c"))  # ends is one row
    radii = pk.sparkSession.range(int(most / step) + 1).select((F.col("id") * F.lit(step)).alias("radius"))
    spread = radii.crossJoin(each).groupBy("radius").agg(F.sqrt(F.sum(F.col("c") * F.exp(-k * k * F.col("radius") * F.col("radius")))).alias("sigma"))
    best = spread.where(F.col("sigma") <= sigma).agg(F.min(F.struct("radius", "sigma")).alias("best"))
    return best.select("best.radius", "best.sigma")
