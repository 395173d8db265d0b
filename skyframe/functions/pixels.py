"""Equal-area sky pixels (12 base faces, nside**2 pixels each), in ring and nested order, as column expressions.

Everything is derived from the projection of Calabretta & Roukema (2007).  In
quarter turns, a point (mu, phi) of the belt |mu| <= 2/3 lies at U = phi, V =
3 mu / 4, one of a polar cap at U = c + (phi - c) s, |V| = 1 - s / 2, with s =
sqrt(3 (1 - |mu|)) and c the middle of its quarter.  The faces are squares
turned by 45 degrees: with S and T the rounded U + V and U - V, S - T is 1 on
the northern, 0 on the equatorial and -1 on the southern faces.  A pixel is
its face's (S, T) and its row and column (x, y) on the face.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import Num, col, inverse_hammer, let

HALF_PI = math.pi / 2


def npix(nside: int) -> int:
    return 12 * nside * nside


def nside_of(pixels: int) -> int:
    n = math.isqrt(pixels // 12)
    if npix(n) != pixels:
        raise ValueError(f"{pixels} is not 12 times a square")
    return n


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def _place(n: int, mu: Num, phi: Num) -> Column:
    """(s, t, x, y): the pixel that a point lies in."""
    inside = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), x))

    def plane(z: Column, t: Column, quarter: Column, s: Column, polar: Column) -> Column:
        u = F.when(polar, quarter + 0.5 + (t - quarter - 0.5) * s).otherwise(t)
        v = F.when(polar, F.signum(z) * (1 - s / 2)).otherwise(0.75 * z)
        return let(face, a=u + v + 0.5, b=u - v + 0.5, z=z, quarter=quarter, polar=polar)

    def face(a: Column, b: Column, z: Column, quarter: Column, polar: Column) -> Column:
        s = F.when(polar, quarter + (z > 0).cast("long")).otherwise(_long(a))
        t = F.when(polar, quarter + (z < 0).cast("long")).otherwise(_long(b))
        return let(lambda a, b, s, t: F.struct(s.alias("s"), t.alias("t"), inside(_long((a - s) * n)).alias("x"), inside(n - 1 - _long((b - t) * n)).alias("y")), a=a, b=b, s=s, t=t)

    def turn(z: Column, t: Column) -> Column:
        return let(plane, z=z, t=t, quarter=F.least(_long(t), F.lit(3).cast("long")), s=F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0))), polar=F.abs(z) > F.lit(2.0 / 3.0))

    return let(turn, z=col(mu).cast("double"), t=F.pmod(col(phi) / F.lit(HALF_PI), F.lit(4.0)))


def _ring_of(n: int, s: Column, t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(ring from 1 in the north, place from 0 in it) of a pixel: from V and U of its centre."""
    ring = n * (3 - (s - t)) - x - y - 1
    belt = F.pmod(_long((n * (s + t) + x - y) / F.lit(2.0)), F.lit(4 * n))
    north = t * ring + n - 1 - y
    south = s * (4 * n - ring) + x
    return ring, F.when(ring < n, north).when(ring > 3 * n, south).otherwise(belt)


def _before(n: int, ring: Column) -> Column:
    """Pixels of the rings before one."""
    m = 4 * n - ring
    return F.when(ring < n, 2 * ring * (ring - 1)).when(ring > 3 * n, npix(n) - 2 * m * (m + 1)).otherwise(2 * n * (n - 1) + (ring - n) * 4 * n)


def _angles(n: int, ring: Column, place: Column) -> Column:
    """(mu, phi) of the centre of a place in a ring."""
    m = F.least(ring, 4 * n - ring, F.lit(n).cast("long"))
    cap = 1 - m * m / F.lit(3.0 * n * n)
    mu = F.when(ring < n, cap).when(ring > 3 * n, -cap).otherwise((2 * n - ring) * 2 / F.lit(3.0 * n))
    shift = F.when((m == n) & ((ring - n) % 2 == 1), 0.0).otherwise(0.5)
    return F.struct(mu.alias("mu"), ((place + shift) / m * F.lit(HALF_PI)).alias("phi"))


def _weave(n: int, x: Column, y: Column) -> Column:
    """Bits of x at the even places and of y at the odd ones."""
    bit = lambda c, b: F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), 2 * b)
    bits = range(n.bit_length() - 1)
    even = sum((bit(x, b) for b in bits), F.lit(0).cast("long"))
    return even + 2 * sum((bit(y, b) for b in bits), F.lit(0).cast("long"))


def _part(n: int, w: Column) -> Column:
    """The bits at the even places."""
    return sum((F.shiftleft(F.shiftright(w, 2 * b).bitwiseAND(F.lit(1).cast("long")), b) for b in range(n.bit_length() - 1)), F.lit(0).cast("long"))


def _power_of_two(n: int) -> None:
    if n & (n - 1):
        raise ValueError(f"nested order needs a power of 2, not {n}")


def ring_pixel(nside: int, mu: Num, phi: Num) -> Column:
    def of(place: Column) -> Column:
        ring, at = _ring_of(nside, *(place[k] for k in "stxy"))
        return let(lambda ring, at: (_before(nside, ring) + at).cast("long"), ring=ring, at=at)

    return let(of, place=_place(nside, mu, phi))


def nest_pixel(nside: int, mu: Num, phi: Num) -> Column:
    _power_of_two(nside)

    def of(place: Column) -> Column:
        s, t = place["s"], place["t"]
        face = F.when(s > t, t % 4).when(s < t, 8 + s % 4).otherwise(4 + s % 4)
        return (face * (nside * nside) + _weave(nside, place["x"], place["y"])).cast("long")

    return let(of, place=_place(nside, mu, phi))


def _centre(make, **values: Column) -> tuple[Column, Column]:
    both = let(make, **values)
    return both["mu"], both["phi"]


def ring_centre(nside: int, pixel: Num) -> tuple[Column, Column]:
    """(mu, phi) of a pixel's centre."""
    n, p = nside, col(pixel).cast("long")
    # 2 r (r - 1) <= p < 2 r (r + 1) in the northern cap, and so from the end in the southern
    root = lambda q: _long((1 + F.sqrt(1 + 2.0 * q)) / 2)
    cap = 2 * n * (n - 1)
    ring = F.when(p < cap, root(p)).when(p >= npix(n) - cap, 4 * n - root(npix(n) - 1 - p)).otherwise(_long((p - cap) / (4 * n)) + n)
    return _centre(lambda ring, p: _angles(n, ring, p - _before(n, ring)), ring=ring, p=p)


def nest_centre(nside: int, pixel: Num) -> tuple[Column, Column]:
    _power_of_two(nside)
    n, p = nside, col(pixel).cast("long")

    def of(k: Column, face: Column, x: Column, y: Column) -> Column:
        ring, place = _ring_of(n, F.when(face < 4, k + 1).otherwise(k), F.when(face >= 8, k + 1).otherwise(k), x, y)
        return let(lambda ring, place: _angles(n, ring, place), ring=ring, place=place)

    within = p % (n * n)
    face = _long(p / (n * n))
    return _centre(of, k=face % 4, face=face, x=_part(n, within), y=_part(n, F.shiftright(within, 1)))


def to_vector(mu: Num, phi: Num) -> tuple[Column, Column, Column]:
    flat = F.sqrt(F.greatest(1 - col(mu) * col(mu), F.lit(0.0)))
    return flat * F.cos(col(phi)), flat * F.sin(col(phi)), col(mu)


def from_vector(x: Num, y: Num, z: Num) -> tuple[Column, Column]:
    """(mu, phi) with phi in [0, 2 pi)."""
    r = F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z))
    return F.try_divide(col(z), r), F.pmod(F.atan2(col(y), col(x)), F.lit(2 * math.pi))


def map_average(points: DataFrame, nside: int, value: str, mu: str = "mu", phi: str = "phi", nested: bool = False) -> DataFrame:
    """(ipix, value): the mean of the points in each pixel that has any."""
    at = (nest_pixel if nested else ring_pixel)(nside, mu, phi)
    return points.select(at.alias("ipix"), F.col(value).cast("double").alias("value")).groupBy("ipix").agg(F.avg("value").alias("value"))


def image_to_map(image: DataFrame, width: int, height: int, nside: int, samples: int = 4, nested: bool = False) -> DataFrame:
    """(ipix, value) of an image (column, row, value) of the whole sky in a Hammer projection, by samples x samples points of each of its pixels."""
    steps = F.sequence(F.lit(0), F.lit(samples - 1))
    each = image.select("column", "row", "value", F.explode(steps).alias("a")).select("*", F.explode(steps).alias("b"))
    root = math.sqrt(2.0)
    x = ((F.col("column") + (F.col("a") + 0.5) / samples) / F.lit(float(width)) * 2 - 1) * F.lit(2 * root)
    y = (1 - (F.col("row") + (F.col("b") + 0.5) / samples) / F.lit(float(height)) * 2) * F.lit(root)
    lon, lat = inverse_hammer(x, y)
    return map_average(each.select(F.sin(lat).alias("mu"), lon.alias("phi"), "value").where("mu is not null"), nside, "value", nested=nested)


def map_to_image(spark, sky: DataFrame, width: int, height: int, nside: int, samples: int = 4, nested: bool = False) -> DataFrame:
    """(column, row, value) of the Hammer projection of a map (ipix, value): the mean of samples x samples points of each pixel; null off the sky."""
    n = width * height * samples * samples
    place = F.col("id")
    parts = [(place % samples).alias("b"), (F.floor(place / samples) % samples).alias("a"), (F.floor(place / samples**2) % width).alias("column"), F.floor(place / (samples**2 * width)).alias("row")]
    root = math.sqrt(2.0)
    x = ((F.col("column") + (F.col("a") + 0.5) / samples) / F.lit(float(width)) * 2 - 1) * F.lit(2 * root)
    y = (1 - (F.col("row") + (F.col("b") + 0.5) / samples) / F.lit(float(height)) * 2) * F.lit(root)
    lon, lat = inverse_hammer(x, y)
    each = spark.range(n).select(*parts).select("column", "row", F.sin(lat).alias("mu"), lon.alias("phi"))
    each = each.withColumn("ipix", F.when(F.col("mu").isNotNull(), (nest_pixel if nested else ring_pixel)(nside, "mu", "phi")))
    return each.join(sky, "ipix", "left").groupBy("column", "row").agg(F.avg("value").alias("value"))
