"""Points, cells, separations and projections as column expressions.

All arguments are columns or numbers; lengths are in one unit, angles in
radians, and spherical points are (r, mu = cos(theta), phi).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int
PI = math.pi


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def let(make, **values: Column) -> Column:
    """make(*values) with each value computed once, however often make uses it (expressions are trees: nested ones would grow without bound)."""
    bound = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.transform(bound, lambda r: make(*(r[k] for k in values)))[0]


def axis_index(x: Num, lo: float, hi: float, n: int) -> Column:
    """Bin of x in n equal half-open bins of [lo, hi), or -1 outside."""
    d = F.floor((col(x) - F.lit(float(lo))) * F.lit(float(n)) / F.lit(float(hi) - float(lo)))
    return F.when((d >= 0) & (d < n), d).otherwise(F.lit(-1).cast("long"))


def grid_index(d1: Column, d2: Column, d3: Column, n2: int, n3: int) -> Column:
    """One number for three bins, or -1 if any is outside."""
    return F.when((d1 >= 0) & (d2 >= 0) & (d3 >= 0), (d1 * n2 + d2) * n3 + d3).otherwise(F.lit(-1).cast("long"))


def grid_coords(g: Column, n2: int, n3: int) -> tuple[Column, Column, Column]:
    return F.floor(g / (n2 * n3)), F.floor(g / n3) % n2, g % n3


def edge(d: Column, lo: float, hi: float, n: int) -> Column:
    """Lower edge of bin d; the upper one is edge(d + 1)."""
    return F.lit(float(lo)) + d * F.lit((float(hi) - float(lo)) / n)


def box_volume(*sides: tuple[Column, Column]) -> Column:
    out = F.lit(1.0)
    for lo, hi in sides:
        out = out * (hi - lo)
    return out


def sphere_volume(r: tuple[Column, Column], mu: tuple[Column, Column], phi: tuple[Column, Column]) -> Column:
    cube = lambda x: x * x * x
    return (cube(r[1]) - cube(r[0])) / 3.0 * (mu[1] - mu[0]) * (phi[1] - phi[0])


def wrap(dx: Num, size: float) -> Column:
    """A difference within (-size, size), moved into [-size/2, size/2)."""
    d, half = col(dx), size / 2
    return d + F.lit(float(size)) * ((d < -half).cast("int") - (d >= half).cast("int"))


def norm(*d: Column) -> Column:
    total = d[0] * d[0]
    for x in d[1:]:
        total = total + x * x
    return F.sqrt(total)


def box_separation(p: tuple, q: tuple, size: float) -> Column:
    """Periodic distance of two points of a box."""
    return norm(*(wrap(col(b) - col(a), size) for a, b in zip(p, q, strict=True)))


def box_rmu(p: tuple, q: tuple, size: float) -> tuple[Column, Column]:
    """Periodic distance and the cosine of its angle with the third axis; null for the same point."""
    dz = wrap(col(q[2]) - col(p[2]), size)
    r = box_separation(p, q, size)
    return r, F.try_divide(dz, r)


def box_rab(p: tuple, q: tuple, size: float) -> tuple[Column, Column, Column]:
    """Sides of the triangle of two points and the centre of the box, without wrapping: (separation, distance of each point)."""
    a = [col(x) - F.lit(size / 2) for x in p]
    b = [col(x) - F.lit(size / 2) for x in q]
    return norm(*(y - x for x, y in zip(a, b, strict=True))), norm(*a), norm(*b)


def cos_between(mu1: Num, phi1: Num, mu2: Num, phi2: Num) -> Column:
    mu1, mu2 = col(mu1), col(mu2)
    return mu1 * mu2 + F.sqrt(F.greatest(1 - mu1 * mu1, F.lit(0.0)) * F.greatest(1 - mu2 * mu2, F.lit(0.0))) * F.cos(col(phi2) - col(phi1))


def sky_separation(p: tuple, q: tuple) -> Column:
    """Distance of two spherical points, by the law of cosines."""
    r1, r2 = col(p[0]), col(q[0])
    return F.sqrt(F.greatest(r1 * r1 + r2 * r2 - 2 * r1 * r2 * cos_between(p[1], p[2], q[1], q[2]), F.lit(0.0)))


def sky_rmu(p: tuple, q: tuple) -> tuple[Column, Column]:
    """Separation s and the cosine of its angle with the line of sight that halves the opening angle; mu is null at s = 0."""
    r1, r2, s = col(p[0]), col(q[0]), sky_separation(p, q)
    cos_half = F.sqrt(F.greatest((1 + cos_between(p[1], p[2], q[1], q[2])) / 2, F.lit(0.0)))
    return s, F.try_divide((r2 - r1) * cos_half, s)


def sky_rab(p: tuple, q: tuple) -> tuple[Column, Column, Column]:
    return sky_separation(p, q), col(p[0]), col(q[0])


def to_sphere(x: Num, y: Num, z: Num) -> tuple[Column, Column, Column]:
    """(r, mu, phi) with phi = pi + atan2(y, x) in [0, 2 pi]; mu is null at the origin."""
    r = norm(col(x), col(y), col(z))
    return r, F.try_divide(col(z), r), F.lit(PI) + F.atan2(col(y), col(x))


def to_cartesian(r: Num, mu: Num, phi: Num) -> tuple[Column, Column, Column]:
    """Inverse of to_sphere."""
    flat = col(r) * F.sqrt(F.greatest(1 - col(mu) * col(mu), F.lit(0.0)))
    angle = col(phi) - F.lit(PI)
    return flat * F.cos(angle), flat * F.sin(angle), col(r) * col(mu)


def hammer(lon: Num, lat: Num) -> tuple[Column, Column]:
    """Equal-area sky map: x in [-2 sqrt 2, 2 sqrt 2], y in [-sqrt 2, sqrt 2]."""
    lon, lat = col(lon), col(lat)
    scale = F.sqrt(2.0 / (1.0 + F.cos(lat) * F.cos(lon / 2)))
    return 2.0 * scale * F.cos(lat) * F.sin(lon / 2), scale * F.sin(lat)


def inverse_hammer(x: Num, y: Num) -> tuple[Column, Column]:
    """(lon, lat), null outside of the map's ellipse."""
    x, y = col(x), col(y)
    inside = x * x / 8 + y * y / 2 <= 1
    z = F.sqrt(F.greatest(1 - x * x / 16 - y * y / 4, F.lit(0.0)))
    lon = 2 * F.atan2(z * x, 2 * (2 * z * z - 1))
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z * y)))
    return F.when(inside, lon), F.when(inside, lat)


def redshift_distant(x: Num, v: Num, d: Num) -> Column:
    """Position moved along a fixed line of sight."""
    return col(x) + col(d) * col(v)


def redshift_radial(p: tuple, v: tuple, observer: tuple) -> tuple[Column, ...]:
    """Position moved along the line from the observer by the velocity's part along it; unmoved at the observer."""
    d = [col(x) - col(o) for x, o in zip(p, observer, strict=True)]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    along = F.coalesce(F.try_divide(sum((a * col(b) for a, b in zip(d[1:], v[1:], strict=True)), d[0] * col(v[0])), r2), F.lit(0.0))
    return tuple(col(x) + along * a for x, a in zip(p, d, strict=True))


def inside_box(p: tuple, lo: tuple, hi: tuple) -> Column:
    """Closed containment."""
    out = F.lit(True)
    for x, a, b in zip(p, lo, hi, strict=True):
        out = out & col(x).between(a, b)
    return out


def hubble(z: Num, matter: float = 0.272, vacuum: float = 0.728) -> Column:
    z = 1 + col(z)
    return F.sqrt(F.lit(matter) * z * z * z + F.lit(vacuum))
