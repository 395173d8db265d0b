"""Surveys: where galaxies come from, how they are separated, how many are expected, and the grid they are counted on.

A survey is made from a configuration, whose keys are checked.  Register
further kinds with @survey("name").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import Num, col
from ..functions.pixels import nest_pixel, ring_pixel
from ..functions.special import lookup, spline_frame, spline_table
from ..operators.grid import Grid
from ..operators.signal import with_nodes
from ..sources import config as cf
from ..sources import loaders, tables

SURVEYS: dict[str, type] = {}
#: Sky maps of more pixels are joined by shuffle.
BROADCAST_PIXELS = 12 * 256 * 256


def survey(name: str):
    def add(cls):
        SURVEYS[name] = cls
        return cls

    return add


def make(spark: SparkSession, config: dict[str, str]) -> Survey:
    """The survey that `survey` names (or coordsys: cartesian is a box, spherical a sky), from the keys after `survey.` or the bare ones."""
    kind = config.get("survey") or {"cartesian": "box", "spherical": "spherical"}.get(config.get("coordsys", ""))
    if kind not in SURVEYS:
        raise KeyError(f"no survey {kind!r}; there are {', '.join(sorted(SURVEYS))}")
    return SURVEYS[kind](spark, config | cf.sub(config, "survey."))


class Separation:
    """The separation of two points: r; (r, mu); (r, a, b) of the triangle with the observer."""

    def __init__(self, r: Callable, rmu: Callable, rab: Callable):
        self.r, self.rmu, self.rab = r, rmu, rab


class Selection:
    """Expected number density: at points of a column (constant), or joined to rows (of a mask and a radial profile)."""

    def __init__(self, density: Num | None = None, radial: DataFrame | None = None, mask: DataFrame | None = None, nside: int = 0, nested: bool = False):
        self.density, self.radial, self.mask, self.nside, self.nested = density, radial, mask, nside, nested

    def evaluate(self, points: DataFrame, out: str = "nbar", axes: tuple[str, str, str] = ("r", "mu", "phi")) -> DataFrame:
        """points with the density there: a constant, or the mask's pixel times the radial spline."""
        if self.radial is None:
            return points.withColumn(out, col(self.density))
        r, mu, phi = axes
        pixel = (nest_pixel if self.nested else ring_pixel)(self.nside, F.col(mu), F.col(phi))
        mask = self.mask.select(F.col("ipix").alias("_ipix"), F.col("value").cast("double").alias("_mask"))
        small = F.broadcast if 12 * self.nside**2 <= BROADCAST_PIXELS else lambda d: d
        rows = lookup(points, r, self.radial, "_radial").withColumn("_ipix", pixel).join(small(mask), "_ipix", "left")
        return rows.withColumn(out, F.col("_radial") * F.coalesce("_mask", F.lit(0.0))).drop("_ipix", "_radial", "_mask")

    def over(self, cells: DataFrame, n: int, spherical: bool) -> DataFrame:
        """cells with nbar: the integral of the density over each, with n nodes an axis."""
        each = with_nodes(cells.select("g", *(f"{m}{k}" for k in (1, 2, 3) for m in ("min", "max"))), n)
        at = lambda k: F.col(f"min{k}") + F.col(f"t{k}") * (F.col(f"max{k}") - F.col(f"min{k}"))
        cube = lambda c: F.col(c) * F.col(c) * F.col(c)
        first = F.cbrt(cube("min1") + F.col("t1") * (cube("max1") - cube("min1"))) if spherical else at(1)
        side = (cube("max1") - cube("min1")) / 3.0 if spherical else F.col("max1") - F.col("min1")
        volume = side * (F.col("max2") - F.col("min2")) * (F.col("max3") - F.col("min3"))
        each = each.select("g", (F.col("t_weight") * volume).alias("w"), first.alias("r"), at(2).alias("mu"), at(3).alias("phi"))
        sums = self.evaluate(each, "n").groupBy("g").agg(F.sum(F.col("w") * F.col("n")).alias("nbar"))
        return cells.join(sums, "g")


class Survey:
    """What surveys share: three axes with bounds and numbers of bins."""

    spherical = False
    axes: tuple[str, str, str] = ("x", "y", "z")
    names: tuple[str, str, str] = ("X", "Y", "Z")
    counts: tuple[str, str, str] = ("Nx", "Ny", "Nz")

    def __init__(self, spark: SparkSession, config: dict[str, str]):
        cf.require(config, *(f"{a}{e}" for a in self.names for e in ("Min", "Max")), *self.counts)
        self.spark, self.config = spark, config
        self.lo = tuple(float(config[f"{a}Min"]) for a in self.names)
        self.hi = tuple(float(config[f"{a}Max"]) for a in self.names)
        self.n = tuple(int(config[c]) for c in self.counts)
        for a, lo, hi, n in zip(self.names, self.lo, self.hi, self.n, strict=True):
            if not lo < hi or n < 1:
                raise ValueError(f"{a}: {n} bins from {lo} to {hi}")

    @property
    def grid(self) -> Grid:
        return Grid(self.lo, self.hi, self.n, self.spherical)

    def options(self) -> dict[str, object]:
        """The configuration, as it goes into file headers."""
        return {f"{a}{e}": v for a, lo, hi in zip(self.names, self.lo, self.hi, strict=True) for e, v in (("Min", lo), ("Max", hi))} | dict(zip(self.counts, self.n, strict=True))

    def galaxies(self) -> DataFrame:
        """(id, the three axes, w)"""
        return loaders.read_galaxies(self.spark, self.config["galfile"], self.spherical)

    def separation(self) -> Separation:
        raise NotImplementedError

    def selection(self) -> Selection:
        raise NotImplementedError


@survey("box")
class BoxSurvey(Survey):
    """A periodic box of side L with a constant density nbar."""

    def __init__(self, spark: SparkSession, config: dict[str, str]):
        super().__init__(spark, config)
        cf.require(config, "galfile", "nbar", "L")
        self.nbar, self.size = float(config["nbar"]), float(config["L"])

    def separation(self) -> Separation:
        size = self.size
        return Separation(lambda p, q: g.box_separation(p, q, size), lambda p, q: g.box_rmu(p, q, size), lambda p, q: g.box_rab(p, q, size))

    def selection(self) -> Selection:
        return Selection(self.nbar)

    def options(self) -> dict[str, object]:
        return super().options() | {"galfile": self.config["galfile"], "nbar": self.nbar, "L": self.size}


@survey("spherical")
class SphericalSurvey(Survey):
    """A part of the sky: a mask of pixels times a radial profile."""

    spherical = True
    axes = ("r", "mu", "phi")
    names = ("R", "Mu", "Phi")
    counts = ("Nr", "Nmu", "Nphi")

    def __init__(self, spark: SparkSession, config: dict[str, str]):
        super().__init__(spark, config)
        cf.require(config, "galfile", "maskfile", "radial")

    def separation(self) -> Separation:
        return Separation(g.sky_separation, g.sky_rmu, g.sky_rab)

    def selection(self) -> Selection:
        mask, nside, order = tables.read_map(self.spark, self.config["maskfile"])
        if order not in ("NESTED", "RING"):
            raise ValueError(f"unknown order of pixels: {order}")
        rows = tables.read_columns(self.spark, self.config["radial"], r=1, nbar=2).orderBy("r").toArrow()  # a function of one variable
        radial = spline_frame(self.spark, spline_table(rows.column("r").to_pylist(), rows.column("nbar").to_pylist()))
        return Selection(radial=radial, mask=mask, nside=nside, nested=order == "NESTED")

    def options(self) -> dict[str, object]:
        return super().options() | {k: self.config[k] for k in ("galfile", "maskfile", "radial")}
