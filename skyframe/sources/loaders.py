"""Typed readers and writers of the estimator's files, on record blocks.

Each reader checks the block's format and its count against the options.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.matrices import unpack
from .blocks import headers, letters, read_blocks, write_blocks

#: Names of a cell's columns after its formats (fixed values).
CELL = "a,d1,d2,d3,min1,max1,min2,max2,min3,max3,veff,nbar"
#: The blocks of an estimate, in order, and whether each is a matrix.
ESTIMATE = [("phat", False), ("cov", True), ("fisher", True), ("window", True), ("mixing", True), ("q", False), ("bias", False)]


def _head(path: str, fmt: str, block: int = 0, **counts: int | None) -> dict:
    """The header of a block of that format; counts: options that must be there, with their values where known."""
    head = headers(path)[block]
    if letters(head["format"]) != letters(fmt):
        raise ValueError(f"{path}: format {head['format']} is not {fmt}")
    for key, value in counts.items():
        if key not in head["options"]:
            raise ValueError(f"{path}: no {key}")
        if value is not None and int(head["options"][key]) != value:
            raise ValueError(f"{path}: {key} is {head['options'][key]}, not {value}")
    return head


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(a, d1 ... d3, bounds, veff, nbar); as many as the option Ncells says."""
    head = _head(path, "4i8d", Ncells=None)
    if head["n"] != int(head["options"]["Ncells"]):
        raise ValueError(f"{path}: {head['n']} cells, not {head['options']['Ncells']}")
    return read_blocks(spark, path, CELL).drop("pos").withColumns({c: F.col(c).cast("long") for c in ("a", "d1", "d2", "d3")})


def write_cells(path: str, cells: DataFrame, **options: object) -> None:
    ints = [F.col(c).cast("int").alias(c) for c in CELL.split(",")[:4]]
    df = cells.select(F.col("a").alias("pos"), *ints, *CELL.split(",")[4:])
    write_blocks(path, [(df, "4i8d", {"Ncells": cells.count(), **options})])


def read_galaxies(spark: SparkSession, path: str, spherical: bool = False) -> DataFrame:
    """(id, three coordinates, w) of a catalogue of four floats, or of three (w = 1)."""
    head = headers(path)[0]
    names = ["r", "mu", "phi"] if spherical else ["x", "y", "z"]
    if letters(head["format"]) == ["f"] * 4:
        return read_blocks(spark, path, ",".join([*names, "w"])).withColumnRenamed("pos", "id")
    if letters(head["format"]) == ["f"] * 3:
        return read_blocks(spark, path, ",".join(names)).withColumnRenamed("pos", "id").withColumn("w", F.lit(1.0).cast("float"))
    raise ValueError(f"{path}: format {head['format']} is no catalogue")


def read_modes(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((i, a, v), number of modes, number of cells): a mode's values follow each other."""
    head = _head(path, "d", Nmodes=None, Ncells=None)
    n, cells = int(head["options"]["Nmodes"]), int(head["options"]["Ncells"])
    if head["n"] != n * cells:
        raise ValueError(f"{path}: {head['n']} values are not {n} modes of {cells} cells")
    return read_blocks(spark, path, "v").select(F.floor(F.col("pos") / cells).alias("i"), (F.col("pos") % cells).alias("a"), "v"), n, cells


def write_modes(path: str, modes: DataFrame, n: int, cells: int) -> None:
    write_blocks(path, [(modes.select((F.col("i") * cells + F.col("a")).alias("pos"), "v"), "d", {"Nmodes": n, "Ncells": cells})])


def read_series(spark: SparkSession, path: str, name: str, **counts: int | None) -> DataFrame:
    """(i, name): eigenvalues, pixels or any list of numbers."""
    _head(path, "d", **counts)
    return read_blocks(spark, path, name).withColumnRenamed("pos", "i")


def write_series(path: str, df: DataFrame, name: str, **options: object) -> None:
    write_blocks(path, [(df.select(F.col("i").alias("pos"), name), "d", options)])


def read_covariance(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((m, i, j, v) with i <= j, number of modes, number of parameters) of packed or full matrices, one after another."""
    head = _head(path, "d", Nmodes=None, Nparams=None)
    n, p = int(head["options"]["Nmodes"]), int(head["options"]["Nparams"])
    packed = int(head["options"].get("packed", 1)) == 1
    size = n * (n + 1) // 2 if packed else n * n
    if head["n"] != size * p:
        raise ValueError(f"{path}: {head['n']} values are not {p} matrices of order {n}")
    df = read_blocks(spark, path, "v").select(F.floor(F.col("pos") / size).alias("m"), (F.col("pos") % size).alias("k"), "v")
    i, j = unpack(F.col("k")) if packed else (F.floor(F.col("k") / n), F.col("k") % n)
    return df.select("m", i.alias("i"), j.alias("j"), "v").where("i <= j"), n, p


def write_covariance(path: str, derivs: DataFrame, n: int, p: int) -> None:
    at = F.col("m") * (n * (n + 1) // 2) + (F.col("j") * (F.col("j") + 1) / 2).cast("long") + F.col("i")
    write_blocks(path, [(derivs.select(at.alias("pos"), "v"), "d", {"Nmodes": n, "Nparams": p, "packed": 1})])


def write_estimate(spark: SparkSession, path: str, estimate: dict[str, np.ndarray]) -> None:
    """The seven blocks of an estimate, each with its number of parameters."""
    n = len(estimate["phat"])
    frames = [spark.createDataFrame(pa.table({"pos": np.arange(estimate[k].size), "v": np.ascontiguousarray(estimate[k], float).ravel()})) for k, _ in ESTIMATE]
    write_blocks(path, [(df, "d", {"Nparams": n, "name": k}) for df, (k, _) in zip(frames, ESTIMATE, strict=True)])


def read_estimate(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each block of an estimate: (i, v), or (i, j, v) of a matrix."""
    out = {}
    for k, (name, matrix) in enumerate(ESTIMATE):
        n = int(_head(path, "d", k, Nparams=None)["options"]["Nparams"])
        df = read_blocks(spark, path, "v", block=k)
        out[name] = df.select(F.floor(F.col("pos") / n).alias("i"), (F.col("pos") % n).alias("j"), "v") if matrix else df.withColumnRenamed("pos", "i")
    return out


def read_survey_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, r, mu, phi, w) of a survey's text catalogue: index, sector, region, right ascension and declination in degrees, velocity in km/s, and two columns that are not used.

    Distances are in Mpc/h for the standard density parameters; the weight is 1.
    """
    from .tables import read_columns

    rows = read_columns(spark, path, indx=1, ra=4, dec=5, cz=6, selectfn=8).where("selectfn is not null")
    return rows.select(F.col("indx").cast("long").alias("id"), comoving_distance("cz").alias("r"), F.sin(F.radians("dec")).alias("mu"), F.radians("ra").alias("phi"), F.lit(1.0).alias("w"))


def comoving_distance(cz: str, step: float = 0.001) -> F.Column:
    """Distance in Mpc/h of a velocity in km/s, by trapezoids of `step` in redshift, the last one shorter.

    The sums up to the steps below a redshift of 10 are a table of numbers in
    the plan, looked up by the step; farther points add their own.
    """
    edges = np.arange(0, 10_001) * step
    inverse = 1 / np.sqrt(0.272 * (1 + edges) ** 3 + 0.728)
    table = np.concatenate([[0.0], np.cumsum(step * (inverse[1:] + inverse[:-1]) / 2)])

    def total(z: F.Column, n: F.Column) -> F.Column:
        own = F.least(n, F.lit(10_000))
        far = F.aggregate(F.when(n > 10_000, F.sequence(F.lit(10_000), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.lit(step / 2) * (1 / g.hubble(k * F.lit(step)) + 1 / g.hubble((k + 1) * F.lit(step))))
        z0 = n * F.lit(step)
        return F.get(F.lit(table.tolist()), own) + far + (z - z0) / 2 * (1 / g.hubble(z0) + 1 / g.hubble(z))

    z = F.col(cz) / F.lit(299792.458)
    distance = g.let(total, z=z, n=F.floor(z / F.lit(step)).cast("int"))
    return F.when(z > 0, distance * F.lit(2997.92458)).otherwise(0.0)


#: The header of a particle file: a flag that is 1, the size of what follows, counts of all, gas and star particles, scale factor, softening (fixed values).
PARTICLE_HEAD = np.dtype([("flag", "<i4"), ("size", "<i4"), ("npart", "<i4"), ("nsph", "<i4"), ("nstar", "<i4"), ("aa", "<f4"), ("softlen", "<f4")])


def read_particles(spark: SparkSession, path: str, size: float, per_task: int = 1_000_000) -> DataFrame:
    """(id, x, y, z, vx, vy, vz) of an N-body file: the header, all positions, then all velocities, as float32 in units of the box; here in units of its `size`.

    Tasks read ranges of particles; the driver reads the header only.
    """
    with Path(path).open("rb") as f:
        raw = f.read(PARTICLE_HEAD.itemsize)
    if len(raw) < PARTICLE_HEAD.itemsize or (head := np.frombuffer(raw, PARTICLE_HEAD)[0])["flag"] != 1:
        raise ValueError(f"{path}: the endian flag is not 1")
    if head["size"] != PARTICLE_HEAD.itemsize - 8:
        raise ValueError(f"{path}: a header of {head['size']} bytes")
    n, start = int(head["npart"]), PARTICLE_HEAD.itemsize
    if Path(path).stat().st_size < start + 24 * n:
        raise ValueError(f"{path}: shorter than its {n} particles")

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                many = min(per_task, n - first)
                parts = []
                with Path(path).open("rb") as f:
                    for at in (start + 12 * first, start + 12 * (n + first)):
                        f.seek(at)
                        parts.append(np.frombuffer(f.read(12 * many), "<f4").reshape(many, 3).astype(float) * size)
                yield pa.record_batch([pa.array(np.arange(first, first + many)), *(pa.array(p[:, k]) for p in parts for k in range(3))], names=["id", "x", "y", "z", "vx", "vy", "vz"])

    tasks = max(1, -(-n // per_task))
    return spark.range(0, n, per_task, tasks).mapInArrow(run, "id long, x double, y double, z double, vx double, vy double, vz double")


def particles_in(particles: DataFrame, bounds: tuple[tuple[float, float], ...], spherical: bool = False, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), distorted: bool = False) -> DataFrame:
    """Particles within closed bounds, as a catalogue (id, three coordinates, w = 1); distorted: moved along the line of sight by their velocity."""
    xyz = ("x", "y", "z")
    if not spherical:
        return particles.where(g.inside_box(xyz, tuple(b[0] for b in bounds), tuple(b[1] for b in bounds))).select("id", *xyz, F.lit(1.0).alias("w"))
    place = [F.col(c) - F.lit(o) for c, o in zip(xyz, origin, strict=True)]
    if distorted:
        moved = g.redshift_radial(tuple(xyz), ("vx", "vy", "vz"), origin)
        place = [m - F.lit(o) for m, o in zip(moved, origin, strict=True)]
    r, mu, phi = g.to_sphere(*place)
    out = particles.select("id", r.alias("r"), mu.alias("mu"), F.pmod(phi, F.lit(2 * np.pi)).alias("phi"), F.lit(1.0).alias("w"))
    return out.where(g.inside_box(("r", "mu", "phi"), tuple(b[0] for b in bounds), tuple(b[1] for b in bounds)))
