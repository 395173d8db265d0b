"""The steps of the estimate and of mocks as programs: a configuration in, files out.

make_cells, find_modes, derive, measure and estimate each read what those before wrote (record
blocks); run_all is all five.  Matrices stay in the tasks: only what a file
holds is brought together, and that block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.special import spline_frame, spline_table
from ..operators import matrices as mx
from ..operators import mock, pairs
from ..operators.grid import amplitudes, cell_counts, cic_deposit, contrast, fft, number_cells, overdensity, power
from ..operators.signal import signal_matrices
from ..sources import config as cf
from ..sources import loaders, tables
from . import survey
from .estimator import derivatives, from_derivatives


def make_cells(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """Cells of the survey's grid with galaxies expected in them, to cellfile."""
    cf.require(config, "cellfile")
    s = survey.make(spark, config)
    cells = number_cells(s.selection().over(s.grid.cells(spark), int(config.get("nodes", 4)), s.spherical))
    loaders.write_cells(config["cellfile"], cells, **s.options())
    return cells


def _cells(spark: SparkSession, config: dict[str, str]) -> tuple[DataFrame, bool]:
    cells = loaders.read_cells(spark, config["cellfile"])
    return cells, survey.make(spark, config).spherical


def find_modes(spark: SparkSession, config: dict[str, str]) -> None:
    """The Nmodes largest modes of the signal matrix, to modefile and evalfile; solver: dense or krylov, by default by size."""
    cf.require(config, "cellfile", "Nmodes", "modefile", "evalfile")
    cells, spherical = _cells(spark, config)
    n, k = cells.count(), int(config["Nmodes"])
    if k > n:
        raise ValueError(f"{k} modes of {n} cells")
    solver = config.get("solver")
    if solver is not None:
        cf.choice(config, "solver", mx.SOLVERS)
    model = models.make(config)
    signal = signal_matrices(cells, [model.xi], int(config.get("nodes", 3)), spherical=spherical).drop("m")
    evals, modes = mx.top_modes(signal, n, k, solver)
    loaders.write_modes(config["modefile"], modes, k, n)
    loaders.write_series(config["evalfile"], evals, "lambda", Nmodes=k)


def derive(spark: SparkSession, config: dict[str, str]) -> None:
    """Derivatives of the modes' covariance by each parameter, packed, to covfile."""
    cf.require(config, "cellfile", "modefile", "covfile")
    cells, spherical = _cells(spark, config)
    modes, n, _ = loaders.read_modes(spark, config["modefile"])
    model = models.make(config)
    two = getattr(model, "anisotropic", False)
    deriv = lambda m: (lambda r, mu: model.xi_deriv(m, r, mu)) if two else (lambda r: model.xi_deriv(m, r))
    signals = signal_matrices(cells, [deriv(m) for m in range(model.n_params)], int(config.get("nodes", 3)), spherical=spherical)
    shifted = signals.withColumn("m", F.col("m") + 1).persist()
    loaders.write_covariance(config["covfile"], derivatives(modes, shifted, model.n_params), n, model.n_params)
    shifted.unpersist()


def measure(spark: SparkSession, config: dict[str, str]) -> None:
    """Amplitudes of the modes in the survey's galaxies, to pixfile."""
    cf.require(config, "cellfile", "modefile", "pixfile")
    s = survey.make(spark, config)
    cells = loaders.read_cells(spark, config["cellfile"])
    grid = s.grid
    d = [F.col(f"d{k}") for k in (1, 2, 3)]
    cells = cells.withColumn("g", (d[0] * grid.n[1] + d[1]) * grid.n[2] + d[2])
    modes, n, _ = loaders.read_modes(spark, config["modefile"])
    y = amplitudes(overdensity(cell_counts(s.galaxies(), cells, grid, s.axes), cells), modes)
    loaders.write_series(config["pixfile"], y, "y", Nmodes=n)


def estimate(spark: SparkSession, config: dict[str, str]) -> dict[str, DataFrame]:
    """Band powers from evalfile, covfile and pixfile, to estfile; mixing: inverse, root or identity."""
    cf.require(config, "evalfile", "covfile", "pixfile", "estfile")
    model = models.make(config)
    derivs, n, p = loaders.read_covariance(spark, config["covfile"])
    if p != model.n_params:
        raise ValueError(f"{config['covfile']}: {p} parameters, the model has {model.n_params}")
    evals = loaders.read_series(spark, config["evalfile"], "lambda", Nmodes=n)
    y = loaders.read_series(spark, config["pixfile"], "y", Nmodes=n)
    kind = cf.choice(config, "mixing", ("inverse", "root", "identity"), "inverse")
    got = from_derivatives(evals, derivs.persist(), y, [float(model.param(m)) for m in range(p)], kind, cf.choice(config, "bias", ("residual", "noise"), "residual"))
    loaders.write_estimate(spark, config["estfile"], got)
    return loaders.read_estimate(spark, config["estfile"])


def run_all(spark: SparkSession, config: dict[str, str]) -> dict[str, DataFrame]:
    """A configuration to band powers: (i, v) or (i, j, v) of each result."""
    make_cells(spark, config)
    find_modes(spark, config)
    derive(spark, config)
    measure(spark, config)
    return estimate(spark, config)


def _spectrum(spark: SparkSession, config: dict[str, str]):
    """P(k) of a text file (columns k, p) as a function of a column, or of the power law A k**n exp(-k / k0)."""
    if "pkfile" not in config:
        a, n, k0 = (float(config.get(key, default)) for key, default in (("A", 1e4), ("slope", 1.0), ("k0", 0.05)))
        return lambda k: F.lit(a) * F.pow(k, F.lit(n)) * F.exp(-k / F.lit(k0))
    rows = tables.read_columns(spark, config["pkfile"], k=1, p=2).orderBy("k").toArrow()  # a function of one variable
    table = spline_table(rows.column("k").to_pylist(), rows.column("p").to_pylist())
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("lo", "hi", "a", "b"), r, strict=False))) for r in table))
    return lambda k: F.aggregate(steps, F.lit(0.0), lambda s, r: F.when((k >= r["lo"]) & (k < r["hi"]), r["a"] + (k - r["lo"]) * r["b"]).otherwise(s))


def mock_catalogue(spark: SparkSession, config: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
    """(points, spectrum): a mock catalogue (id, x, y, z, vx, vy, vz) of a Gaussian field, and with kmax its measured power in `bins` bins.

    Keys: N nodes an axis, L side, nbar, seed, and b (bias), f (growth), R (smoothing), pkfile.
    """
    cf.require(config, "N", "L", "nbar")
    n, size, seed = int(config["N"]), float(config["L"]), int(config.get("seed", 1))
    field = mock.modes(spark, n, size, _spectrum(spark, config), seed, float(config.get("R", 0.0))).persist()
    rho = mock.density(field, n, float(config["nbar"]), float(config.get("b", 1.0)))
    speed = {f"v{'xyz'[k]}": mock.velocity(field, n, size, float(config["f"]), k) for k in range(3)} if "f" in config else {}
    points = mock.sample_between(rho, n, size, seed, speed)
    if "kmax" not in config:
        return points, None
    delta = contrast(cic_deposit(points.withColumn("w", F.lit(1.0)), n, size), n).select("ix", "iy", "iz", F.col("delta").alias("re"), F.lit(0.0).alias("im"))
    return points, power(fft(delta, n), n, size, int(config.get("bins", 10)), float(config["kmax"]), 1 / float(config["nbar"]))


def mock_correlation(spark: SparkSession, config: dict[str, str]) -> tuple[DataFrame, int, bool]:
    """(i1, xi0, xi2, xi4), samplings and whether they agreed: the correlation of mocks of one field, by new points until five samplings in a row agree.

    Keys: as mock_catalogue, and smin, smax, nsbins, nmubins, maxsamp, epsrel and epsabs.
    """
    cf.require(config, "N", "L", "nbar", "smax")
    n, size, seed = int(config["N"]), float(config["L"]), int(config.get("seed", 1))
    field = mock.modes(spark, n, size, _spectrum(spark, config), seed, float(config.get("R", 0.0)))
    rho = mock.density(field, n, float(config["nbar"]), float(config.get("b", 1.0))).persist()
    many = max(1, round(float(config["nbar"]) * size**3))
    draw = lambda k: (mock.sample_between(rho, n, size, seed + 1000 + k).persist(), mock.uniform_catalogue(spark, many, size, seed + 5000 + k))
    eps = (float(config.get("epsabs", 1e-4)), float(config.get("epsrel", 1e-2)))
    return pairs.converge(draw, int(config.get("nmubins", 64)), float(config.get("smin", 3.0)), float(config["smax"]), int(config.get("nsbins", 39)), dict.fromkeys((0, 2, 4), eps), size, most=int(config.get("maxsamp", 1000)))


def mock_survey(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """(id, r, mu, phi) of a mock survey from galfile, maskfile and radial; Ngals are wanted."""
    cf.require(config, "galfile", "maskfile", "radial", "L", "Ngals")
    points = loaders.read_galaxies(spark, config["galfile"]).select("id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    mask, nside, order = tables.read_map(spark, config["maskfile"])
    if order == "NESTED":
        from ..functions.pixels import nest_centre, ring_pixel

        mask = mask.select(ring_pixel(nside, *nest_centre(nside, F.col("ipix"))).alias("ipix"), "value")
    rows = tables.read_columns(spark, config["radial"], r=1, nbar=2).orderBy("r").toArrow()
    radial = spline_frame(spark, spline_table(rows.column("r").to_pylist(), rows.column("nbar").to_pylist()))
    origin = tuple(cf.array(config, "origin")) if "origin" in config else (0.0, 0.0, 0.0)
    bounds = (float(config["RMin"]), float(config["RMax"])) if "RMin" in config and "RMax" in config else None
    return mock.realistic(points, float(config["L"]), radial, mask, nside, float(config["Ngals"]), int(config.get("seed", 1)), origin, bounds)
