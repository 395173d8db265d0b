"""The estimator as one lazy plan: cells, signal, modes, pixels, derivatives, band powers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Model
from ..operators import matrices as mx
from ..operators.grid import Grid, amplitudes, cell_counts, number_cells, overdensity
from ..operators.signal import cell_integral, signal_matrices


@dataclass
class Estimator:
    """Stages in order; each is a DataFrame of the ones before.  density gives the expected number density at a point."""

    points: DataFrame
    grid: Grid
    density: object
    model: Model
    n_modes: int
    nodes: int = 3
    weight: str = "w"
    solver: str | None = None

    def basis(self) -> DataFrame:
        cells = cell_integral(self.grid.cells(self.points.sparkSession), self.density, self.nodes, self.grid.spherical)
        return number_cells(cells)

    def signals(self, cells: DataFrame) -> DataFrame:
        """(m, i, j, v): the signal matrix as m = 0, then its derivative by each parameter, all from one pass."""
        deriv = lambda m: (lambda r, mu: self.model.xi_deriv(m, r, mu)) if self.anisotropic else (lambda r: self.model.xi_deriv(m, r))
        return signal_matrices(cells, [self.model.xi, *map(deriv, range(self.model.n_params))], self.nodes, spherical=self.grid.spherical)

    @property
    def anisotropic(self) -> bool:
        """Whether the model depends on the angle to the line of sight too."""
        return getattr(self.model, "anisotropic", False)

    def run(self, kind: str = "inverse", bias: str = "residual") -> dict[str, np.ndarray]:
        """phat, cov, fisher, window, mixing, q and bias.  bias='noise' takes the noise matrix in place of the residual."""
        cells = self.basis().persist()
        n = cells.count()
        signals = self.signals(cells).persist()
        evals, modes = mx.top_modes(signals.where("m = 0").drop("m"), n, min(self.n_modes, n), self.solver)
        return estimates(evals, modes, signals, self.pixels(cells, modes).persist(), self.model, kind, bias)

    def pixels(self, cells: DataFrame, modes: DataFrame) -> DataFrame:
        axes = ("r", "mu", "phi") if self.grid.spherical else ("x", "y", "z")
        return amplitudes(overdensity(cell_counts(self.points, cells, self.grid, axes, self.weight), cells), modes)


def derivatives(modes: DataFrame, signals: DataFrame, n_params: int) -> DataFrame:
    """(m, i, j, v): the derivatives of the covariance of the modes, packed (i <= j)."""
    out = None
    for m in range(n_params):
        d = mx.project(modes, signals.where(F.col("m") == m + 1).drop("m")).select(F.lit(m).cast("long").alias("m"), "i", "j", "v")
        out = d if out is None else out.unionByName(d)
    return out


def estimates(evals: DataFrame, modes: DataFrame, signals: DataFrame, y: DataFrame, model: Model, kind: str, bias: str) -> dict[str, np.ndarray]:
    return from_derivatives(evals, derivatives(modes, signals, model.n_params).persist(), y, [float(model.param(m)) for m in range(model.n_params)], kind, bias)


def from_derivatives(evals: DataFrame, derivs: DataFrame, y: DataFrame, prior: list[float], kind: str = "inverse", bias: str = "residual") -> dict[str, np.ndarray]:
    """Band powers from eigenvalues, packed derivatives, amplitudes (i, y) and the parameters that the signal was made with."""
    spark, p = evals.sparkSession, len(prior)
    params = spark.createDataFrame(list(enumerate(prior)), "m long, p double")
    f, q, b = mx.parameters(derivs, evals, y, params, p)
    if bias != "residual":
        b = mx.small(mx.bias(derivs, evals, evals.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))), p, "m", "b")
    return mx.estimate(f, q, b, kind)
