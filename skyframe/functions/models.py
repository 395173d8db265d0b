"""Models of the two-point function: parameters, the function and its derivatives, as column expressions.

A model is any object with n_params, param(n), xi(r) and xi_deriv(n, r).
Register further ones with @model("name").
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Num, col, let
from .special import bessel, kaiser, legendre, test_xi


class Model(Protocol):
    n_params: int

    def param(self, n: int) -> float: ...
    def xi(self, *separation: Num) -> Column: ...
    def xi_deriv(self, n: int, *separation: Num) -> Column: ...


MODELS: dict[str, Callable[[dict[str, str]], Model]] = {}


def model(name: str):
    def add(cls):
        MODELS[name] = cls
        return cls

    return add


def make(config: dict[str, str]) -> Model:
    name = config["model"]
    if name not in MODELS:
        raise KeyError(f"no model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](config)


@model("test")
class TestModel:
    """A exp(-b r**2) with parameters A and b."""

    __test__ = False
    n_params = 2

    def __init__(self, config: dict[str, str]):
        self.p = [float(config.get("A", 1.0)), float(config.get("b", 0.01))]

    def param(self, n: int) -> float:
        return self.p[n]

    def xi(self, r: Num) -> Column:
        return test_xi(r, *self.p, "gauss")

    def xi_deriv(self, n: int, r: Num) -> Column:
        r = col(r)
        return (-r * r * self.p[0] if n else F.lit(1.0)) * F.exp(-self.p[1] * r * r)


def _transform(nodes: list[tuple[float, float]], order: int, r: Num) -> Column:
    """Sum of weight * k**2 * j_order(k r) over (k, weight) nodes; a loop over an array, so the expression stays small."""
    each = F.array(*(F.struct(F.lit(float(k)).alias("k"), F.lit(float(w * k * k)).alias("c")) for k, w in nodes))
    return F.aggregate(each, F.lit(0.0), lambda s, n: s + n["c"] * bessel(order, n["k"] * col(r)))


class _Bands:
    """Bands of k: explicit edges, or n equal ones of [kmin, kmax]."""

    def __init__(self, config: dict[str, str]):
        from ..sources.config import array

        if "bands" in config:
            e = array(config, "bands")
            self.edges = list(zip(e[::2], e[1::2], strict=True))
        else:
            n, a, b = int(config["n_bands"]), float(config["kmin"]), float(config["kmax"])
            self.edges = [(a + (b - a) * i / n, a + (b - a) * (i + 1) / n) for i in range(n)]
        self.n_params = len(self.edges)
        self.pk: Callable[[float], float] = lambda k: 1.0

    def param(self, n: int, points: int = 256) -> float:
        """Mean of P(k) at the midpoints of equal parts of the band."""
        a, b = self.edges[n]
        return sum(self.pk(a + (b - a) * (i + 0.5) / points) for i in range(points)) / points

    @staticmethod
    def band_xi(order: int, r: Num, a: float, b: float, points: int = 64) -> Column:
        """Integral of k**2 j_order(k r) / (2 pi**2) over a band of unit power, by Simpson's rule."""
        h = (b - a) / points
        nodes = [(a + h * i, (1 if i in (0, points) else 4 if i % 2 else 2) * h / 3 / (2 * math.pi**2)) for i in range(points + 1)]
        return _transform(nodes, order, r)


@model("real")
class RealModel(_Bands):
    """Band powers in real space."""

    def xi_deriv(self, n: int, r: Num) -> Column:
        return self.band_xi(0, r, *self.edges[n])

    def xi(self, r: Num) -> Column:
        return sum((self.param(n) * self.xi_deriv(n, r) for n in range(1, self.n_params)), self.param(0) * self.xi_deriv(0, r))


@model("kaiser")
class KaiserModel(_Bands):
    """Band powers of the multipoles 0, 2 and 4 along one line of sight: three parameters a band."""

    anisotropic = True

    def __init__(self, config: dict[str, str]):
        super().__init__(config)
        self.f = float(config.get("f", 0.5))
        self.n_bands, self.n_params = self.n_params, 3 * self.n_params

    def param(self, n: int, points: int = 256) -> float:
        f = self.f
        a = (1 + 2 * f / 3 + f * f / 5, 4 * f / 3 + 4 * f * f / 7, 8 * f * f / 35)
        return a[n // self.n_bands] * super().param(n % self.n_bands, points)

    def xi_deriv(self, n: int, r: Num, mu: Num) -> Column:
        order = 2 * (n // self.n_bands)
        sign = -1.0 if order == 2 else 1.0
        return sign * legendre(order, mu) * self.band_xi(order, r, *self.edges[n % self.n_bands])

    def xi(self, r: Num, mu: Num) -> Column:
        return sum((self.param(n) * self.xi_deriv(n, r, mu) for n in range(1, self.n_params)), self.param(0) * self.xi_deriv(0, r, mu))


# Linear wide-angle redshift distortions (Papai & Szapudi 2008); fixed values.  Each term: the angular function of the
# angles a (at the second point) and b (at the first), the powers of r / r1 and r / r2, the power of r that it is over,
# and for each xi_lm its coefficients of f**0, f**1 and f**2.
WIDE_ANGLE = [
    ("1", 0, 0, 0, {"02": (1, 2 / 3, 2 / 15)}),
    ("cos 2b", 0, 0, 0, {"22": (0, -1 / 2, -3 / 14), "42": (0, 0, 1 / 28)}),
    ("cos 2a", 0, 0, 0, {"22": (0, -1 / 2, -3 / 14), "42": (0, 0, 1 / 28)}),
    ("cos 2a cos 2b", 0, 0, 0, {"02": (0, 0, 1 / 15), "22": (0, 0, -1 / 21), "42": (0, 0, 19 / 140)}),
    ("cos b", 1, 0, 1, {"11": (0, 2, 4 / 5), "31": (0, 0, -1 / 5)}),
    ("cos a", 0, 1, 1, {"11": (0, 2, 4 / 5), "31": (0, 0, -1 / 5)}),
    ("cos a cos b", 1, 1, 2, {"00": (0, 0, -4 / 3), "20": (0, 0, 8 / 3)}),
    ("cos 2a cos b", 1, 0, 1, {"11": (0, 0, 2 / 5), "31": (0, 0, -3 / 5)}),
    ("cos a cos 2b", 0, 1, 1, {"11": (0, 0, 2 / 5), "31": (0, 0, -3 / 5)}),
    ("sin 2a sin 2b", 0, 0, 0, {"02": (0, 0, -1 / 15), "20": (0, 0, 1 / 21), "42": (0, 0, 4 / 35)}),
    ("sin a sin b", 1, 1, 2, {"00": (0, 0, 4 / 3), "20": (0, 0, 4 / 3)}),
    ("sin 2a sin b", 1, 0, 1, {"11": (0, 0, -2 / 5), "31": (0, 0, -2 / 5)}),
    ("sin a sin 2b", 0, 1, 1, {"11": (0, 0, -2 / 5), "31": (0, 0, -2 / 5)}),
]


def wide_angle(r: Num, r1: Num, r2: Num, f: float, xi: dict[str, Column], by_growth: bool = False) -> Column:
    """The correlation of two points at distances r1 and r2 from the observer, r apart, for a growth rate f; or its derivative by f.

    xi: the functions xi_lm of r as columns, named "00", "02", "11", "20", "22", "31" and "42".
    """
    r, r1, r2 = col(r), col(r1), col(r2)
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    def total(a: Column, b: Column, g1: Column, g2: Column, r: Column, *functions: Column) -> Column:
        known = dict(zip(sorted(xi), functions, strict=True))
        sine = lambda c: F.sqrt(1 - c * c)
        angle = {"1": F.lit(1.0)} | {f"cos {n}": c for n, c in (("a", a), ("b", b), ("2a", 2 * a * a - 1), ("2b", 2 * b * b - 1))}
        angle |= {f"sin {n}": c for n, c in (("a", sine(a)), ("b", sine(b)), ("2a", 2 * a * sine(a)), ("2b", 2 * b * sine(b)))}
        out = F.lit(0.0)
        for shape, p1, p2, p, terms in WIDE_ANGLE:
            part = F.lit(0.0)
            for name, c in terms.items():
                factor = c[1] + 2 * f * c[2] if by_growth else c[0] + f * c[1] + f * f * c[2]
                part = part + F.lit(float(factor)) * known[name]
            words = shape.split(" ")
            for w in [" ".join(words[k : k + 2]) for k in range(0, len(words), 2)]:
                part = part * angle[w]
            for factor, power in ((g1, p1), (g2, p2), (1 / r, p)):
                part = part * factor if power == 1 else part * factor * factor if power == 2 else part
            out = out + part
        return out

    values = {"a": clamp((r * r + r2 * r2 - r1 * r1) / (2 * r * r2)), "b": clamp((r * r + r1 * r1 - r2 * r2) / (2 * r * r1)), "g1": r / r1, "g2": r / r2, "r": r}
    return let(total, **values, **{f"xi{k}": xi[k] for k in sorted(xi)})


@model("bins")
class BinModel:
    """The function is constant in bins of r."""

    def __init__(self, config: dict[str, str]):
        from ..sources.config import array

        self.edges, self.p = array(config, "edges"), array(config, "values")
        self.n_params = len(self.p)

    def param(self, n: int) -> float:
        return self.p[n]

    def xi_deriv(self, n: int, r: Num) -> Column:
        return F.when((col(r) >= self.edges[n]) & (col(r) < self.edges[n + 1]), 1.0).otherwise(0.0)

    def xi(self, r: Num) -> Column:
        return sum((self.p[n] * self.xi_deriv(n, r) for n in range(1, self.n_params)), self.p[0] * self.xi_deriv(0, r))


@model("knots")
class KnotModel(_Bands):
    """P(k) is linear between knots: parameters are its values there, derivatives are transforms of tents."""

    def __init__(self, config: dict[str, str]):
        from ..sources.config import array

        self.knots = array(config, "knots")
        self.n_params = len(self.knots) - 2
        self.pk = lambda k: 1.0

    def param(self, n: int, points: int = 256) -> float:
        return self.pk(self.knots[n + 1])

    def xi_deriv(self, n: int, r: Num, points: int = 64) -> Column:
        lo, mid, hi = self.knots[n : n + 3]
        h, nodes = (hi - lo) / points, []
        for i in range(1, points):
            k = lo + h * i
            t = (k - lo) / (mid - lo) if k <= mid else (hi - k) / (hi - mid)
            nodes.append((k, (4 if i % 2 else 2) * t * h / 3 / (2 * math.pi**2)))
        return _transform(nodes, 0, r)

    def xi(self, r: Num) -> Column:
        return sum((self.param(n) * self.xi_deriv(n, r) for n in range(1, self.n_params)), self.param(0) * self.xi_deriv(0, r))


__all__ = ["MODELS", "BinModel", "KaiserModel", "KnotModel", "Model", "RealModel", "TestModel", "kaiser", "make", "model"]
