"""Arrays of numbers as columns: made, combined element by element, reshaped and reduced."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Num, col


def filled(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def zeros(n: int) -> Column:
    return filled(n, 0.0)


def ones(n: int) -> Column:
    return filled(n, 1.0)


def linspace(lo: float, hi: float, n: int) -> Column:
    """n equal steps from lo to hi, both included."""
    step = (hi - lo) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * F.lit(step))


def logspace(lo: float, hi: float, n: int) -> Column:
    """n equal steps of the logarithm from lo to hi, both included."""
    return F.transform(linspace(math.log(lo), math.log(hi), n), F.exp)


def each(a: Column, b: Column | Num, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements of a and those of b, or of the number b; arrays of unequal lengths give null."""
    if not isinstance(b, Column):
        return F.transform(a, lambda x: f(x, col(b)))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def add(a: Column, b: Column | Num) -> Column:
    return each(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column | Num) -> Column:
    return each(a, b, lambda x, y: x - y)


def times(a: Column, b: Column | Num) -> Column:
    return each(a, b, lambda x, y: x * y)


def over(a: Column, b: Column | Num) -> Column:
    return each(a, b, F.try_divide)


def scaled(a: Column, x: Column) -> Column:
    """a times one number, a column."""
    return F.transform(a, lambda v: v * x)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def reshaped(a: Column, rows: int, columns: int) -> Column:
    """An array of rows; null if the number of elements is another."""
    rows_of = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * columns + 1, columns))
    return F.when(F.size(a) == rows * columns, rows_of)
