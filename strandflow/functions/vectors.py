"""Vector expressions on array columns (evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def centre(v: Column) -> Column:
    """Minus the vector's own mean."""
    return F.transform(v, lambda x: x - F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v))


def rounded(v: Column, places: int = 6) -> Column:
    """Halves go up, by the value times 10 to the places in double precision."""
    by = float(10**places)
    return F.transform(v, lambda x: F.floor(x * by + 0.5) / by)


def heads(v: Column, chosen: list[int], width: int, unit: bool = False) -> Column:
    """Concatenation of the chosen heads of `width` values each, every one of unit length with `unit`."""
    parts = (F.slice(v, h * width + 1, width) for h in chosen)
    return F.concat(*(normalise(p) if unit else p for p in parts))


def length_correction(a: Column, b: Column) -> Column:
    """1 - |0.5 - a / (a + b)|"""
    return 1 - F.abs(0.5 - a / (a + b))
