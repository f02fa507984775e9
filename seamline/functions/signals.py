"""Intensity profiles along a line, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in the brightness; colour of each decision.
LUMA = (0.299, 0.587, 0.114)
COLOURS = {"승인": "green", "재검사": "amber", "보수": "red"}


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of pixels given as three arrays."""
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: LUMA[0] * p["r"] + LUMA[1] * p["g"] + LUMA[2] * p["b"])


def half_width(values: Column, width: Column) -> Column:
    """Width of the deepest dip at half its depth (the depth counts as 1 at least), out
    of a profile that is `width` long; null below two values."""
    last, low = F.size(values) - 1, F.array_min(values)
    half = low + F.greatest(F.array_max(values) - low, F.lit(1.0)) / 2
    at = (F.array_position(values, low) - 1).cast("int")
    high = lambda lo, hi: F.filter(F.sequence(lo, hi), lambda i: F.get(values, i) >= half)
    left = F.coalesce(F.array_max(high(F.lit(0), at)), F.lit(0))
    right = F.coalesce(F.array_min(high(at, last)), last)
    return F.when(F.size(values) > 1, (right - left) / last * width)


def marker(place: Column) -> Column:
    """Place of a marker in percent, one decimal, kept off the edges."""
    return F.least(F.greatest(F.round(place, 1), F.lit(2.0)), F.lit(98.0))


def colour(decision: Column) -> Column:
    out = F
    for name, value in COLOURS.items():
        out = out.when(decision == name, value)
    return out
