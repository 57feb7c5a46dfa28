"""Axis-aligned rectangles as structs (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 if they don't meet."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's area that lies in b; 0 for an empty rectangle."""
    return F.when(area(a) > 0, shared_area(a, b) / area(a)).otherwise(0.0)


def covers_half(a: Column, b: Column) -> Column:
    """Whether they share half the smaller one's area."""
    smaller = F.least(area(a), area(b))
    return (shared_area(a, b) > 0) & (smaller > 0) & (shared_area(a, b) >= 0.5 * smaller)
