"""Bounding boxes as columns x0, y0, x1, y1; both corners belong to the box (closed pixel boxes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return (b[2] - b[0] + 1) * (b[3] - b[1] + 1)


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union by pixel areas."""
    i = intersection(a, b)
    return i / (area(a) + area(b) - i)


def scale(b: Box, by: float, width: int, height: int) -> Box:
    """Grown about the centre by a factor and clipped to the image."""
    dx, dy = (b[2] - b[0]) * (by - 1) / 2, (b[3] - b[1]) * (by - 1) / 2
    return (
        F.greatest(F.floor(b[0] - dx), F.lit(0)).cast("int"), F.greatest(F.floor(b[1] - dy), F.lit(0)).cast("int"),
        F.least(F.ceil(b[2] + dx), F.lit(width - 1)).cast("int"), F.least(F.ceil(b[3] + dy), F.lit(height - 1)).cast("int"),
    )


def contains(b: Box, x: Column, y: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])
