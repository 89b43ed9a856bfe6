"""Box geometry as plain expressions.  A box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "", of: str = "") -> Box:
    name = f"{of}." if of else ""
    return Box(*[F.col(f"{name}{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b.x1 - b.x0) * F.greatest(F.lit(0), b.y1 - b.y0)


def is_zero(b: Box) -> Column:
    return (b.x0 == 0) & (b.y0 == 0) & (b.x1 == 0) & (b.y1 == 0)


def overlap(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return overlap(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def overlap_of(a: Box, b: Box) -> Column:
    """Share of b that a covers."""
    return F.when(area(b) > 0, overlap(a, b) / area(b)).otherwise(F.lit(0.0))


def centre_gap(a: Box, b: Box) -> tuple[Column, Column]:
    return (a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, (a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2


def distance(a: Box, b: Box) -> Column:
    dx, dy = centre_gap(a, b)
    return F.sqrt(dx * dx + dy * dy)


def to_pixels(points: Column, dpi: int = 150) -> Column:
    return points * dpi / 72


def normalised(b: Box, width: Column, height: Column) -> Box:
    """Boxes that overshoot the page by over a tenth are scaled back into it."""
    scale = F.greatest(b.x1 / width, b.y1 / height)
    fit = lambda v: F.when(scale > 1.1, v / scale).otherwise(v.cast("double"))
    return Box(*map(fit, b))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges lies to the right of the point."""
    inside = F.lit(False)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi == yj:
            continue
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
        inside = inside != crosses
    return inside


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG from its header; null for anything else."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    at = lambda p: F.when(png, F.conv(F.hex(F.substring(content, p, 4)), 16, 10).cast("int"))
    return at(17), at(21)
