"""Column builders for boxes, masks and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(reduce(lambda s, d: s + d, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


def overlap_1d(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Length that two half-open intervals share."""
    return F.greatest(F.least(high_a, high_b) - F.greatest(low_a, low_b), F.lit(0))


def box(center: Column, half: Column) -> tuple[Column, Column]:
    """The half-open interval of pixels around a truncated centre."""
    low = F.floor(center) - half
    return low, low + 2 * half + 1


def box_intersection(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Pixels that two boxes share, each a list of intervals by axis."""
    return reduce(lambda s, d: s * d, [overlap_1d(*p, *q) for p, q in zip(a, b, strict=True)])


def boxes_intersect(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    meets = [F.greatest(p[0], q[0]) < F.least(p[1], q[1]) for p, q in zip(a, b, strict=True)]
    return reduce(lambda s, d: s & d, meets)


def iou(intersection: Column, area_a: Column, area_b: Column) -> Column:
    """Intersection over union; 0 for what doesn't meet."""
    return F.when(intersection > 0, intersection / (area_a + area_b - intersection)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, d: s + d)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def inside_border(coords: list[Column], shape: list[int], border: list[float]) -> Column:
    """Whether a point is at least border away from all edges of an image of that shape."""
    return reduce(lambda s, d: s & d, [(c >= b) & (c <= n - b) for c, n, b in zip(coords, shape, border, strict=True)])


def nearest_cell(coord: Column, scale: float, size: int) -> Column:
    """The array index that a coordinate falls on: scaled, rounded half to even, clamped."""
    return F.least(F.greatest(F.bround(coord * scale), F.lit(0)), F.lit(size - 1)).cast("int")


def link_function(weight: Column, kind: str = "power", power: float = 4, bias: float = 0.0) -> Column:
    """The transform of link weights and node probabilities before they are solved."""
    if kind not in ("identity", "power"):
        raise ValueError(f"unknown link function {kind!r}")
    return (F.pow(weight, F.lit(float(power))) if kind == "power" else weight) + bias
