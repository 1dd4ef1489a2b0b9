"""Measurements of regions by name, and those that a user brings: a registry of aggregates over pixels of a frame's label."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a user may bring: an aggregate as a Column, or a function of the pixels' y, x and intensity that gives a number.
Measure = Column | Callable[[np.ndarray, np.ndarray, np.ndarray], float]


def _moments() -> tuple[Column, Column]:
    """The variances along the longer and the shorter axis of a region, of pixels with an extent of 1."""
    yy, xx, xy = F.var_pop("y") + 1 / 12, F.var_pop("x") + 1 / 12, F.covar_pop("x", "y")
    middle, spread = (yy + xx) / 2, F.sqrt(F.pow((yy - xx) / 2, F.lit(2)) + xy * xy)
    return middle + spread, middle - spread


def _extent(c: str) -> Column:
    return F.max(c) - F.min(c) + 1


#: Aggregates by name, each made anew as it is asked for.
PROPERTIES: dict[str, Callable[[], Column]] = {
    "area": lambda: F.count(F.lit(1)),
    "centroid_y": lambda: F.avg("y"),
    "centroid_x": lambda: F.avg("x"),
    "bbox_y0": lambda: F.min("y"),
    "bbox_x0": lambda: F.min("x"),
    "bbox_y1": lambda: F.max("y") + 1,
    "bbox_x1": lambda: F.max("x") + 1,
    "extent": lambda: F.count(F.lit(1)) / (_extent("y") * _extent("x")),
    "equivalent_diameter": lambda: F.sqrt(4 * F.count(F.lit(1)) / F.pi()),
    "axis_major_length": lambda: 4 * F.sqrt(_moments()[0]),
    "axis_minor_length": lambda: 4 * F.sqrt(F.greatest(_moments()[1], F.lit(0.0))),
    "eccentricity": lambda: F.sqrt(F.greatest(1 - _moments()[1] / _moments()[0], F.lit(0.0))),
    "orientation": lambda: F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("y") - F.var_pop("x")) / 2,
    "intensity_sum": lambda: F.sum("intensity"),
    "intensity_mean": lambda: F.avg("intensity"),
    "intensity_std": lambda: F.stddev_pop("intensity"),
    "intensity_min": lambda: F.min("intensity"),
    "intensity_max": lambda: F.max("intensity"),
    "weighted_y": lambda: F.sum(F.col("y") * F.col("intensity")) / F.nullif(F.sum("intensity"), F.lit(0)),
    "weighted_x": lambda: F.sum(F.col("x") * F.col("intensity")) / F.nullif(F.sum("intensity"), F.lit(0)),
}


def measured(pixels: DataFrame, properties: list[str], extra: Mapping[str, Measure] | None = None, keys: tuple[str, ...] = ("t", "label")) -> DataFrame:
    """keys and one column a measure, of pixels (keys, y, x, intensity); label 0, the background, is none of the regions.

    Named properties and Columns are one aggregate with partial sums before the shuffle. A function gets the pixels of a
    region, ordered by y and x, as arrays, and gives a double; a region then is in one task. Null intensities
    count as pixels, but not in the intensity's aggregates; a function sees them as NaN, and a NaN that it gives is null. Unknown names are a KeyError, and
    names used twice or taken by a key a ValueError.
    """
    extra = dict(extra or {})
    names = [*properties, *extra]
    if len({*names, *keys}) < len(names) + len(keys):
        raise ValueError(f"names must differ: {[*keys, *names]}")
    if missing := sorted(set(properties) - set(PROPERTIES)):
        raise KeyError(f"no such property: {', '.join(missing)}")
    inside = pixels.where("label > 0") if "label" in keys else pixels
    columns = {n: PROPERTIES[n]() for n in properties} | {n: m for n, m in extra.items() if isinstance(m, Column)}
    native = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(c.alias(n) for n, c in columns.items())).drop("_n")
    functions = {n: m for n, m in extra.items() if n not in columns}
    if not functions:
        return native.select(*keys, *names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        y, x, v = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["intensity"].to_numpy(float)
        return pdf[list(keys)].head(1).assign(**{n: float(f(y, x, v)) for n, f in functions.items()})

    rows = inside.select(*keys, "y", "x", F.col("intensity").cast("double").alias("intensity"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    own = rows.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"`{n}` double" for n in functions)]))
    return native.join(own, list(keys)).select(*keys, *names)
