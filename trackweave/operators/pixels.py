"""Rasters as pixel tables (t, y, x, label, intensity): measurements, contours, normalisation, relabelling, frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import l2, nearest_cell
from .ranks import quantiles


def region_props(pixels: DataFrame) -> DataFrame:
    """Measurements by frame and label; the background, label 0, is none."""
    return pixels.where("label > 0").groupBy("t", "label").agg(
        F.count(F.lit(1)).alias("num_pixels"),
        F.sum("intensity").alias("intensity_sum"),
        F.round(F.avg("intensity"), 6).alias("intensity_mean"),
        F.round(F.stddev_pop("intensity"), 6).alias("intensity_std"),
        F.min("intensity").alias("intensity_min"),
        F.max("intensity").alias("intensity_max"),
        F.bround(F.avg("y")).cast("int").alias("cy"),
        F.bround(F.avg("x")).cast("int").alias("cx"),
    )


def join_measurements(tracks: DataFrame, props: DataFrame) -> DataFrame:
    """tracks with the measurements of their label, which is the track's id, in each frame."""
    return tracks.join(props.withColumnRenamed("label", "track_id"), ["t", "track_id"], "left")


def containing(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """points (t, y, x) with the label whose pixel they round to; those outside all labels aren't listed."""
    inside = pixels.where("label > 0").select("t", F.col("y").alias("_y"), F.col("x").alias("_x"), "label")
    at = points.withColumns({c: F.bround(F.col(c[1:])).cast("int") for c in ("_y", "_x")})
    return at.join(inside, ["t", "_y", "_x"]).drop("_y", "_x")


def roi(pixels: DataFrame, boxes: DataFrame, masked: bool = False) -> DataFrame:
    """The pixels in each of boxes (id, t, y0, y1, x0, x1; ends not included), with its id.

    Masked, only those of the label that the box names. Boxes meet pixels by place, so a box costs its area.
    """
    cells = boxes.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    keys = ["t", "y", "x", *(["label"] if masked else [])]
    return cells.select("id", *keys).join(pixels, keys)


def node_features(nodes: DataFrame, pixels: DataFrame) -> DataFrame:
    """nodes with the measurements of the region that each lies in; null for a node outside all regions."""
    within = containing(pixels, nodes.select("id", "t", "y", "x")).select("id", "label")
    props = region_props(pixels).drop("cy", "cx")
    return nodes.join(within, "id", "left").join(props, ["t", "label"], "left")


def label_displacement(pixels: DataFrame) -> DataFrame:
    """(label, t, area, distance): the way of each label's centroid since its row before; 0 at first."""
    props = region_props(pixels)
    w = Window.partitionBy("label").orderBy("t")
    step = l2([F.col("cy"), F.col("cx")], [F.lag("cy").over(w), F.lag("cx").over(w)])
    return props.select("label", "t", F.col("num_pixels").alias("area"), F.coalesce(step, F.lit(0.0)).alias("distance"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles, most."""
    out = rows.agg(
        F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"),
        F.min(column).alias("least"), F.max(column).alias("most"),
    )
    out = out.join(F.broadcast(quantiles(rows, column, [0.25, 0.5, 0.75])), F.lit(True) == F.lit(True))
    return out.select("n", "mean", "std", "least", *(F.col("q")[k].alias(f"q{25 * (k + 1)}") for k in range(3)), "most")


def contours(pixels: DataFrame, labels: str = "label") -> DataFrame:
    """(t, y, x, foreground, contour): whether a pixel is in a label, and whether a neighbour has another one.

    Pixels that the table doesn't hold are background; they aren't listed.
    """
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    own = pixels.select("t", "y", "x", F.col(labels).alias("label"))
    asked = own.withColumn("d", F.explode(steps)).select("t", "y", "x", "label", (F.col("y") + F.col("d.dy")).alias("ny"), (F.col("x") + F.col("d.dx")).alias("nx"))
    there = own.select("t", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("label").alias("nl"))
    seen = asked.join(there, ["t", "ny", "nx"])
    return seen.groupBy("t", "y", "x").agg(
        F.max(F.col("label") > 0).alias("foreground"), F.max((F.col("label") != F.col("nl")) & (F.col("nl") > 0)).alias("contour")
    )


def normalize(pixels: DataFrame, low: float = 0.01, high: float = 0.99, gamma: float = 1.0) -> DataFrame:
    """pixels with value: intensity less its low quantile, over the high quantile of that, clipped to 0..1, to gamma."""
    bounds = quantiles(pixels, "intensity", [low, high]).withColumnRenamed("q", "_q")
    share = (F.col("intensity").cast("double") - F.col("_q")[0]) / (F.col("_q")[1] - F.col("_q")[0])
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return pixels.join(F.broadcast(bounds), F.lit(True) == F.lit(True)).withColumn("value", F.pow(clipped, F.lit(gamma))).drop("_q")


def relabel(pixels: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels replaced by (t, label, new_label), all at once: every change reads the labels before any of them."""
    return pixels.join(changes, ["t", "label"], "left").withColumn("label", F.coalesce("new_label", "label")).select(*pixels.columns)


def copy_segments(pixels: DataFrame, copies: DataFrame, height: int, width: int) -> DataFrame:
    """Adds segments moved in time and space: (t, label, to_t, to_label, dy, dx); what leaves the frame is clipped, and a
    copy covers what is there, the larger label last."""
    moved = pixels.join(copies, ["t", "label"]).select(
        F.col("to_t").alias("t"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.lit(None).cast("double").alias("intensity"), F.col("to_label").alias("label")
    )
    moved = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    both = pixels.select("t", "y", "x", F.col("intensity").cast("double").alias("intensity"), "label", F.lit(0).alias("_order")).unionByName(moved.withColumn("_order", F.lit(1)))
    return both.groupBy("t", "y", "x").agg(F.max("intensity").alias("intensity"), F.max_by("label", F.struct("_order", "label")).alias("label"))


def paint(masks: DataFrame) -> DataFrame:
    """(t, y, x, label) of masks (t, y, x, id, paint_order): the last painted id of a pixel."""
    return masks.groupBy("t", "y", "x").agg(F.max_by("id", F.struct("paint_order", "id")).alias("label"))


def flow_shifts(nodes: DataFrame, field: DataFrame, shape: tuple[int, int], scale: tuple[float, float], limit: float | None = 1.0) -> DataFrame:
    """nodes with y_shift and x_shift: the field (t, cy, cx, vy, vx), in halves of the frame, at their nearest cell, in
    pixels. A value beyond -limit to limit, at a cell that a node is nearest to, fails the job; without a limit all are taken."""
    cells = {"cy": nearest_cell(F.col("y"), scale[0], shape[0]), "cx": nearest_cell(F.col("x"), scale[1], shape[1])}
    out = nodes.withColumns(cells).join(field, ["t", "cy", "cx"], "left")
    checked = lambda c: F.col(c) if limit is None else F.when(F.abs(F.col(c)) > limit, F.raise_error(F.concat(F.lit(f"flow beyond {-limit:g} to {limit:g}: "), F.col(c).cast("string"))).cast("double")).otherwise(F.col(c))
    size = lambda c, n, s: F.coalesce(checked(c), F.lit(0.0)) * n / 2 / s
    return out.withColumns({"y_shift": size("vy", shape[0], scale[0]), "x_shift": size("vx", shape[1], scale[1])})


def advect(points: DataFrame, field: DataFrame, frames: int, shape: tuple[int, int]) -> DataFrame:
    """(track_id, t, y, x): points moved through the field frame by frame."""
    out = [points.select("track_id", F.lit(0).alias("t"), "y", "x")]
    for _ in range(frames - 1):
        moved = flow_shifts(out[-1], field, shape, (1.0, 1.0))
        out.append(moved.select("track_id", (F.col("t") + 1).alias("t"), (F.col("y") + F.col("y_shift")).alias("y"), (F.col("x") + F.col("x_shift")).alias("x")))
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def area_histogram(nodes: DataFrame) -> DataFrame:
    """(bin, n): areas in bins of a hundredth of an octave."""
    return nodes.groupBy(F.floor(F.log2("area") * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def area_peaks(histogram: DataFrame, n: int = 5) -> DataFrame:
    """(bin, smooth): the n largest local maxima of the histogram under a median over five bins.

    A histogram of areas has some thousands of bins at most, however many nodes, and so fits one window.
    """
    filled = histogram.withColumn("_all", F.lit(0))
    w = Window.partitionBy("_all").orderBy("bin")
    five = F.sort_array(F.collect_list("n").over(w.rowsBetween(-2, 2)))
    smooth = filled.withColumn("smooth", F.get(five, (F.size(five) / 2).cast("int")))
    peak = (F.col("smooth") > F.coalesce(F.lag("smooth").over(w), F.lit(-1))) & (F.col("smooth") >= F.coalesce(F.lead("smooth").over(w), F.lit(-1)))
    return smooth.withColumn("_peak", peak).where("_peak").orderBy(F.desc("smooth"), "bin").limit(n).select("bin", "smooth")


def frame_peaks(nodes: DataFrame, n: int = 5, apart: int = 25) -> DataFrame:
    """(t, peak): the n most usual areas of each frame's nodes (t, area), at least apart hundredths of an octave away.

    A median over five bins, the empty ones among them, smooths the histogram; a peak is the highest bin within apart on either side,
    of equal ones the smallest. A frame without a peak has its mean area. Areas below 1 and null ones don't count.
    """
    sized = nodes.where("area >= 1")
    bins = sized.groupBy("t", F.floor(F.log2("area") * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    around = bins.select("t", "n", F.explode(F.sequence(F.col("bin") - 2, F.col("bin") + 2)).alias("bin")).groupBy("t", "bin").agg(F.sort_array(F.collect_list("n")).alias("_n"))
    # The third of five, counting what is missing as zeros.
    smooth = around.select("t", "bin", F.coalesce(F.get("_n", F.size("_n") - 3), F.lit(0)).alias("smooth")).where("smooth > 0 and bin >= 0")
    own = F.struct("smooth", (-F.col("bin")).alias("b"))
    near = Window.partitionBy("t").orderBy("bin").rangeBetween(-apart, apart)
    peaks = smooth.withColumn("_best", F.max(own).over(near)).where(F.col("_best") == own)
    first = Window.partitionBy("t").orderBy(F.desc("smooth"), "bin")
    peaks = peaks.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n).select("t", F.pow(F.lit(2.0), F.col("bin") / 100).alias("peak"))
    means = sized.groupBy("t").agg(F.floor(F.avg("area")).cast("double").alias("peak")).join(peaks.select("t"), "t", "left_anti")
    return peaks.unionByName(means)


def per_frame(pixels: DataFrame, fn: Callable[[np.ndarray], np.ndarray], height: int, width: int, value: str = "intensity") -> DataFrame:
    """(t, y, x, value) of a function of whole frames, each in a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = np.zeros((height, width))
        frame[pdf["y"], pdf["x"]] = pdf["v"].astype(float)
        made = np.asarray(fn(frame), float)
        y, x = np.indices(made.shape)
        return pd.DataFrame({"t": int(pdf["t"].iloc[0]), "y": y.ravel(), "x": x.ravel(), "value": made.ravel()})

    rows = pixels.select("t", "y", "x", F.col(value).cast("double").alias("v"))
    return rows.groupBy("t").applyInPandas(run, "t int, y int, x int, value double")


def export_frames(labels: DataFrame, fn: Callable[[int, np.ndarray], None], frames: int, height: int, width: int) -> DataFrame:
    """(t, n_labels) of every frame, 0 to frames - 1, after fn(t, frame of labels) has run on it, in a task of its own.

    fn writes a frame wherever it likes, and may run again where a task is lost. Frames without rows are all 0.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, frame = int(pdf["t"].iloc[0]), np.zeros((height, width), np.int64)
        rows = pdf.dropna()
        frame[rows["y"].astype(int), rows["x"].astype(int)] = rows["label"].astype("int64")
        fn(t, frame)
        return pd.DataFrame({"t": [t], "n_labels": [int(np.unique(frame[frame > 0]).size)]})

    every = labels.sparkSession.range(frames).select(F.col("id").cast("int").alias("t"))
    return every.join(labels.select("t", "y", "x", "label"), "t", "left").groupBy("t").applyInPandas(run, "t int, n_labels bigint")


# Functions of one frame


def gaussian(frame: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = lambda line: np.convolve(np.pad(line, radius, mode="symmetric" if len(line) >= radius else "edge"), kernel, "valid")
    return np.apply_along_axis(smooth, 1, np.apply_along_axis(smooth, 0, frame))


def shifted(frame: np.ndarray, fill: float) -> np.ndarray:
    """A pixel and its four neighbours, stacked."""
    p = np.pad(frame, 1, constant_values=fill)
    return np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])


def dilated(frame: np.ndarray) -> np.ndarray:
    """The largest of each pixel and its eight neighbours."""
    p = np.pad(frame, 1, constant_values=-np.inf)
    rows = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
    return np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def reconstruction(seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """seed dilated again and again below mask, until nothing changes."""
    out = np.minimum(seed, mask)
    while True:
        new = np.minimum(dilated(out), mask)
        if np.array_equal(new, out):
            return out
        out = new


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold that parts a histogram into two classes of the largest variance between them."""
    counts, edges = np.histogram(values, bins)
    middle = (edges[:-1] + edges[1:]) / 2
    below, above = np.cumsum(counts), counts.sum() - np.cumsum(counts)
    total = np.cumsum(counts * middle)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = below * above * (total / below - (total[-1] - total) / above) ** 2
    return float(middle[int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))])


def detect_foreground(frame: np.ndarray, sigma: float = 15.0, min_foreground: float = 0.0) -> np.ndarray:
    """Pixels well above a smooth background, by Otsu's threshold on the root of the difference; opened and closed."""
    background = reconstruction(np.minimum(gaussian(frame, sigma), frame), frame) if frame.any() else frame
    residual = np.sqrt(np.maximum(frame - background, 0))
    found = residual > max(otsu(residual), min_foreground)
    opened = shifted(shifted(found, 1).min(0), 0).max(0)
    return shifted(shifted(opened, 0).max(0), 1).min(0).astype(bool)


def robust_invert(frame: np.ndarray, sigma: float = 1.0, low: float = 0.01, high: float = 0.99) -> np.ndarray:
    """Dark where the smoothed frame is bright, between two quantiles."""
    smooth = gaussian(frame, sigma)
    a, b = np.quantile(smooth, [low, high])
    return 1 - np.clip((smooth - a) / max(b - a, 1e-12), 0, 1)


def inverted_edt(mask: np.ndarray) -> np.ndarray:
    """1 less the distance to the background over the largest one; the background is 1."""
    inside = np.asarray(mask, bool)
    if inside.all() or not inside.any():
        return np.where(inside, 0.0, 1.0)
    far = np.where(inside, np.inf, 0.0)
    # Squared distances, a dimension at a time: to the nearest column of each row, then over the rows.
    for axis in (0, 1):
        line = np.arange(far.shape[axis])
        gaps = (line[:, None] - line[None, :]) ** 2
        far = np.apply_along_axis(lambda f, g=gaps: (g + f[None, :]).min(1), axis, far)
    distance = np.sqrt(far)
    return np.where(inside, 1 - distance / distance.max(), 1.0)


def phase_shift(fixed: np.ndarray, moving: np.ndarray) -> tuple[int, int]:
    """How far moving has to be shifted to lie on fixed, by the peak of the phase correlation."""
    cross = np.fft.fft2(fixed) * np.conj(np.fft.fft2(moving))
    peak = np.unravel_index(int(np.argmax(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12))))), cross.shape)
    return tuple(int(p - n) if p > n // 2 else int(p) for p, n in zip(peak, cross.shape, strict=True))
