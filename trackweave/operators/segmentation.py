"""Candidate segments of frames: the merge hierarchy of the foreground by rising contours.

Pixels of the foreground come in order of their contour; where components meet that are as large as a segment may be, each
is a node, as it stands before the merge, and so is what has merged in the end. A node's parent is the smallest one around
it that is kept. Components of the foreground are found by tiles and joined across their borders, so that no task holds a
frame; each component has its hierarchy from one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import SegmentationConfig
from ..sources.durable import durable
from . import lineage

SCHEMA = "t int, root bigint, node int, parent int, z double, y double, x double, area int, frontier double, height double, runs array<struct<y:int,x0:int,len:int>>"
#: Pixels a side of the tiles in which components are labelled.
TILE = 512


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected components: the smallest place is handed on until nothing changes."""
    place = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(place, 1)
        around = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        least = np.where(mask, np.where(around > 0, around, mask.size + 1).min(0), 0)
        # A place's own label leads on to where that one has got.
        jump = np.where(mask, np.concatenate([[0], least.ravel()])[least], 0)
        if np.array_equal(jump, place):
            return np.where(mask, np.unique(place, return_inverse=True)[1].reshape(mask.shape) + (0 if (place == 0).any() else 1), 0)
        place = jump


def runs_of(ys: np.ndarray, xs: np.ndarray) -> list[dict[str, int]]:
    """A mask as runs of pixels along x."""
    order = np.lexsort((xs, ys))
    ys, xs = ys[order], xs[order]
    start = np.flatnonzero(np.concatenate([[True], (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)]))
    return [{"y": int(ys[a]), "x0": int(xs[a]), "len": int(b - a)} for a, b in zip(start, np.append(start[1:], len(ys)), strict=True)]


def merge_tree(ys: np.ndarray, xs: np.ndarray, contours: np.ndarray, config: SegmentationConfig) -> list[dict]:
    """The nodes of one component of a foreground, children before parents; parent counts from 0, -1 for none.

    All pixels of a contour come at once. frontier is the contour at which a node merges, of the last one its own height, the
    largest contour in it. Nodes above max_area, and those that merge below min_frontier, are left out.
    """
    grid = np.full((np.ptp(ys) + 3, np.ptp(xs) + 3), -1)
    gy, gx = ys - ys.min() + 1, xs - xs.min() + 1
    grid[gy, gx] = np.arange(len(ys))
    beside = np.stack([grid[gy - 1, gx], grid[gy + 1, gx], grid[gy, gx - 1], grid[gy, gx + 1]], axis=1).tolist()
    order = np.lexsort((xs, ys, contours)).tolist()
    up, size = list(range(len(ys))), [1] * len(ys)
    # Pixels of a component follow one another from its head on, so that those of a node stay a run of the whole.
    head, tail, after = list(range(len(ys))), list(range(len(ys))), [-1] * len(ys)
    last = [0.0] * len(ys)
    inner: dict[int, list[int]] = {}
    nodes: list[dict] = []

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def emit(root: int, frontier: float) -> int:
        nodes.append({"head": head[root], "area": size[root], "height": last[root], "frontier": frontier, "parent": -1})
        for child in inner.pop(root, []):
            nodes[child]["parent"] = len(nodes) - 1
        return len(nodes) - 1

    here = np.zeros(len(ys), bool).tolist()
    start = 0
    while start < len(order):
        level, end = float(contours[order[start]]), start
        while end < len(order) and contours[order[end]] == level:
            end += 1
        group = order[start:end]
        for k in group:
            here[k] = True
        # The components that the pixels of this contour join, as they were before it.
        sets = {k: k for k in group}

        def of(k: int, sets: dict[int, int] = sets) -> int:
            while sets[k] != k:
                sets[k] = sets[sets[k]]
                k = sets[k]
            return k

        for k in group:
            for j in beside[k]:
                if j >= 0 and here[j]:
                    other = find(j) if j not in sets else j
                    sets.setdefault(other, other)
                    a, b = of(k), of(other)
                    if a != b:
                        sets[max(a, b)] = min(a, b)
        joined: dict[int, list[int]] = {}
        for k in sets:
            joined.setdefault(of(k), []).append(k)
        new = set(group)
        for members in joined.values():
            large = [k for k in members if k not in new and size[k] >= config.min_area]
            below = [emit(k, level) for k in large] if len(large) > 1 else [c for k in large for c in inner.pop(k, [])]
            first = members[0]
            for k in members[1:]:
                up[k] = first
                size[first] += size[k]
                after[tail[first]], tail[first] = head[k], tail[k]
            last[first] = level
            if below:
                inner[first] = below
        start = end
    whole = find(0)
    if size[whole] >= config.min_area:
        emit(whole, last[whole])
    place, k, row = [0] * len(ys), head[whole], []
    while k >= 0:
        place[k] = len(row)
        row.append(k)
        k = after[k]
    row = np.array(row)
    kept = [n["area"] <= config.max_area and (n["parent"] < 0 or n["frontier"] >= config.min_frontier) for n in nodes]
    number = np.cumsum(kept) - 1
    found = []
    for n, keep in zip(nodes, kept, strict=True):
        if not keep:
            continue
        parent = n["parent"]
        while parent >= 0 and not kept[parent]:
            parent = nodes[parent]["parent"]
        own = row[place[n["head"]] : place[n["head"]] + n["area"]]
        y, x = ys[own], xs[own]
        found.append({**n, "parent": int(number[parent]) if parent >= 0 else -1, "y": int(y.mean().round()), "x": int(x.mean().round()), "runs": runs_of(y, x)})
    return found


def foreground_components(pixels: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """pixels (t, y, x, contour) with root: the least number of a pixel in its 4-connected component, frames told apart.

    Labelled tile by tile; components of tiles that touch are joined as edges.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        mask = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        labels = components(mask)[y - y.min(), x - x.min()]
        number = pdf["t"].to_numpy(np.int64) * (height * width) + y.astype(np.int64) * width + x
        return pdf[["t", "y", "x", "contour"]].assign(part=pd.Series(number, index=pdf.index).groupby(labels).transform("min"))

    tiled = pixels.select("t", "y", "x", F.col("contour").cast("double").alias("contour"), F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))
    parts = durable(tiled.groupBy("t", "_ty", "_tx").applyInPandas(label, "t int, y int, x int, contour double, part bigint"))
    edges = None
    for c, o in (("y", "x"), ("x", "y")):
        ends = parts.where(F.col(c) % tile == tile - 1).select("t", F.col("part").alias("a"), (F.col(c) + 1).alias(c), o)
        starts = parts.where(F.col(c) % tile == 0).select("t", F.col("part").alias("b"), c, o)
        met = ends.join(starts, ["t", c, o]).select("a", "b").distinct()
        edges = met if edges is None else edges.unionByName(met)
    roots = lineage.components(durable(edges)).withColumnRenamed("id", "part")
    return parts.join(roots, "part", "left").select("t", "y", "x", "contour", F.coalesce("root", "part").alias("root"))


def segment(pixels: DataFrame, height: int, width: int, config: SegmentationConfig | None = None, max_segments: int = 1_000_000, tile: int = TILE) -> DataFrame:
    """Nodes of pixels (t, y, x, foreground, contour): id, hier_parent_id, centroid, area, frontier, height, runs.

    Components of the foreground with less than min_area / min_area_factor pixels go first. ValueError if a frame has
    max_segments or more, as ids are numbers within a frame's range.
    """
    config = config or SegmentationConfig()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        found = merge_tree(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["contour"].to_numpy(float), config)
        t, root = int(pdf["t"].iloc[0]), int(pdf["root"].iloc[0])
        rows = [(t, root, k, f["parent"], 0.0, float(f["y"]), float(f["x"]), f["area"], f["frontier"], f["height"], f["runs"]) for k, f in enumerate(found)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    inside = pixels.where(F.col("foreground") > config.threshold).select("t", "y", "x", "contour")
    parts = foreground_components(inside, width, height, tile)
    large = parts.groupBy("t", "root").count().where(F.col("count") >= config.min_area / config.min_area_factor).select("t", "root")
    made = durable(parts.join(large, ["t", "root"], "left_semi").groupBy("t", "root").applyInPandas(run, SCHEMA))
    counts = made.groupBy("t", "root").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("t").orderBy("root")
    counts = durable(counts.withColumn("base", F.sum("n").over(order) - F.col("n")))
    crowded = counts.groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= max_segments).head(1)
    if crowded:
        raise ValueError(f"frame {crowded[0]['t']} has {crowded[0]['n']} segments")
    numbered = made.join(counts.select("t", "root", "base"), ["t", "root"])
    number = lambda c: F.col("base") + F.col(c) + 1 + (F.col("t") + 1).cast("bigint") * max_segments
    parent = F.when(F.col("parent") < 0, F.lit(-1).cast("bigint")).otherwise(number("parent"))
    local = (F.col("base") + F.col("node") + 1).cast("int").alias("t_node_id")
    return numbered.select("t", local, "z", "y", "x", "area", "frontier", "height", "runs", number("node").alias("id"), parent.alias("hier_parent_id"))


def mask_pixels(nodes: DataFrame) -> DataFrame:
    """(id, t, y, x) of all pixels of the nodes' runs."""
    runs = nodes.select("id", "t", F.explode("runs").alias("r"))
    return runs.select("id", "t", F.col("r.y").alias("y"), F.explode(F.sequence(F.col("r.x0"), F.col("r.x0") + F.col("r.len") - 1)).alias("x"))


def mask_iou(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a_id, b_id) with the intersection of the masks and its share of their union, 0 where they don't meet."""
    px = mask_pixels(nodes)
    a = px.select(F.col("id").alias("a_id"), "y", "x").join(pairs, "a_id")
    b = px.select(F.col("id").alias("b_id"), "y", "x")
    shared = a.join(b, ["b_id", "y", "x"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("intersection"))
    area = lambda n: nodes.select(F.col("id").alias(f"{n}_id"), F.col("area").alias(f"_{n}"))
    out = pairs.join(shared, ["a_id", "b_id"], "left").join(area("a"), "a_id").join(area("b"), "b_id").fillna(0, ["intersection"])
    return out.withColumn("iou", F.col("intersection") / (F.col("_a") + F.col("_b") - F.col("intersection"))).drop("_a", "_b")


def dct_descriptor(runs: list[dict], size: int = 10) -> np.ndarray:
    """The first coefficients of a mask's cosine transform, of length one."""
    ys = np.concatenate([np.full(r["len"], r["y"]) for r in runs])
    xs = np.concatenate([np.arange(r["x0"], r["x0"] + r["len"]) for r in runs])
    mask = np.zeros((np.ptp(ys) + 1, np.ptp(xs) + 1))
    mask[ys - ys.min(), xs - xs.min()] = 1
    basis = lambda n: np.cos(np.pi * (np.arange(n)[None, :] + 0.5) * np.arange(size)[:, None] / n)
    out = (basis(mask.shape[0]) @ mask @ basis(mask.shape[1]).T).ravel()
    return out / max(np.linalg.norm(out), 1e-12)
