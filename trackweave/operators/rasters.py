"""Whole frames as Spark jobs over pixel tables (t, y, x, ...): distances by axes, reconstruction by tiles, registration.

No task holds more than a strip of columns or a tile, but for the registration, whose transforms need two frames at a time.
Pixels that a table doesn't hold are background; what lies outside a frame is neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from .pixels import dilated, phase_shift

#: Columns of a strip in which distances along y are taken.
STRIP = 64
#: Pixels a side of the tiles of a reconstruction.
TILE = 256


def distance_transform(pixels: DataFrame, height: int, width: int, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(t, y, x, distance) of the foreground pixels (t, y, x): how far the nearest background pixel of the frame is.

    Along each row first, by runs of foreground; then along the columns, a strip of them a task, where a row's distance
    counts as far as the rows between are not farther than what is known. scale is the size of a pixel along y and x.
    Infinite in frames without background. Repeated rows give repeated results; an empty table gives an empty one.
    """
    row = Window.partitionBy("t", "y")
    runs = pixels.select("t", "y", "x").withColumn("_run", F.col("x") - F.dense_rank().over(row.orderBy("x")))
    run = Window.partitionBy("t", "y", "_run")
    ends = runs.withColumns({"_a": F.min("x").over(run), "_b": F.max("x").over(run)})
    left = F.when(F.col("_a") > 0, F.col("x") - F.col("_a") + 1)
    right = F.when(F.col("_b") < width - 1, F.col("_b") - F.col("x") + 1)
    gaps = ends.select("t", "y", "x", F.least(left, right).cast("double").alias("gap"), F.floor(F.col("x") / STRIP).alias("strip"))

    def along_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy() % STRIP
        across = np.zeros((height, STRIP))
        across[y, x] = (pdf["gap"].fillna(np.inf).to_numpy() * scale[1]) ** 2
        found, k = across.copy(), 1
        while k < height and (step := (k * scale[0]) ** 2) < found.max():
            np.minimum(found[k:], across[:-k] + step, out=found[k:])
            np.minimum(found[:-k], across[k:] + step, out=found[:-k])
            k += 1
        return pdf[["t", "y", "x"]].assign(distance=np.sqrt(found[y, x]))

    return gaps.groupBy("t", "strip").applyInPandas(along_columns, "t int, y int, x int, distance double")


def inverted_distances(pixels: DataFrame, height: int, width: int, foreground: str = "label > 0", scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(t, y, x, value) of pixels: 1 less the distance to the background over the largest of the frame; background is 1.

    A frame without background has 0 throughout.
    """
    inside = distance_transform(pixels.where(foreground), height, width, scale)
    most = inside.groupBy("t").agg(F.max("distance").alias("_most"))
    share = F.when(F.col("_most") == float("inf"), 0.0).otherwise(1 - F.col("distance") / F.col("_most"))
    valued = inside.join(most, "t").select("t", "y", "x", share.alias("value"))
    outside = pixels.where(~F.coalesce(F.expr(foreground), F.lit(False))).select("t", "y", "x", F.lit(1.0).alias("value"))
    return valued.unionByName(outside)


def _settled(value: np.ndarray, mask: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """value dilated below mask until nothing changes; halo surrounds it and gives, but isn't changed."""
    padded = halo.copy()
    padded[1:-1, 1:-1] = value
    while True:
        new = np.minimum(dilated(padded)[1:-1, 1:-1], mask)
        if np.array_equal(new, padded[1:-1, 1:-1]):
            return new
        padded[1:-1, 1:-1] = new


#: The eight neighbours of a tile.
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
#: What a tile shows its neighbour on one side, and where that one's halo takes it, by -1, 0, 1.
SHOWN = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}
TAKEN = {-1: slice(-1, None), 0: slice(1, -1), 1: slice(0, 1)}
TILES = "t int, ty int, tx int, value binary, mask binary, changed boolean"


def reconstruct(pixels: DataFrame, seed: str = "seed", mask: str = "mask", tile: int = TILE) -> DataFrame:
    """(t, y, x, value): seed dilated over the eight neighbours again and again below mask, until nothing changes.

    Each tile settles within itself and then shows its border to its neighbours, which settle anew, until no tile changes;
    frames that are settled leave the rounds. Rounds are bounded by the tiles that the longest way crosses, and nothing is
    cut off. Pixels with a null mask, like those not in the table, let nothing pass; a null seed starts below all values.
    Of repeated pixels one counts; an empty table gives an empty result.
    """
    session, low = pixels.sparkSession, float("-inf")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        at = pdf["y"] - ty * tile, pdf["x"] - tx * tile
        above, value = np.full((tile, tile), low), np.full((tile, tile), low)
        above[at] = pdf["m"]
        value[at] = pdf["s"].fillna(low)
        value = _settled(np.minimum(value, above), above, np.full((tile + 2, tile + 2), low))
        return pd.DataFrame({"t": [int(pdf["t"].iloc[0])], "ty": [ty], "tx": [tx], "value": [value.tobytes()], "mask": [above.tobytes()], "changed": [True]})

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, ty, tx, value in pdf[["t", "ty", "tx", "value"]].itertuples(index=False):
                grid = np.frombuffer(value).reshape(tile, tile)
                rows += [(t, ty + dy, tx + dx, dy, dx, grid[SHOWN[dy], SHOWN[dx]].tobytes()) for dy, dx in AROUND]
            yield pd.DataFrame(rows, columns=["t", "ty", "tx", "dy", "dx", "edge"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, changes = [], []
            for value, above, edges in pdf[["value", "mask", "edges"]].itertuples(index=False):
                if edges is None:
                    values.append(value)
                    changes.append(False)
                    continue
                old, halo = np.frombuffer(value).reshape(tile, tile), np.full((tile + 2, tile + 2), low)
                for e in edges:
                    part = halo[TAKEN[e["dy"]], TAKEN[e["dx"]]]
                    part[:] = np.frombuffer(e["edge"]).reshape(part.shape)
                new = _settled(old, np.frombuffer(above).reshape(tile, tile), halo)
                values.append(new.tobytes())
                changes.append(not np.array_equal(new, old))
            yield pdf[["t", "ty", "tx"]].assign(value=values, mask=pdf["mask"], changed=changes)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, ty, tx, value, above in pdf[["t", "ty", "tx", "value", "mask"]].itertuples(index=False):
                y, x = np.nonzero(np.frombuffer(above).reshape(tile, tile) > low)
                found = np.frombuffer(value).reshape(tile, tile)[y, x]
                yield pd.DataFrame({"t": t, "y": y + ty * tile, "x": x + tx * tile, "value": found})

    number = lambda c: F.col(c).cast("double")
    rows = pixels.select("t", "y", "x", number(seed).alias("s"), number(mask).alias("m")).where("m IS NOT NULL")
    rows = rows.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    # A tile takes a megabyte or two; few of them at a time go to a worker.
    batch = session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        tiles = durable(rows.groupBy("t", "ty", "tx").applyInPandas(pack, TILES))
        done = []
        while tiles.where("changed").head(1):
            shown = tiles.where("changed").select("t", "ty", "tx", "value").mapInPandas(show, "t int, ty int, tx int, dy int, dx int, edge binary")
            edges = shown.groupBy("t", "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "edge")).alias("edges"))
            tiles = durable(tiles.drop("changed").join(edges, ["t", "ty", "tx"], "left").mapInPandas(settle, TILES))
            moving = tiles.where("changed").select("t").distinct()
            done.append(tiles.join(moving, "t", "left_anti"))
            tiles = tiles.join(moving, "t", "left_semi")
        whole = reduce(DataFrame.unionByName, done, tiles)
        return durable(whole.mapInPandas(unpack, "t int, y int, x int, value double"))
    finally:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def sequence_shifts(pixels: DataFrame, height: int, width: int, value: str = "intensity") -> DataFrame:
    """(t, dy, dx): how far each frame has to be moved to lie on the first one.

    Every frame is held against the one before it that the table has, all pairs at once, by phase correlation; what they are
    apart adds up. A task holds two frames. The sums run over one row a frame.
    """
    frames = pixels.select("t").distinct()
    after = frames.withColumn("_next", F.lead("t").over(Window.partitionBy(F.lit(0)).orderBy("t")))
    sides = F.array(F.struct(F.col("t").alias("pair"), F.lit(1).alias("side")), F.struct(F.col("_next").alias("pair"), F.lit(0).alias("side")))
    rows = pixels.join(after, "t").select(F.inline(sides), "y", "x", F.col(value).cast("double").alias("v")).where("pair IS NOT NULL")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros((2, height, width))
        np.add.at(both, (pdf["side"], pdf["y"], pdf["x"]), pdf["v"].fillna(0.0))
        dy, dx = phase_shift(both[0], both[1]) if both[0].any() and both[1].any() else (0, 0)
        return pd.DataFrame({"t": [int(pdf["pair"].iloc[0])], "dy": [dy], "dx": [dx]})

    apart = rows.groupBy("pair").applyInPandas(compare, "t int, dy int, dx int")
    so_far = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return apart.select("t", *(F.sum(c).over(so_far).alias(c) for c in ("dy", "dx")))


def registered(pixels: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """pixels moved by the shifts (t, dy, dx) of their frames; what leaves the frame is dropped, frames without a shift stay."""
    at = pixels.join(shifts, "t", "left")
    moved = at.withColumns({c: (F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0))).cast("int") for c in ("y", "x")})
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*pixels.columns)
