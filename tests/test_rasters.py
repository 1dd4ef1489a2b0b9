"""Whole frames against plain loops over random rasters; chunked rasters by round trips; measures a user brings."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import measures, pixels, rasters
from trackweave.sources import chunks

FRAME = "t int, y int, x int, seed double, mask double"


def plain_distances(mask, scale=(1.0, 1.0)):
    away = list(zip(*np.nonzero(~mask), strict=True))
    far = lambda y, x: min((math.hypot((y - b) * scale[0], (x - a) * scale[1]) for b, a in away), default=math.inf)
    return {(int(y), int(x)): far(y, x) for y, x in zip(*np.nonzero(mask), strict=True)}


@pytest.mark.parametrize("scale", [(1.0, 1.0), (2.5, 0.5)])
def test_distances(spark, scale):
    rng, height, width = np.random.default_rng(5), 17, 70
    masks = [rng.random((height, width)) < share for share in (0.5, 0.9, 0.99, 1.0)]
    masks[2][:, 1:68] = True
    rows = [(t, int(y), int(x)) for t, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    found = {}
    for r in rasters.distance_transform(spark.createDataFrame(rows + rows[:3], "t int, y int, x int"), height, width, scale).collect():
        found.setdefault(r["t"], {})[r["y"], r["x"]] = r["distance"]
    for t, m in enumerate(masks):
        want = plain_distances(m, scale)
        assert found[t].keys() == want.keys() and all(found[t][p] == pytest.approx(want[p]) for p in want)
    assert rasters.distance_transform(spark.createDataFrame([], "t int, y int, x int"), 4, 4).count() == 0


def test_inverted_distances(spark):
    mask = np.zeros((9, 9), bool)
    mask[1:8, 2:7] = True
    rows = [(0, y, x, int(mask[y, x]) if (y, x) != (0, 0) else None) for y in range(9) for x in range(9)] + [(1, y, x, 3) for y in range(9) for x in range(9)]
    made = {(r["t"], r["y"], r["x"]): r["value"] for r in rasters.inverted_distances(spark.createDataFrame(rows, "t int, y int, x int, label int"), 9, 9).collect()}
    plain = pixels.inverted_edt(mask)
    assert len(made) == 162 and all(made[0, y, x] == pytest.approx(plain[y, x]) and made[1, y, x] == 0 for y in range(9) for x in range(9))


def test_reconstruction_by_tiles(spark, one_partition):
    rng, rows, want = np.random.default_rng(2), [], {}
    for t, (height, width) in enumerate([(13, 11), (9, 9), (4, 4)]):
        mask = rng.integers(0, 30, (height, width)).astype(float)
        if t == 1:  # a way that winds through all tiles
            mask[:] = -np.inf
            mask[::2] = 9
            mask[1::4, -1] = mask[3::4, 0] = 9
        seed = np.where(rng.random((height, width)) < 0.05, mask, mask - 12) if t != 1 else np.full((height, width), -np.inf)
        seed[0, 0] = mask[0, 0]
        whole = pixels.reconstruction(seed, mask)
        for y, x in np.ndindex(height, width):
            if np.isfinite(mask[y, x]):
                want[t, y, x] = whole[y, x]
                rows.append((t, y, x, float(seed[y, x]) if np.isfinite(seed[y, x]) else None, float(mask[y, x])))
            elif x % 2:
                rows.append((t, y, x, 50.0, None))
    frame = spark.createDataFrame(rows, FRAME)
    made = {(r["t"], r["y"], r["x"]): r["value"] for r in rasters.reconstruct(frame, tile=3).collect()}
    assert made == want and all(want[1, y, x] == 9 for t, y, x in want if t == 1)
    assert rasters.reconstruct(frame.limit(0)).count() == 0


def test_reconstruction_of_one_tile_is_the_plain_loop():
    """Of the plain loop itself: no value is above the mask, none can grow, and none is higher than a way from a seed."""
    rng = np.random.default_rng(0)
    mask = rng.integers(0, 9, (6, 7)).astype(float)
    seed = mask - 3
    best = seed.copy()
    for _ in range(best.size):
        for y, x in np.ndindex(best.shape):
            around = best[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max()
            best[y, x] = min(mask[y, x], max(best[y, x], around))
    assert np.array_equal(best, pixels.reconstruction(seed, mask))


def test_planted_drifts_over_thirty_frames(spark):
    rng, height, width = np.random.default_rng(8), 20, 24
    whole = rng.random((height, width)) * 9
    steps = rng.integers(-4, 5, (30, 2))
    steps[0] = 0
    ways, rows = np.cumsum(steps, axis=0), []
    for t, (dy, dx) in enumerate(ways):
        # Frame 7 is missing, of frame 9 no pixel has a value.
        seen = np.roll(whole, (dy, dx), (0, 1)) + rng.random((height, width)) * 0.2
        rows += [(t, y, x, float(seen[y, x])) for y, x in np.ndindex(height, width) if t != 7]
    frames = spark.createDataFrame(rows, "t int, y int, x int, intensity double")
    shifts = rasters.sequence_shifts(frames, height, width)
    found = {r["t"]: (r["dy"], r["dx"]) for r in shifts.collect()}
    # A step of the missing frame counts with the next one.
    assert found == {t: (-int(dy), -int(dx)) for t, (dy, dx) in enumerate(ways) if t != 7}
    moved = rasters.registered(frames, shifts, height, width)
    assert moved.columns == frames.columns
    near = moved.groupBy("y", "x").agg(F.stddev_pop("intensity").alias("s"), F.count("intensity").alias("n")).where("n > 25").agg(F.max("s")).head()[0]
    assert near is None or near < 3.5
    blank = spark.createDataFrame([(0, 1, 1, 0.0), (1, 1, 1, 5.0), (2, 2, 1, 5.0)], "t int, y int, x int, intensity double")
    assert [tuple(r) for r in rasters.sequence_shifts(blank, 8, 8).orderBy("t").collect()] == [(0, 0, 0), (1, 0, 0), (2, -1, 0)]
    assert rasters.sequence_shifts(blank.limit(0), 8, 8).count() == 0


def test_chunked_rasters(spark, tmp_path):
    rng, shape, path = np.random.default_rng(3), (4, 10, 13), str(tmp_path / "labels")
    whole = np.where(rng.random(shape) < 0.3, rng.integers(1, 2**31 - 1, shape), 0)
    whole[2] = 0
    rows = [(t, y, x, int(whole[t, y, x]), "n") for t, y, x in np.ndindex(shape) if whole[t, y, x]] + [(0, 0, 0, int(whole[0, 0, 0]) or None, "n")]
    labels = spark.createDataFrame(rows, "t int, y int, x int, label int, value string")
    chunks.write_chunks(labels, path, shape, (1, 4, 5))
    read = chunks.read_chunks(spark, path)
    assert read.schema.simpleString() == "struct<t:int,y:int,x:int,value:int>"
    assert {(r["t"], r["y"], r["x"]): r["value"] for r in read.collect()} == {tuple(map(int, p)): int(whole[tuple(p)]) for p in np.argwhere(whole)}
    every = chunks.read_chunks(spark, path, dense=True)
    assert every.count() == whole.size and every.agg(F.sum("value")).head()[0] == int(whole.astype(np.int64).sum())
    # A chunk is a partition; the empty frame has no file, and nothing is left of the attempts.
    files = [n for n in os.listdir(path) if n != chunks.META]
    assert read.rdd.getNumPartitions() == len(files) and not any(n.startswith("2.") or n.count(".") != 2 for n in files)
    with pytest.raises(FileExistsError):
        chunks.write_chunks(labels, path, shape)
    chunks.write_chunks(labels.limit(0), path, shape, overwrite=True)
    assert chunks.read_chunks(spark, path).count() == 0 and chunks.read_chunks(spark, path, dense=True).count() == whole.size


def test_chunked_rasters_refuse(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, 9, 1.5)], "t int, y int, x int, label double")
    with pytest.raises(ValueError, match="outside"):
        chunks.write_chunks(one, str(tmp_path / "a"), (1, 9, 9))
    with pytest.raises(ValueError, match="frame"):
        chunks.write_chunks(one, str(tmp_path / "b"), (2, 9, 10), (2, 9, 10))
    chunks.write_chunks(one, f"file://{tmp_path}/c", (1, 9, 10), dtype="f8")
    assert [tuple(r) for r in chunks.read_chunks(spark, f"file://{tmp_path}/c").collect()] == [(0, 0, 9, 1.5)]
    assert chunks.large_chunks((5, 8192, 2048), "i4", 2**22) == (1, 1024, 1024) and chunks.large_chunks((1, 10, 10)) == (1, 10, 10)


def test_measures_that_a_user_brings(spark):
    rows = [(0, y, x, 1, float(y * 9 + x)) for y in range(3) for x in range(8)] + [(0, 5, 5, 2, None), (1, 0, 0, 0, 4.0), (1, 0, 1, 7, 2.0)]
    frame = spark.createDataFrame(rows, "t int, y int, x int, label int, intensity double")
    extra = {"corner": lambda y, x, v: v[0] + 100 * y[-1] + x[-1], "spread": F.max("intensity") - F.min("intensity")}
    made = {(r["t"], r["label"]): r.asDict() for r in measures.measured(frame, list(measures.PROPERTIES), extra).collect()}
    assert set(made) == {(0, 1), (0, 2), (1, 7)} and made[0, 1]["corner"] == 207 and made[0, 1]["spread"] == 25
    one = made[0, 1]
    assert (one["area"], one["extent"], one["centroid_y"], one["bbox_x1"]) == (24, 1.0, 1.0, 8)
    # Of a full rectangle the axes are known: sqrt(16 / 12) of its sides.
    assert one["axis_major_length"] == pytest.approx(8 * math.sqrt(16 / 12)) and one["axis_minor_length"] == pytest.approx(3 * math.sqrt(16 / 12))
    assert one["eccentricity"] == pytest.approx(math.sqrt(1 - 9 / 64)) and one["equivalent_diameter"] == pytest.approx(math.sqrt(96 / math.pi))
    lone = made[0, 2]
    assert lone["intensity_mean"] is None and lone["weighted_y"] is None and lone["corner"] is None and lone["eccentricity"] == 0
    with pytest.raises(KeyError):
        measures.measured(frame, ["areas"])
    with pytest.raises(ValueError):
        measures.measured(frame, ["area"], {"area": F.sum("y")})
    assert measures.measured(frame.limit(0), ["area"], extra).count() == 0
