"""Painting, frame functions and exports, flow checks, descriptors, sorted trees and the table helpers."""

import itertools
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from trackweave import queries
from trackweave.operators import pixels, segmentation, tracks
from trackweave.sources import formats


def forest(spark, seed=3):
    """A random forest of 12 tracks as rows, parents by track, and places by (track, t)."""
    rng = random.Random(seed)
    parent = {k: rng.choice([-1, *range(1, k)]) if k > 2 else -1 for k in range(1, 13)}
    start, rows = {}, []
    for k in parent:
        start[k] = 0 if parent[k] == -1 else start[parent[k]] + 3
        rows += [(100 * k + t, k, parent[k], start[k] + t, 0.0, rng.uniform(0, 50), rng.uniform(0, 50)) for t in range(3)]
    return spark.createDataFrame(rows, "id long, track_id long, parent_track_id long, t int, z double, y double, x double"), parent, rows


def test_sorted_trees(spark):
    table, parent, rows = forest(spark)
    root = lambda k: k if parent[k] == -1 else root(parent[k])
    kids = lambda k: [c for c in parent if parent[c] == k]
    length = lambda k: 3 + (1 + sum(map(length, kids(k))) / len(kids(k)) if kids(k) else 0)
    made = tracks.trees_by_length(table).collect()
    roots = [r for r, _ in itertools.groupby(r["root_id"] for r in made)]
    assert roots == sorted((k for k in parent if parent[k] == -1), key=lambda k: (-round(length(k), 9), k)) and len(made) == len(rows)
    assert all(r["size"] == pytest.approx(length(r["root_id"])) for r in made)
    far = {
        "euclidean": lambda a, b: math.dist(a, b), "sqeuclidean": lambda a, b: math.dist(a, b) ** 2,
        "cityblock": lambda a, b: sum(abs(p - q) for p, q in zip(a, b, strict=True)), "chebyshev": lambda a, b: max(abs(p - q) for p, q in zip(a, b, strict=True)),
    }
    own = lambda a, b: abs(a[1] - b[1])
    for metric in ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "own"):
        between = far.get(metric, own)
        want = {k: 0.0 for k in parent if parent[k] == -1}
        for a, b in itertools.combinations(rows, 2):
            if a[3] == b[3] and root(a[1]) == root(b[1]):
                want[root(a[1])] = max(want[root(a[1])], between(a[4:], b[4:]))
        plain = (lambda a, b: pixels.F.abs(a[1] - b[1])) if metric == "own" else metric
        made = tracks.trees_by_radius(table, plain).collect()
        assert [r for r, _ in itertools.groupby(r["root_id"] for r in made)] == sorted(want, key=lambda k: (-want[k], k))
        assert all(r["size"] == pytest.approx(want[r["root_id"]]) for r in made)


def test_paint_and_frame_functions(spark, tmp_path):
    masks = spark.createDataFrame([(0, 1, 1, 5, 1), (0, 1, 1, 9, 0), (0, 1, 2, 7, 0), (0, 1, 2, 8, 0), (1, 0, 0, 5, 3)], "t int, y int, x int, id long, paint_order int")
    painted = pixels.paint(masks)
    assert {(r["t"], r["y"], r["x"]): r["label"] for r in painted.collect()} == {(0, 1, 1): 5, (0, 1, 2): 8, (1, 0, 0): 5}
    flipped = pixels.per_frame(painted, lambda f: f[:, ::-1], 2, 3, "label").where("value > 0")
    assert {(r["t"], r["y"], r["x"], r["value"]) for r in flipped.collect()} == {(0, 1, 1, 5.0), (0, 1, 0, 8.0), (1, 0, 2, 5.0)}
    folder = str(tmp_path)
    made = pixels.export_frames(painted, lambda t, frame: np.save(f"{folder}/{t}.npy", frame), 4, 2, 3)
    assert sorted(map(tuple, made.collect())) == [(0, 2), (1, 1), (2, 0), (3, 0)]
    assert np.load(f"{folder}/0.npy").tolist() == [[0, 0, 0], [0, 5, 8]] and not np.load(f"{folder}/3.npy").any()
    formats.write_frames(painted, f"{folder}/frames")
    assert spark.read.parquet(f"{folder}/frames").where("t = 1").count() == 1
    with pytest.raises(Exception, match="already exists"):
        formats.write_frames(painted, f"{folder}/frames")


def test_points_in_a_flow(spark):
    field = spark.createDataFrame([(t, cy, cx, 0.5, -0.25) for t in range(3) for cy in range(4) for cx in range(8)], "t int, cy int, cx int, vy double, vx double")
    points = spark.createDataFrame([(1, 0.0, 6.0), (2, 1.5, 4.0)], "track_id long, y double, x double")
    found = {(r["track_id"], r["t"]): (r["y"], r["x"]) for r in pixels.advect(points, field, 3, (4, 8)).collect()}
    assert found == {(1, 0): (0, 6), (1, 1): (1, 5), (1, 2): (2, 4), (2, 0): (1.5, 4), (2, 1): (2.5, 3), (2, 2): (3.5, 2)}
    wide = spark.createDataFrame([(0, 0, 6, 1.5, 0.0)], field.schema)
    with pytest.raises(Exception, match="beyond"):
        pixels.flow_shifts(points.selectExpr("track_id AS id", "0 AS t", "y", "x"), wide, (4, 8), (1.0, 1.0)).collect()


def test_a_flow_without_limit(spark, tmp_path):
    """Sums of pixels beyond 1,000 are fields beyond 1, which the query takes as they are."""
    spark.createDataFrame([(1, 0, 0, Decimal(700)), (1, 0, 0, Decimal(900))], "l_linenumber int, l_partkey long, l_suppkey long, l_quantity decimal(15,2)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 5L AS event_id, timestamp'2024-01-01 00:00:00' AS ts, 1L AS user_id, 'view' AS event_type, 0.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    found = queries.flow_shift_lookup(spark, str(tmp_path)).head()
    assert (found["id"], found["y_shift"], found["x_shift"]) == (5, 80.0, round(-0.8 * 32 / 0.0444, 6))


def test_descriptors_of_masks():
    square = [{"y": y, "x0": 3, "len": 4} for y in range(4)]
    moved = [{"y": y + 9, "x0": 30, "len": 4} for y in range(4)]
    flat = [{"y": 2, "x0": 0, "len": 12}]
    ell = [{"y": 0, "x0": 0, "len": 1}, {"y": 1, "x0": 0, "len": 4}]
    a, b, c, d = map(segmentation.dct_descriptor, (square, moved, flat, ell))
    assert np.allclose(a, b) and all(np.linalg.norm(v) == pytest.approx(1) for v in (a, c, d)) and a @ d < 0.99
    mask = np.array([[1, 0, 0, 0], [1, 1, 1, 1]])
    plain = [sum(mask[y, x] * math.cos(math.pi * (y + 0.5) * u / 2) * math.cos(math.pi * (x + 0.5) * v / 4) for y in range(2) for x in range(4)) for u in range(10) for v in range(10)]
    assert np.allclose(d, np.array(plain) / np.linalg.norm(plain))


def test_table_helpers(spark):
    table = spark.createDataFrame([(1, 0, 2.0, 9), (1, 2, 3.0, 9), (2, 1, 4.0, 1)], "track_id long, t int, v double, parent_track_id long")
    assert sorted(map(tuple, tracks.profile_matrix(table, "v").collect())) == [(1, 2.0, 0.0, 3.0), (2, 0.0, 4.0, 0.0)]
    assert sorted((r["track_id"], r["t"], r["parent_track_id"]) for r in formats.roots_to_none(table).collect()) == [(1, 0, -1), (1, 2, -1), (2, 1, 1)]
    ways = spark.createDataFrame([(4, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]), (5, [])], "track_id long, points array<array<double>>")
    assert sorted(map(tuple, tracks.trajectories_to_tracks(ways).collect())) == [(4, 0, 0.0, 1.0, 2.0), (4, 1, 3.0, 4.0, 5.0)]


def test_problem_as_text(spark):
    nodes = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, True)], "id long, first boolean, last boolean")
    links = spark.createDataFrame([(1, 2, 0.5), (1, 3, -0.25)], "source_id long, target_id long, weight double")
    overlaps = spark.createDataFrame([(2, 3)], "node_id long, ancestor_id long")
    lines = [r["value"] for r in formats.lp_lines(nodes, links, overlaps, -1.0, -2.0, -3.0).collect()]
    at = [lines.index(x) for x in ("Maximize", "Subject To", "Binaries", "End")]
    assert at[0] == 0 and at == sorted(at) and at[-1] == len(lines) - 1
    goal, rules, names = lines[1 : at[1]], lines[at[1] + 1 : at[2]], " ".join(lines[at[2] + 1 : at[3]]).split()
    assert {"+0.500000000 x1_2", "-0.250000000 x1_3"} <= set(goal) and sum("a" in x for x in goal) == 3
    assert {"x1_2 + a2 - n2 = 0", "a1 - n1 = 0", "n2 + n3 <= 1", "n1 - v1 >= 0"} <= set(rules) and len(rules) == 3 * 3 + 1
    assert any(x in rules for x in ("n1 + v1 - x1_2 - x1_3 - d1 = 0", "n1 + v1 - x1_3 - x1_2 - d1 = 0"))
    assert sorted(names) == sorted([f"{k}{i}" for k in "nadv" for i in (1, 2, 3)] + ["x1_2", "x1_3"])
