"""Operators over small tables with known results, and solvers against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import lineage, linking, matching, pixels, ranks, solving, summary, tracks
from trackweave.plans.config import Config, TrackingConfig, load_config, save_config
from trackweave.plans.layout import n_windows, waves, window, window_table
from trackweave.sources.durable import durable


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_windows_cover_and_meet(spark):
    """All frames are committed; a window holds on to what its neighbours committed, and reaches beyond free sides."""
    for last, size, overlap in itertools.product((4, 9, 22), (2, 4, 5), (1, 2)):
        count, held = n_windows(last, size), set()
        table = {r["index"]: tuple(r)[1:] for r in window_table(spark.range(last + 1).withColumnRenamed("id", "t"), size, overlap).collect()} if size == 4 else None
        for k in range(count):
            free = window(k, last, size, overlap, set())
            assert free.solve[0] <= free.commit[0] <= k * size and free.commit[1] <= free.solve[1] <= last
            assert table is None or table[k] == (*free.solve, *free.commit)
        for wave in waves(count, size, overlap):
            laid = [window(k, last, size, overlap, held) for k in wave]
            for x in laid:
                assert x.anchored == (x.index > 0 and x.index * size - 1 in held, (x.index + 1) * size - 1 < last and (x.index + 1) * size in held)
                assert not x.anchored[0] or x.solve[0] == x.index * size
            held |= {t for x in laid for t in range(x.commit[0], x.commit[1] + 1)}
        assert held == set(range(last + 1)) or last % size == 0


CONFIG = TrackingConfig(appear_weight=-0.2, disappear_weight=-0.6, division_weight=-0.4, link_function="identity")


def random_graph(seed, frames=4, width=3):
    """(nodes, links, overlaps): nodes 10 * t + k; distinct weights, some negative."""
    rng = np.random.default_rng(seed)
    nodes = [(10 * t + k, t) for t in range(frames) for k in range(width)]
    pairs = [(a, b) for a, t in nodes for b, u in nodes if u == t + 1 and rng.random() < 0.6]
    links = [(a, b, round(float(w), 6)) for (a, b), w in zip(pairs, rng.uniform(-0.3, 1, len(pairs)), strict=True)]
    overlaps = [(10 * t, 10 * t + 1) for t in range(frames) if rng.random() < 0.6]
    return nodes, links, overlaps


def tables(spark, nodes, links, overlaps):
    return (
        spark.createDataFrame(nodes, "id long, t int"), spark.createDataFrame(links, "source_id long, target_id long, weight double"),
        spark.createDataFrame(overlaps, "node_id long, ancestor_id long"),
    )


def total(chosen, nodes, links, overlaps, config=CONFIG):
    """The objective of a set of links, or None if it is inconsistent."""
    frame, weight = dict(nodes), {(a, b): w for a, b, w in links}
    parents, children = [b for _, b in chosen], [a for a, _ in chosen]
    used = {*parents, *children}
    if len(set(parents)) < len(parents) or any(children.count(a) > 2 for a in children) or any({a, b} <= used for a, b in overlaps):
        return None
    value = sum(weight[x] for x in chosen) + config.division_weight * sum(children.count(a) == 2 for a in set(children))
    value += config.appear_weight * sum(i not in parents and frame[i] > 0 for i in used)
    return value + config.disappear_weight * sum(i not in children and frame[i] < max(frame.values()) for i in used)


def test_selection_against_brute_force(spark, one_partition):
    """Consistent, its own objective right, and on these graphs not far from the best of all sets of links."""
    gap = best_of_all = 0.0
    for seed in range(2):
        graph = random_graph(seed, 3 + seed % 2)
        nodes, links, overlaps = tables(spark, *graph)
        found = durable(solving.solve(nodes, links, overlaps, CONFIG)).collect()
        chosen = [(r["parent_id"], r["id"]) for r in found if r["parent_id"] != -1]
        value = total(chosen, *graph)
        roots = {r["id"]: r["objective"] for r in found if r["parent_id"] == -1}
        assert value is not None and sum(roots.values()) == pytest.approx(value)
        kept = [(a, b) for a, b, w in graph[1] if w > -0.05]
        best = max(v for n in range(9) for x in itertools.combinations(kept, n) if (v := total(x, *graph)) is not None)
        assert value <= best + 1e-9
        gap, best_of_all = gap + best - value, best_of_all + best
    assert gap <= 0.35 * best_of_all


def test_best_links_are_a_plain_greedy_pass(spark):
    """Rounds of mutual bests take what one pass by weight takes."""
    for seed in range(1):
        _, links, overlaps = random_graph(seed, 6, 4)
        taken, against = [], {frozenset(x) for x in overlaps}
        for a, b, w in sorted(links, key=lambda x: -x[2]):
            used = {i for x in taken for i in x}
            second = sum(x == a for x, _ in taken)
            fine = all(b != y for _, y in taken) and second < (2 if w > 0.5 else 1)
            if w > 0 and fine and not any(frozenset((i, j)) in against for i in (a, b) for j in used):
                taken.append((a, b))
        rows_ = spark.createDataFrame([(0, a, b, w, False, w > 0.5) for a, b, w in links if w > 0], "w int, source_id long, target_id long, value double, must boolean, second boolean")
        pairs = spark.createDataFrame([(0, a, b) for a, b in overlaps], "w int, node_id long, ancestor_id long")
        assert rows(solving.best_links(rows_, solving.both_ways(pairs)), "source_id", "target_id") == sorted(taken)


def test_fixed_values(spark, one_partition):
    """A chain 1-2-3 with a branch 1-4, and 5 that overlaps 2."""
    nodes, links, overlaps = tables(spark, [(1, 0), (2, 1), (4, 1), (5, 1), (3, 2)], [(1, 2, 0.9), (2, 3, 0.8), (1, 4, 0.3), (5, 3, 0.5)], [(2, 5)])
    solve = lambda n=nodes, **o: rows(solving.solve(n, links, overlaps, CONFIG, **o), "id", "parent_id")
    assert solve() in ([(1, -1), (2, 1), (3, 2), (4, 1)], [(1, -1), (2, 1), (3, 2)])
    fix = lambda c, i, v: nodes.withColumn(f"fixed_{c}", F.when(F.col("id") == i, F.lit(v)))
    assert (4, 1) in solve(fix("division", 1, True)) and (4, 1) not in solve(fix("division", 1, False))
    with_five = solve(fix("node", 5, True))
    assert (3, 5) in with_five and 2 not in dict(with_five)
    assert (2, -1) in solve(fix("appear", 2, True))
    no_link = spark.createDataFrame([(2, 3, False)], "source_id long, target_id long, fixed boolean")
    assert (3, 2) not in solve(fixed_links=no_link)
    with pytest.raises(ValueError):
        solve(fix("division", 2, True))
    with pytest.raises(ValueError):
        solve(nodes.withColumn("node_prob", F.when(F.col("id") == 1, 0.5).otherwise(-1.0)))
    marked = solving.annotated(nodes.withColumn("node_annot", F.when(F.col("id") == 5, 1).otherwise(0)).withColumn("node_prob", F.lit(2.0)))
    assert {i for i, _ in solve(marked)} == {1, 3, 4, 5}


def test_windows_agree_with_one_window(spark, one_partition):
    chain = [(10 * t + k, t) for t in range(12) for k in range(3)]
    nodes = spark.createDataFrame(chain, "id long, t int")
    links = spark.createDataFrame([(10 * t + k, 10 * (t + 1) + j, 1.0 if j == k else 0.1) for t in range(11) for k in range(3) for j in range(3)], "source_id long, target_id long, weight double")
    none = spark.createDataFrame([], "node_id long, ancestor_id long")
    whole = rows(solving.solve(nodes, links, none, TrackingConfig(link_function="identity")), "id", "parent_id")
    parts = rows(solving.solve(nodes, links, none, TrackingConfig(link_function="identity", window_size=3)), "id", "parent_id")
    assert whole == parts == sorted((i, i - 10 if t else -1) for i, t in chain)


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k - 1 if k else -1) for k in range(300)], "id long, parent long")
    assert {r["root"] for r in lineage.heads(edges).collect()} == {0}
    assert lineage.ancestors(edges).count() == 300 * 299 // 2


def test_identical_frames_link_to_themselves(spark):
    nodes = spark.createDataFrame([(10 * t + k, t, 0.0, 5.0 * k, 3.0 * k, 4, 81) for t in range(3) for k in range(6)], "id long, t int, z double, y double, x double, h int, area int")
    found = linking.knn_links(nodes, 12.0, 3)
    assert {r["target_id"] for r in found.where("weight = 1.0 AND source_id + 10 = target_id").collect()} == {10 * t + k for t in (1, 2) for k in range(6)}
    assert found.where("dist >= 12.0").count() == 0 and found.groupBy("target_id").count().where("count > 3").count() == 0


def test_color_filter_and_new_node(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0, 2, 25, [1.0]), (2, 0, 0.0, 1.0, 2.0, 2, 25, [9.0]), (3, 1, 0.0, 1.0, 1.0, 2, 25, [1.2])], "id long, t int, z double, y double, x double, h int, area int, mean array<double>").withColumn("std", F.array(F.lit(1.0)))
    found = linking.knn_links(nodes, 5.0, 5, keep=linking.color_filter(5.0))
    assert rows(found, "source_id", "target_id") == [(1, 3)]
    row, links = linking.new_node(nodes, {"t": 1, "z": 0.0, "y": 1.0, "x": 2.0, "h": 2, "area": 25}, 5.0, 5)
    assert row.head()["id"] == 4 and rows(links, "source_id", "target_id") == [(1, 4), (2, 4)]


def test_set_and_get_values(spark):
    nodes = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, node_prob double")
    patch = spark.createDataFrame([(2, 0.9)], "id long, node_prob double")
    assert rows(matching.set_values(nodes, patch), "id", "node_prob") == [(1, 0.1), (2, 0.9)]
    with pytest.raises(ValueError):
        matching.set_values(nodes, patch.union(spark.createDataFrame([(3, 0.1)], "id long, node_prob double")))
    with pytest.raises(ValueError):
        matching.get_values(nodes, [1, 5], ["node_prob"])


def test_classifier(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y), bool(x + y > 0)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "id long, a double, b double, gt boolean")
    model = matching.fit_classifier(df, ["a", "b"], "gt", matching.LogisticClassifier())
    found = matching.predict(df, ["id", "gt"], ["a", "b"], model)
    assert found.where("(prob > 0.5) <> gt").count() < 15


def test_frame_matching(spark):
    pairs = spark.createDataFrame([(0, 1, 7, 9.0), (0, 2, 7, 8.0), (0, 2, 8, 5.0), (0, 3, 8, 6.0)], "t int, source_id long, target_id long, weight double")
    overlaps = spark.createDataFrame([(1, 3)], "node_id long, ancestor_id long")
    assert rows(solving.match_frames(pairs, overlaps), "source_id", "target_id") == [(1, 7), (2, 8)]


def test_frame_functions():
    frame = np.zeros((24, 24))
    frame[6:12, 8:15] = 50.0
    found = pixels.detect_foreground(frame, 6.0)
    assert found[8, 11] and not found[0, 0] and 20 <= found.sum() <= 60
    edt = pixels.inverted_edt(frame > 0)
    assert edt[0, 0] == 1.0 and edt.min() == 0.0 and edt[6, 8] < 1.0
    assert pixels.phase_shift(frame, np.roll(frame, (2, -3), (0, 1))) == (-2, 3)
    inverted = pixels.robust_invert(frame)
    assert inverted[8, 11] < 0.1 < inverted[0, 0]


def test_pixel_changes(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0, 1), (0, 0, 1, 1.0, 2), (1, 5, 5, 1.0, 3)], "t int, y int, x int, intensity double, label int")
    swap = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "t int, label int, new_label int")
    assert rows(pixels.relabel(px, swap), "t", "y", "x", "label") == [(0, 0, 0, 2), (0, 0, 1, 1), (1, 5, 5, 3)]
    copy = spark.createDataFrame([(0, 1, 1, 9, 5, 5), (0, 2, 1, 9, -1, 0)], "t int, label int, to_t int, to_label int, dy int, dx int")
    assert rows(pixels.copy_segments(px, copy, 8, 8), "t", "y", "x", "label")[-1] == (1, 5, 5, 9)


def test_summary(spark):
    nodes = spark.createDataFrame([(1, 0, -1), (2, 1, 1), (3, 1, 1), (4, 2, 3), (5, 2, -1)], "id long, t int, parent_id long")
    assert summary.solution_summary(nodes).head().asDict() == {"segments": 5, "appearances": 2, "ends": 3, "divisions": 1, "tracks": 4}
    with pytest.raises(ValueError):
        summary.max_frame(nodes.where("t > 9"))


def test_config(tmp_path):
    config = Config(tracking=TrackingConfig(window_size=5, image_border_size=(1.0, 2.0)))
    save_config(config, str(tmp_path / "c.toml"))
    again = load_config(str(tmp_path / "c.toml"))
    assert again.tracking.window_size == 5 and again.linking == config.linking
    with pytest.raises(ValueError):
        TrackingConfig(link_function="other")


def test_truth_overlaps_of_every_node(spark):
    from math import floor

    from trackweave import queries
    from trackweave.sources.views import view

    d, want = "/root/testdata/sf0.001", {}
    nodes = view(spark, d, "v_nodes").select("id", "t", "y", "x", "h", "gt_track_id").collect()
    for a in nodes:
        for b in nodes:
            if a["t"] == b["t"] and b["gt_track_id"] and b["gt_track_id"] > 0:
                sides = [min(floor(a[c]) + a["h"], floor(b[c]) + b["h"]) + 1 - max(floor(a[c]) - a["h"], floor(b[c]) - b["h"]) for c in "yx"]
                if min(sides) > 0:
                    key = (a["t"], a["id"], b["gt_track_id"])
                    want[key] = want.get(key, 0) + sides[0] * sides[1]
    made = queries._truth_overlaps(spark, d).collect()
    assert {(r["t"], r["source_id"], r["target_id"]): r["weight"] for r in made} == want and len(made) == len(want)
    taken = queries.gt_frame_matches(spark, d).collect()
    assert taken and all((r["t"], r["source_id"], r["target_id"]) in want for r in taken)


def test_relabelling_leaves_no_track_out(spark):
    from trackweave import queries
    from trackweave.sources.views import view

    tracks = view(spark, "/root/testdata/sf0.001", "v_tracks").select("id", "track_id").collect()
    order = {t: k + 1 for k, t in enumerate(sorted({r["track_id"] for r in tracks}))}
    made = queries.QUERIES["ctc_relabel_all"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["id"], r["track_id"]) for r in made) == sorted((r["id"], order[r["track_id"]]) for r in tracks)


def walk(track, start, length, parent, y=0.0):
    """Rows of a track that moves one pixel in x a frame."""
    return [(track, t, 0.0, y, float(t), parent) for t in range(start, start + length)]


WALK = "track_id long, t int, z double, y double, x double, parent_track_id long"


def test_tree_lengths(spark):
    rng = np.random.default_rng(3)
    parent, size = {0: -1, 1: -1}, {k: int(rng.integers(1, 6)) for k in range(40)}
    for k in range(2, 40):
        parent[k] = int(rng.integers(0, k))
    below = {k: [c for c, p in parent.items() if p == k] for k in parent}
    length = lambda k: size[k] + (1 + np.mean([length(c) for c in below[k]]) if below[k] else 0)
    table = spark.createDataFrame([r for k in parent for r in walk(k, 0, size[k], parent[k])], WALK)
    found = {r["root_id"]: r["length"] for r in tracks.tree_lengths(table).collect()}
    assert found == pytest.approx({k: length(k) for k in (0, 1)})


def test_gap_candidates_meet_across_squares(spark):
    rng = np.random.default_rng(5)
    made = [(k, int(rng.integers(0, 6)), 0.0, *map(float, rng.uniform(-20, 20, 2)), -1) for k in range(120)]
    found = rows(tracks.gap_candidates(spark.createDataFrame(made, WALK), 3, 7.0), "end_track", "start_track")
    near = lambda a, b: 1 <= b[1] - a[1] - 1 <= 3 and np.hypot(a[3] - b[3], a[4] - b[4]) < 7
    assert found == sorted((a[0], b[0]) for a in made for b in made if near(a, b))


def test_regions_of_nodes(spark):
    grid = spark.createDataFrame([(0, y, x, 1 if x < 3 else 0, y + 10 * x) for y in range(4) for x in range(5)], "t int, y int, x int, label int, intensity int")
    nodes = spark.createDataFrame([(1, 0, 1.4, 2.4), (2, 0, 1.0, 3.2), (3, 0, -7.0, 0.0), (4, 1, 1.0, 1.0)], "id long, t int, y double, x double")
    assert rows(pixels.containing(grid, nodes), "id", "label") == [(1, 1)]
    boxes = spark.createDataFrame([(9, 0, 2, 6, 1, 4, 1)], "id long, t int, y0 int, y1 int, x0 int, x1 int, label int")
    assert rows(pixels.roi(grid, boxes), "id", "y", "x") == [(9, y, x) for y in (2, 3) for x in (1, 2, 3)]
    assert rows(pixels.roi(grid, boxes, masked=True), "y", "x") == [(y, x) for y in (2, 3) for x in (1, 2)]
    features = {r["id"]: r["num_pixels"] for r in pixels.node_features(nodes, grid).collect()}
    assert features == {1: 12, 2: None, 3: None, 4: None}


def test_empty_tables(spark, tmp_path):
    some = spark.range(3)
    some.write.parquet(str(tmp_path / "some"))
    some.limit(0).write.parquet(str(tmp_path / "none"))
    assert [summary.is_empty(spark, str(tmp_path / x)) for x in ("some", "none", "missing")] == [False, True, True]


def test_components_of_any_graph(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(k + 100, k + 101) for k in range(30)] + [(100, 101), (7, 7)]
    want = {v: v for e in edges for v in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    made = {r["id"]: r["root"] for r in lineage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == want
    assert lineage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quantiles_and_numbers(spark):
    rng = np.random.default_rng(2)
    data = [(int(g), None if v == 3 else float(v)) for g, v in zip(rng.integers(0, 4, 600), rng.integers(0, 9, 600) ** 2 // 3)] + [(9, 1.5), (8, None)]
    df = spark.createDataFrame(data, "g int, v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in ranks.quantiles(df, "v", shares, ("g",)).collect():
        assert np.allclose(r["q"], np.quantile([v for g, v in data if g == r["g"] and v is not None], shares))
    assert np.allclose(ranks.quantiles(df, "v", shares).head()["q"], np.quantile([v for _, v in data if v is not None], shares))
    assert ranks.quantiles(df.where("v < 0"), "v", [0.5]).head()["q"] == [None]
    ids = [int(k) for k in rng.permutation(1000)[:300]]
    made = ranks.numbered(spark.createDataFrame([(k,) for k in ids], "id long").repartition(6), "n", "id")
    assert rows(made, "n", "id") == list(enumerate(sorted(ids), 1))
    assert ranks.numbered(spark.createDataFrame([], "id long"), "n", "id").count() == 0
