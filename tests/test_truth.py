"""Matches of boxes with true labels, against the matches of all their pairs."""

import pytest
from pyspark.sql import functions as F

from trackweave import queries
from trackweave.operators import hierarchy, pixels, solving, truth
from trackweave.sources.views import view

D = "/root/testdata/sf0.001"


def crowded(spark, d, name):
    """Nodes of ten frames on a narrow strip, where boxes meet many others."""
    nodes = view(spark, d, name)
    return nodes.withColumns({"t": F.col("t") % 3, "x": F.col("x") % 30, "y": F.col("y") % 25}) if name == "v_nodes" else nodes


@pytest.fixture
def few(spark, monkeypatch, one_partition):
    """The matches of all pairs, and then a match that lists the best two only, in small parts, and can't make all pairs."""
    monkeypatch.setattr(queries, "view", lambda s, d, n: crowded(s, d, n))
    pairs, closure = queries._truth_overlaps(spark, D), hierarchy.overlap_closure(view(spark, D, "v_hier"))
    assert pairs.count() > 8 * crowded(spark, D, "v_nodes").count()
    for name, value in (("LISTED", 1), ("LEAST", 2), ("COMPARED", 1_000), ("DEALT", 200)):
        monkeypatch.setattr(truth, name, value)
    monkeypatch.setattr(queries, "_truth_overlaps", None)
    return pairs, closure


def same(found, want):
    found, want = (sorted(map(tuple, x.collect())) for x in (found, want))
    assert found == want and want


def test_frame_matches_without_all_pairs(spark, few):
    same(queries.gt_frame_matches(spark, D), solving.match_frames(*few))


def test_template_matches_without_all_pairs(spark, few):
    nodes = crowded(spark, D, "v_nodes")
    same(queries.gt_template_matches(spark, D), solving.match_frames_by_area(*few, nodes, pixels.frame_peaks(nodes)))


@pytest.mark.parametrize("together", [0, 10_000])
@pytest.mark.parametrize("held", [1, 16])
def test_a_window_in_one_task_or_dealt(spark, few, monkeypatch, together, held):
    """Both ways give the same pairs, also if a task holds one pair of a label and lists it again and again."""
    monkeypatch.setattr(truth, "TOGETHER", together)
    monkeypatch.setattr(truth, "HELD", held)
    if together:
        # No listing by parts.
        monkeypatch.setattr(truth, "_listed", None)
    same(queries.gt_frame_matches(spark, D), solving.match_frames(*few))


def test_far_places_and_large_ids(spark, one_partition):
    """Places of any size are met, and clashes with nodes that aren't there are none."""
    far = 10**14
    nodes = [(0, 1, 5, 5, 3), (0, 2, 5, 6, 3), (0, far, -far, -far, 4), (1, 3, 5, 5, 3)]
    sources = spark.createDataFrame([(*x, 0.0, 0.0) for x in nodes], "w long, id long, y long, x long, h long, plus double, minus double")
    labels = spark.createDataFrame([(0, 7, 5, 5, 3), (0, 8, 5, 6, 3), (0, 9, -far, 1 - far, 4), (2, 7, 5, 5, 3)], "w long, id long, y long, x long, h long")
    overlaps = spark.createDataFrame([(2, 1), (3, 99)], "node_id long, ancestor_id long")
    found = {tuple(r) for r in truth.match_boxes(sources, labels, overlaps).collect()}
    assert found == {(0, 1, 7, 49 - 1e-3), (0, far, 9, 72 - 1e-3)}


def test_template_matches_in_tasks(spark, few, monkeypatch):
    """No listing by parts, and no round of jobs."""
    for name in ("_listed", "_rounds"):
        monkeypatch.setattr(truth, name, None)
    nodes = crowded(spark, D, "v_nodes")
    same(queries.gt_template_matches(spark, D), solving.match_frames_by_area(*few, nodes, pixels.frame_peaks(nodes)))
