"""The façade, formats and streaming on made-up frames."""

import pytest
from pyspark.sql import functions as F

from trackweave.plans.config import Config, LinkingConfig, SegmentationConfig, TrackingConfig
from trackweave.plans.session import Status, Tracker
from trackweave.sources import formats
from trackweave.sources.chunks import read_chunks
from trackweave.streaming.frames import link_stream, stream_links


@pytest.fixture(scope="module")
def tracker(spark):
    rows = [(t, y, x, 1.0, 0.1 * abs(x - 6 - t)) for t in range(3) for y in range(4, 10) for x in range(4 + t, 10 + t)]
    rows += [(t, y, x, 1.0, 0.2) for t in range(3) for y in range(20, 25) for x in range(20, 25)]
    pixels = spark.createDataFrame(rows, "t int, y int, x int, foreground double, contour double")
    config = Config(SegmentationConfig(min_area=12), LinkingConfig(max_distance=6.0), TrackingConfig(link_function="identity"))
    return Tracker(spark, config).track(pixels, 32, 32)


def test_track(tracker):
    assert tracker.status == Status.SOLVED
    tracks = tracker.tracks().collect()
    assert len({r["track_id"] for r in tracks}) == 2 and len(tracks) == 6
    assert all(r["parent_track_id"] == -1 for r in tracks)


def test_ground_truth_and_classifiers(tracker, spark):
    """The objects that tracking found are the truth: nodes are told from what isn't by their features, links by distance."""
    rows = [(t, y, x, 1) for t in range(3) for y in range(4, 10) for x in range(4 + t, 10 + t)] + [(t, y, x, 2) for t in range(3) for y in range(20, 25) for x in range(20, 25)]
    truth = spark.createDataFrame(rows, "t int, y int, x int, label int")
    own = Tracker(spark, Config(SegmentationConfig(min_area=12), LinkingConfig(max_distance=60.0), TrackingConfig(link_function="identity")))
    own.use_nodes(tracker.nodes).link().match_to_ground_truth(truth, optimize_config=True)
    areas = {r["area"]: r["gt_track_id"] for r in own.nodes.where("gt_track_id > 0").collect()}
    assert areas == {36: 1, 25: 2} and own.nodes.where("gt_track_id > 0").count() == 6
    assert own.nodes.where("gt_track_id = 0").count() == own.nodes.count() - 6
    assert own.config.segmentation.min_area == 23 and own.config.segmentation.max_area == 37 and 2 <= own.config.linking.max_distance <= 3
    shade = spark.createDataFrame([(t, y, x, 10.0 * y) for t, y, x, _ in rows], "t int, y int, x int, intensity double")
    features = own.get_nodes_features(shade, {"rows": F.count_distinct("y")})
    big = features.where("area = 36").head()
    assert (big["box_height"], big["box_width"], big["rows"], big["intensity_mean"], big["intensity_max"]) == (6, 6, 6, 65.0, 90.0)
    model = own.fit_links(features, ["area", "intensity_mean"])
    own.predict_links(features, ["area", "intensity_mean"], model)
    same = {(r["same"], r["weight"] > 0.5) for r in own.links.join(own.nodes.selectExpr("id AS source_id", "gt_track_id AS a"), "source_id").join(own.nodes.selectExpr("id AS target_id", "gt_track_id AS b"), "target_id").selectExpr("a = b AND a > 0 AS same", "weight").collect()}
    assert (True, True) in same and (False, True) not in same
    own.predict_nodes(features, ["area"], own.fit_nodes(features, ["area"]))
    assert own.nodes.where("node_prob is null or node_prob < 0 or node_prob > 1").count() == 0
    assert "gt_track_id" not in own.clear("truth").nodes.columns


def test_border_of_the_image(tracker, spark):
    """With a border as wide as the frame all starts and ends are free, so no weak link is worth its cost."""
    config = Config(tracking=TrackingConfig(link_function="identity", image_border_size=(40.0, 40.0), appear_weight=-5.0, disappear_weight=-5.0))
    own = Tracker(spark, config).use_nodes(tracker.nodes).add_links(tracker.links)
    with pytest.raises(ValueError):
        own.solve()
    free = own.solve((32, 32)).solution.agg(F.sum(F.when(F.col("parent_id") == -1, F.col("objective")))).head()[0]
    own.config.tracking.image_border_size = None
    assert free >= own.solve().solution.agg(F.sum(F.when(F.col("parent_id") == -1, F.col("objective")))).head()[0]


def test_painted_labels(tracker, spark, tmp_path):
    """Each pixel of the two objects has its track's number, in every frame, and the raster reads back as painted."""
    ids = {(r["t"], int(r["y"])): r["track_id"] for r in tracker.tracks().collect()}
    moving, resting = (next(i for (t, y), i in ids.items() if t == 0 and (y < 15) == low) for low in (True, False))
    want = {(t, y, x): moving for t in range(3) for y in range(4, 10) for x in range(4 + t, 10 + t)}
    want |= {(t, y, x): resting for t in range(3) for y in range(20, 25) for x in range(20, 25)}
    assert {(r["t"], r["y"], r["x"]): r["label"] for r in tracker.labels().collect()} == want
    tracker.export_labels(str(tmp_path / "labels"), (4, 32, 32), (1, 16, 16))
    assert {(r["t"], r["y"], r["x"]): r["value"] for r in read_chunks(spark, str(tmp_path / "labels")).collect()} == want
    with pytest.raises(FileExistsError):
        tracker.export_labels(str(tmp_path / "labels"), (4, 32, 32))
    with pytest.raises(ValueError):
        Tracker(spark).labels()


def test_steps_need_the_ones_before(spark):
    with pytest.raises(ValueError):
        Tracker(spark).link()
    with pytest.raises(ValueError):
        Tracker(spark).tracks()


def test_formats(tracker, spark, tmp_path):
    import xml.etree.ElementTree as ET

    for kind in ("csv", "parquet", "json", "dot", "xml", "geff", "ctc"):
        tracker.export(str(tmp_path / f"out.{kind}"))
        with pytest.raises(Exception):
            tracker.export(str(tmp_path / f"out.{kind}"))
    with pytest.raises(ValueError):
        tracker.export(str(tmp_path / "out.unknown"))
    again = [formats.read_tracks(spark, str(tmp_path / f"out.{k}")) for k in ("csv", "parquet")]
    assert sorted(map(str, again[0].collect())) == sorted(map(str, again[1].collect()))
    text = "".join(r["value"] for r in formats.trackmate_lines(tracker.tracks()).collect())
    root = ET.fromstring(text)
    assert len(root.findall(".//Spot")) == 6 and len(root.findall(".//Edge")) == 4
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "other.parquet"))
    assert formats.read_tracks(spark, str(tmp_path / "other.parquet")) is None


def test_stream(spark, tmp_path):
    schema = "id long, t int, z double, y double, x double, h int, area int"
    for t in range(4):
        spark.createDataFrame([(10 * t + k, t, 0.0, 9.0 * k, 1.0 * t, 3, 49) for k in range(4)], schema).write.mode("append").parquet(str(tmp_path / "nodes"))
        if t in (1, 3):
            link_stream(spark, str(tmp_path / "nodes"), schema, str(tmp_path / "links"), str(tmp_path / "check"), 6.0).awaitTermination()
    found = sorted((r["source_id"], r["target_id"]) for r in stream_links(spark, str(tmp_path / "links")).collect())
    assert found == [(10 * t + k, 10 * (t + 1) + k) for t in range(3) for k in range(4)]
