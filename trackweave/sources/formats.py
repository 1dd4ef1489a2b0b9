"""Readers and writers of tracks, graphs and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import NO_PARENT, forest_edges
from ..operators.tracks import ctc_table

REQUIRED = ("track_id", "t", "y", "x")
COLUMNS = {"track_id": "bigint", "t": "int", "z": "double", "y": "double", "x": "double", "id": "bigint", "parent_track_id": "bigint", "parent_id": "bigint"}


def read_tracks(spark: SparkSession, *paths: str) -> DataFrame | None:
    """Tracks from CSV or Parquet files of one kind; None if a required column is missing, z is 0 if it is."""
    kinds = {p.rstrip("/").rsplit(".", 1)[-1].lower() for p in paths}
    if kinds == {"csv"}:
        df = spark.read.option("header", True).csv(list(paths))
    elif kinds == {"parquet"}:
        df = spark.read.parquet(*paths)
    else:
        raise ValueError(f"can't read {sorted(kinds)}")
    if not set(REQUIRED) <= set(df.columns):
        return None
    if "z" not in df.columns:
        df = df.withColumn("z", F.lit(0.0))
    return df.withColumns({c: F.col(c).cast("double").cast(k) if k != "double" else F.col(c).cast(k) for c, k in COLUMNS.items() if c in df.columns})


def write_tracks(tracks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes by extension: csv, parquet, json (node-link lines), dot, xml (TrackMate), geff (tables), ctc (table)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    mode = "overwrite" if overwrite else "errorifexists"
    writers = {
        "csv": lambda: tracks.write.mode(mode).option("header", True).csv(path),
        "parquet": lambda: tracks.write.mode(mode).parquet(path),
        "json": lambda: node_link_lines(tracks).write.mode(mode).text(path),
        "dot": lambda: dot_lines(tracks).write.mode(mode).text(path),
        "xml": lambda: trackmate_lines(tracks).write.mode(mode).text(path),
        "geff": lambda: write_graph(tracks, path, mode),
        "ctc": lambda: ctc_table(tracks).select(F.concat_ws(" ", "L", "B", "E", "P").alias("value")).write.mode(mode).text(path),
    }
    if kind not in writers:
        raise ValueError(f"can't write {kind!r}; known are {sorted(writers)}")
    writers[kind]()


def node_link_lines(tracks: DataFrame) -> DataFrame:
    """(value): a JSON object a node, then a link; each line stands by itself, so parts are written in parallel."""
    nodes = tracks.select(F.to_json(F.struct(F.lit("node").alias("kind"), *tracks.columns)).alias("value"))
    links = forest_edges(tracks).select(F.to_json(F.struct(F.lit("link").alias("kind"), "source", "target")).alias("value"))
    return nodes.unionByName(links)


def dot_lines(tracks: DataFrame) -> DataFrame:
    """(value): statements of a DOT graph in file order; its braces are the first and the last line."""
    edges = forest_edges(tracks).select(F.format_string("  %d -> %d;", "source", "target").alias("value"), F.lit(2).alias("o"))
    nodes = tracks.select(F.format_string("  %d;", F.col("id")).alias("value"), F.lit(1).alias("o"))
    spark = tracks.sparkSession
    ends = spark.createDataFrame([("digraph tracks {", 0), ("}", 3)], "value string, o int")
    return ends.unionByName(nodes).unionByName(edges).orderBy("o", "value").select("value")


def trackmate_lines(tracks: DataFrame) -> DataFrame:
    """(value): TrackMate XML in file order: spots by frame, tracks with their edges, and the model around them.

    Ids must be unique. Frames and tracks are sorted by range, so no task holds the file.
    """
    if tracks.groupBy("id").count().where("count > 1").head(1):
        raise ValueError("ids aren't unique")
    spot = F.format_string(
        '<Spot ID="%d" name="%d" FRAME="%d" POSITION_T="%d" POSITION_X="%s" POSITION_Y="%s" POSITION_Z="%s" QUALITY="1.0" VISIBILITY="1" RADIUS="5.0"/>',
        "id", "id", "t", "t", F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string"),
    )
    line = lambda df, section, key, step, value: df.select(F.lit(section).alias("s"), key.cast("bigint").alias("k"), F.lit(step).alias("p"), value.alias("value"))
    frames = tracks.select("t").distinct()
    edges = forest_edges(tracks).join(tracks.select(F.col("id").alias("target"), "t", "track_id"), "target")
    edge = F.format_string('<Edge SPOT_SOURCE_ID="%d" SPOT_TARGET_ID="%d" LINK_COST="-1.0" EDGE_TIME="%s"/>', "source", "target", (F.col("t") - 0.5).cast("string"))
    ids = tracks.select("track_id").distinct()
    fixed = [
        (0, 0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, 1, 0, '<TrackMate version="7.11.1"><Model spatialunits="pixel" timeunits="frame">'), (0, 2, 0, "<AllSpots>"),
        (2, 0, 0, "</AllSpots><AllTracks>"), (4, 0, 0, "</AllTracks><FilteredTracks>"), (6, 0, 0, "</FilteredTracks></Model></TrackMate>"),
    ]
    parts = [
        tracks.sparkSession.createDataFrame(fixed, "s int, k long, p int, value string"),
        line(frames, 1, F.col("t"), 0, F.format_string('<SpotsInFrame frame="%d">', "t")), line(tracks, 1, F.col("t"), 1, spot), line(frames, 1, F.col("t"), 2, F.lit("</SpotsInFrame>")),
        line(ids, 3, F.col("track_id"), 0, F.format_string('<Track name="Track_%d" TRACK_ID="%d">', "track_id", "track_id")), line(edges, 3, F.col("track_id"), 1, edge), line(ids, 3, F.col("track_id"), 2, F.lit("</Track>")),
        line(ids, 5, F.col("track_id"), 0, F.format_string('<TrackID TRACK_ID="%d"/>', "track_id")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy("s", "k", "p", "value").select("value")


def write_graph(solution: DataFrame, path: str, mode: str = "errorifexists", links: DataFrame | None = None, overlaps: DataFrame | None = None) -> None:
    """Nodes, edges with weights (0 where there is no link) and overlaps as tables below path. Edges whose ends aren't
    both nodes are left out."""
    edges = forest_edges(solution)
    ids = solution.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if links is not None:
        weights = links.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "weight")
        edges = edges.join(weights, ["source", "target"], "left")
    else:
        edges = edges.withColumn("weight", F.lit(None).cast("double"))
    solution.write.mode(mode).parquet(f"{path}/nodes")
    edges.withColumn("weight", F.coalesce("weight", F.lit(0.0))).write.mode(mode).parquet(f"{path}/edges")
    if overlaps is not None:
        overlaps.write.mode(mode).parquet(f"{path}/overlaps")


def tracks_layer(nodes: DataFrame, with_z: bool = True) -> DataFrame:
    """Tracks in the order of track and frame, with the columns of two or three dimensions."""
    columns = ["track_id", "t", *(["z"] if with_z else []), "y", "x", *(c for c in ("id", "parent_track_id", "parent_id") if c in nodes.columns)]
    return nodes.select(*columns).orderBy("track_id", "t")


def lp_lines(nodes: DataFrame, links: DataFrame, overlaps: DataFrame, appear: float, disappear: float, division: float) -> DataFrame:
    """(value): the selection problem of one window in LP format, in file order. Nodes: id, first, last."""
    v = lambda letter, c="id": F.concat(F.lit(letter), F.col(c).cast("string"))
    x = F.concat(F.lit("x"), F.col("source_id").cast("string"), F.lit("_"), F.col("target_id").cast("string"))
    number = lambda c: F.format_string("%+.9f", c)
    line = lambda df, s, value: df.select(F.lit(s).alias("s"), value.alias("value"))
    inward = links.groupBy(F.col("target_id").alias("id")).agg(F.concat_ws(" + ", F.array_sort(F.collect_list(x))).alias("i"))
    outward = links.groupBy(F.col("source_id").alias("id")).agg(F.concat_ws(" + ", F.array_sort(F.collect_list(x))).alias("o"))
    both = nodes.join(inward, "id", "left").join(outward, "id", "left")
    cost = lambda flag, w: F.when(F.col(flag), F.lit(0.0)).otherwise(F.lit(float(w)))
    plus = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.col(c), F.lit(" + ")))
    minus = F.when(F.col("o").isNull(), F.lit("")).otherwise(F.concat(F.lit(" - "), F.regexp_replace("o", r" \+ ", " - ")))
    parts = [
        nodes.sparkSession.createDataFrame([(0, "Maximize"), (2, "Subject To"), (4, "Binaries"), (6, "End")], "s int, value string"),
        line(links, 1, F.concat(number(F.col("weight")), F.lit(" "), x)),
        line(nodes, 1, F.concat(number(cost("first", appear)), F.lit(" "), v("a"), F.lit(" "), number(cost("last", disappear)), F.lit(" "), v("d"), F.lit(" "), number(F.lit(float(division))), F.lit(" "), v("v"))),
        line(both, 3, F.concat(plus("i"), v("a"), F.lit(" - "), v("n"), F.lit(" = 0"))),
        line(both, 3, F.concat(v("n"), F.lit(" + "), v("v"), minus, F.lit(" - "), v("d"), F.lit(" = 0"))),
        line(nodes, 3, F.concat(v("n"), F.lit(" - "), v("v"), F.lit(" >= 0"))),
        line(overlaps, 3, F.concat(v("n", "node_id"), F.lit(" + "), v("n", "ancestor_id"), F.lit(" <= 1"))),
        line(nodes, 5, F.concat_ws(" ", v("n"), v("a"), v("d"), v("v"))), line(links, 5, x),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("s", "value").select("value")


def write_frames(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """Label frames (t, y, x, label) as Parquet, a folder a frame."""
    frames.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("t").parquet(path)


def roots_to_none(tracks: DataFrame) -> DataFrame:
    """Parents that are no tracks become NO_PARENT, for tables that were cut."""
    ids = tracks.select(F.col("track_id").alias("_p")).distinct()
    out = tracks.join(ids, F.col("parent_track_id") == F.col("_p"), "left")
    return out.withColumn("parent_track_id", F.when(F.col("_p").isNull(), F.lit(NO_PARENT).cast("bigint")).otherwise(F.col("parent_track_id"))).drop("_p")
