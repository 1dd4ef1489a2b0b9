"""Statistics over tracks, and the steps that repair them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import l2
from ..sources.durable import durable
from .assigning import assigned, nearest_total
from .lineage import NO_PARENT, first_rows, heads, inverse_forest, lineage_pairs, relabel_tracks, track_roots, with_roots
from .nearest import nearest
from .ranks import numbered, quantiles

AXES = ("z", "y", "x")


def movement(tracks: DataFrame, lag: int = 1, cols=AXES) -> DataFrame:
    """tracks with cols replaced by their change over lag rows of the track, 0 where there is no such row."""
    if "track_id" not in tracks.columns:
        tracks = tracks.withColumn("track_id", F.lit(0).cast("bigint"))
    w = Window.partitionBy("track_id").orderBy("t")
    return tracks.withColumns({c: F.coalesce(F.col(c) - F.lag(c, lag).over(w), F.lit(0.0)) for c in cols})


def drift(tracks: DataFrame, quantile: float = 0.99) -> DataFrame:
    """(drift): the quantile of all displacements, first rows among them."""
    norm = l2([F.col(c) for c in AXES], [F.lit(0.0)] * 3)
    return quantiles(movement(tracks).select(norm.alias("_way")), "_way", [quantile]).select(F.col("q")[0].alias("drift"))


def spans(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track_id").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.min("parent_track_id").alias("parent_track_id")
    )


def track_lengths(tracks: DataFrame, include_appearing: bool = True, include_disappearing: bool = True) -> DataFrame:
    """(track_id, start, end, parent_track_id, length).

    Without appearing ones: tracks that start after frame 0 without a parent go. Without disappearing ones: then, tracks
    go that end before the last end of those left and are no parent of one left.
    """
    out = spans(tracks).withColumn("length", F.col("end") - F.col("start") + 1)
    if not include_appearing:
        out = out.where((F.col("start") == 0) | (F.col("parent_track_id") != NO_PARENT))
    if not include_disappearing:
        out = durable(out)
        last = out.agg(F.max("end").alias("_last"))
        parents = out.select(F.col("parent_track_id").alias("_p")).distinct()
        out = out.join(F.broadcast(last), F.col("end") <= F.col("_last")).join(parents, F.col("track_id") == F.col("_p"), "left")
        out = out.where((F.col("end") == F.col("_last")) | F.col("_p").isNotNull()).drop("_last", "_p")
    return out


def ctc_table(tracks: DataFrame) -> DataFrame:
    """(L, B, E, P) of the Cell Tracking Challenge: label, first and last frame, parent or 0."""
    p = F.when(F.col("parent_track_id") == NO_PARENT, 0).otherwise(F.col("parent_track_id")).cast("bigint")
    return spans(tracks).select(F.col("track_id").alias("L"), F.col("start").alias("B"), F.col("end").alias("E"), p.alias("P"))


def sequential_labels(tracks: DataFrame) -> DataFrame:
    """tracks with ids from 1 without gaps, in the order of the old ones, children and parents alike."""
    return relabel_tracks(tracks, numbered(tracks.select(F.col("track_id").alias("old")).distinct(), "new", "old"))


def track_starts(tracks: DataFrame) -> DataFrame:
    """The first row of each track without a parent."""
    w = Window.partitionBy("track_id").orderBy("t")
    roots = tracks.where(F.col("parent_track_id") == NO_PARENT)
    return roots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def track_ends(tracks: DataFrame) -> DataFrame:
    """The last row of each track that is no parent."""
    parents = first_rows(tracks).select(F.col("parent_track_id").alias("track_id")).distinct()
    w = Window.partitionBy("track_id").orderBy(F.desc("t"))
    leaves = tracks.join(parents, "track_id", "left_anti")
    return leaves.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def profile(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """(track_id, t, attribute, value) for every track, frame and attribute; 0 where a track isn't there."""
    frames = F.sequence(F.lit(0), F.lit(tracks.agg(F.max("t")).head()[0] or 0))
    grid = tracks.select("track_id").distinct().withColumn("t", F.explode(frames))
    long = tracks.select("track_id", "t", *columns).unpivot(["track_id", "t"], columns, "attribute", "value")
    names = grid.withColumn("attribute", F.explode(F.array(*map(F.lit, columns))))
    return names.join(long, ["track_id", "t", "attribute"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def profile_matrix(tracks: DataFrame, column: str) -> DataFrame:
    """A row a track, a column a frame."""
    return tracks.groupBy("track_id").pivot("t").agg(F.first(column)).fillna(0)


def trajectories_to_tracks(trajectories: DataFrame) -> DataFrame:
    """(track_id, points array) to a row a point."""
    out = trajectories.select("track_id", F.posexplode("points").alias("t", "point"))
    return out.select("track_id", "t", *(F.col("point")[k].alias(a) for k, a in enumerate(AXES)))


#: Distances of two places, by name.
METRICS: dict[str, Callable[[list[Column], list[Column]], Column]] = {
    "euclidean": l2,
    "sqeuclidean": lambda a, b: sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)),
    "cityblock": lambda a, b: sum((F.abs(p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)),
    "chebyshev": lambda a, b: F.greatest(*(F.abs(p - q) for p, q in zip(a, b, strict=True))),
}


def tree_radius(rooted: DataFrame, metric: str | Callable[[list[Column], list[Column]], Column] = "euclidean") -> DataFrame:
    """(root_id, radius): the largest distance of two rows of one tree and frame. rooted has root_id.

    metric is one of METRICS, or a function of the places' columns that gives a Column.
    """
    between = METRICS[metric] if isinstance(metric, str) else metric
    a, b = rooted.alias("a"), rooted.alias("b")
    on = [F.col("a.root_id") == F.col("b.root_id"), F.col("a.t") == F.col("b.t"), F.col("a.id") < F.col("b.id")]
    far = between([F.col(f"a.{c}") for c in AXES], [F.col(f"b.{c}") for c in AXES])
    radius = a.join(b, on).groupBy("a.root_id").agg(F.max(far).alias("radius"))
    return rooted.select("root_id").distinct().join(radius, "root_id", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))


def by_trees(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """rooted with the size of its tree (root_id, size), sorted: largest trees first, of equal ones the smaller root_id, each
    by track and frame. Trees without a size come last. A sort by ranges; no task holds more than its range."""
    return rooted.join(sizes, "root_id", "left").orderBy(F.col("size").desc_nulls_last(), "root_id", "track_id", "t")


def trees_by_length(tracks: DataFrame) -> DataFrame:
    """tracks with root_id and size, the tree's length, the longest first."""
    return by_trees(with_roots(tracks), tree_lengths(tracks).withColumnRenamed("length", "size"))


def trees_by_radius(tracks: DataFrame, metric: str | Callable[[list[Column], list[Column]], Column] = "euclidean") -> DataFrame:
    """tracks with root_id and size, the largest distance within a frame of the tree, the widest first."""
    rooted = with_roots(tracks)
    return by_trees(rooted, tree_radius(rooted, metric).withColumnRenamed("radius", "size"))


def tree_lengths(tracks: DataFrame) -> DataFrame:
    """(root_id, length): a track's rows, and where it has children one more and the mean of theirs, and so on down.

    A mean of means is a weighted sum over the tree: a track weighs one over the product of how many children each track
    above it has.
    """
    rows = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    children = inverse_forest(tracks).groupBy(F.col("parent_track_id").alias("ancestor")).agg(F.count(F.lit(1)).alias("children"))
    above = lineage_pairs(tracks).join(children, "ancestor", "left")
    share = F.when(F.col("depth") > 0, 1 / F.col("children")).otherwise(F.lit(1.0))
    own = F.max(F.when((F.col("depth") == 0) & F.col("children").isNotNull(), 1).otherwise(0))
    weighed = above.groupBy("track_id").agg(F.max_by("ancestor", "depth").alias("root_id"), F.product(share).alias("weight"), own.alias("more"))
    return weighed.join(rows, "track_id").groupBy("root_id").agg(F.sum(F.col("weight") * (F.col("n") + F.col("more"))).alias("length"))


def _squares(rows: DataFrame, side: str, width: Column, around: bool = False) -> DataFrame:
    """rows with the square (_gy, _gx) of that width that they lie in; around, once for it and each of the eight beside it."""
    rows = rows.withColumns({f"_g{c}": F.floor(F.col(f"_{side}{c}") / width) for c in "yx"})
    if around:
        for c in "yx":
            rows = rows.withColumn("_step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"_g{c}", F.col(f"_g{c}") + F.col("_step")).drop("_step")
    return rows


def gap_candidates(tracks: DataFrame, max_gap: int, max_radius: float) -> DataFrame:
    """(end_track, start_track, gap, dist) of ends and later starts within reach in time and space.

    Ends meet the starts of their own and the eight squares around, of the radius' width.
    """
    ends = track_ends(tracks).select(F.col("track_id").alias("end_track"), F.col("t").alias("t_end"), *(F.col(c).alias(f"_e{c}") for c in AXES))
    starts = track_starts(tracks).select(F.col("track_id").alias("start_track"), F.col("t").alias("t_start"), *(F.col(c).alias(f"_s{c}") for c in AXES))
    ends = ends.withColumn("gap", F.explode(F.sequence(F.lit(1), F.lit(max_gap)))).withColumn("t_start", F.col("t_end") + F.col("gap") + 1)
    dist = l2([F.col(f"_e{c}") for c in AXES], [F.col(f"_s{c}") for c in AXES])
    width = F.lit(float(max_radius or 1))
    pairs = _squares(ends, "e", width, around=True).join(_squares(starts, "s", width), ["t_start", "_gy", "_gx"]).withColumn("dist", dist)
    return pairs.where((F.col("dist") < max_radius) & (F.col("end_track") != F.col("start_track"))).select("end_track", "start_track", "gap", "dist")


def interpolated(tracks: DataFrame, joins: DataFrame) -> DataFrame:
    """Rows on the straight way between an end and a start, for (end_track, start_track); track_id is the start's."""
    e = track_ends(tracks).select(F.col("track_id").alias("end_track"), F.col("t").alias("_te"), *(F.col(c).alias(f"_e{c}") for c in AXES))
    s = track_starts(tracks).select(F.col("track_id").alias("start_track"), F.col("t").alias("_ts"), *(F.col(c).alias(f"_s{c}") for c in AXES))
    rows = joins.join(e, "end_track").join(s, "start_track").where("_ts - _te > 1")
    rows = rows.withColumn("t", F.explode(F.sequence(F.col("_te") + 1, F.col("_ts") - 1)))
    share = (F.col("t") - F.col("_te")) / (F.col("_ts") - F.col("_te"))
    return rows.select(F.col("start_track").alias("track_id"), "t", *((F.col(f"_e{c}") + (F.col(f"_s{c}") - F.col(f"_e{c}")) * share).alias(c) for c in AXES))


def gap_joins(tracks: DataFrame, max_gap: int, max_radius: float) -> DataFrame:
    """(end_track, start_track) of the gaps that close_gaps() closes."""
    ends = durable(track_ends(tracks).select(F.col("track_id").alias("id"), "t", *AXES))
    starts = durable(track_starts(tracks).select(F.col("track_id").alias("id"), "t", *AXES))
    joins = None
    for gap in range(1, max_gap + 1):
        own = ends.withColumn("t", F.col("t") + gap + 1)
        if joins is not None:
            own, starts_left = (x.join(joins.select(F.col(c).alias("id")), "id", "left_anti") for x, c in ((own, "end_track"), (starts, "start_track")))
        else:
            starts_left = starts
        found = assigned(own, starts_left, "t").where(F.col("dist") < max_radius)
        found = durable(found.select(F.col("left_id").alias("end_track"), F.col("right_id").alias("start_track")))
        joins = found if joins is None else durable(joins.unionByName(found))
    return ends.select(F.col("id").alias("end_track"), F.col("id").alias("start_track")).limit(0) if joins is None else joins


def _first_of_chain(tracks: DataFrame, joins: DataFrame) -> DataFrame:
    """(old, new): what the tracks of each chain of joins are called that aren't its first."""
    edges = tracks.select(F.col("track_id").alias("id")).distinct().join(joins.select(F.col("start_track").alias("id"), F.col("end_track").alias("parent")), "id", "left")
    return heads(edges.fillna(NO_PARENT, ["parent"])).where("id <> root").select(F.col("id").alias("old"), F.col("root").alias("new"))


def close_gaps(tracks: DataFrame, max_gap: int, max_radius: float) -> DataFrame:
    """tracks (track_id, t, z, y, x, parent_track_id) with gaps of up to max_gap frames closed.

    Gap by gap, the ends of each frame and the starts as many frames later are assigned at least total distance over all
    their pairs; then those max_radius apart or more are given up. An end or a start that is joined takes no part in
    longer gaps. The start's track takes the id and the parent of the end's, all along a chain; children follow; rows are
    interpolated between the two.
    """
    rows = tracks.select("track_id", "t", *AXES, "parent_track_id")
    joins = gap_joins(rows, max_gap, max_radius)
    new = interpolated(rows, joins).withColumn("parent_track_id", F.lit(NO_PARENT).cast("bigint"))
    merged = relabel_tracks(rows.unionByName(new), durable(_first_of_chain(rows, joins)))
    # A joined track has the parent of its first part; the others had none.
    return durable(merged.withColumn("parent_track_id", F.max("parent_track_id").over(Window.partitionBy("track_id"))))


def _fate(c: Column, n: Column, f: str, min_length: int) -> tuple[Column, Column]:
    """What a track makes of its open child, which is childless (c) or not and n long, if f are the columns of its rule."""
    short = c & (n <= min_length)
    through = F.col(f"{f}through")
    return (
        F.when(short, F.col(f"{f}short_c")).when(through, c).otherwise(F.col(f"{f}long_c")),
        F.when(short, F.col(f"{f}short_n")).when(through, n + F.col(f"{f}add")).otherwise(F.col(f"{f}long_n")),
    )


def merged_lengths(rows: DataFrame, min_length: int) -> DataFrame:
    """(track_id, childless, length) of all tracks once everything below them is decided, from (track_id, n, a, b): a and b are
    the children, null for a leaf.

    A child is short if it is childless and at most min_length long; of two children, exactly one of which is short, the
    other becomes part of the parent. A track with one decided child is a rule on what the other one comes to: short, or
    not, and then either a fixed result or the child's with a length added. Such rules follow one another, so chains of
    them halve in every round, as chains of pointers do, while decided children decide their parents: log2 rounds of any
    forest's size, and no task that holds a tree.
    """
    rows = durable(rows)
    known = durable(rows.where("a IS NULL").select("track_id", F.lit(True).alias("childless"), F.col("n").alias("length")))
    open_ = rows.where("a IS NOT NULL")
    rules: DataFrame | None = None
    while True:
        side = lambda x: known.select(F.col("track_id").alias(x), F.col("childless").alias(f"{x}_c"), F.col("length").alias(f"{x}_n"))
        state = durable(open_.join(side("a"), "a", "left").join(side("b"), "b", "left"))
        short = {x: F.col(f"{x}_c") & (F.col(f"{x}_n") <= min_length) for x in "ab"}
        one = short["a"] != short["b"]
        stays = lambda kind: F.when(short["a"], F.col(f"b_{kind}")).otherwise(F.col(f"a_{kind}"))
        both = F.col("a_c").isNotNull() & F.col("b_c").isNotNull()
        new = state.where(both).select("track_id", F.when(one, stays("c")).otherwise(F.lit(False)).alias("childless"), F.when(one, F.col("n") + stays("n")).otherwise(F.col("n")).alias("length"))
        # Rules of tracks of which one child has come to be known.
        half = state.where(F.col("a_c").isNull() != F.col("b_c").isNull())
        c, n = F.coalesce("a_c", "b_c"), F.coalesce("a_n", "b_n")
        is_short = c & (n <= min_length)
        made = half.select(
            "track_id", F.when(F.col("a_c").isNull(), F.col("a")).otherwise(F.col("b")).alias("to"), is_short.alias("through"), F.col("n").alias("add"),
            F.when(is_short, F.lit(False)).otherwise(c).alias("short_c"), F.when(is_short, F.col("n")).otherwise(F.col("n") + n).alias("short_n"), F.lit(False).alias("long_c"), F.col("n").alias("long_n"),
        )
        rules = made if rules is None else rules.unionByName(made.join(rules.select("track_id"), "track_id", "left_anti"))
        rules = durable(rules)
        # A rule on a track that is one itself becomes one on what that is on.
        after = rules.select(F.col("track_id").alias("to"), *(F.col(x).alias(f"_{x}") for x in rules.columns if x != "track_id"))
        steps = rules.join(after, "to", "left")
        short_c, short_n = _fate(F.col("_short_c"), F.col("_short_n"), "", min_length)
        long_c, long_n = _fate(F.col("_long_c"), F.col("_long_n"), "", min_length)
        is_step, passed = F.col("_to").isNotNull(), F.col("_through") & F.col("through")
        fixed = lambda own, reached: F.when(F.col("_through"), F.col(own)).otherwise(reached)
        joined = {
            "to": F.coalesce("_to", "to"), "through": F.when(is_step, passed).otherwise(F.col("through")), "add": F.when(is_step, F.col("add") + F.col("_add")).otherwise(F.col("add")),
            "short_c": F.when(is_step, short_c).otherwise(F.col("short_c")), "short_n": F.when(is_step, short_n).otherwise(F.col("short_n")),
            "long_c": F.when(is_step, fixed("long_c", long_c)).otherwise(F.col("long_c")), "long_n": F.when(is_step, fixed("long_n", long_n)).otherwise(F.col("long_n")),
        }
        rules = steps.select("track_id", *(v.alias(k) for k, v in joined.items()))
        ends = rules.join(known.select(F.col("track_id").alias("to"), "childless", "length"), "to")
        c, n = _fate(F.col("childless"), F.col("length"), "", min_length)
        new = durable(new.unionByName(ends.select("track_id", c.alias("childless"), n.alias("length"))).dropDuplicates(["track_id"]))
        known = durable(known.unionByName(new))
        open_ = durable(open_.join(new.select("track_id"), "track_id", "left_anti"))
        rules = durable(rules.join(new.select("track_id"), "track_id", "left_anti"))
        if not open_.head(1):
            return known


def short_sibling_mapping(tracks: DataFrame, min_length: int) -> DataFrame:
    """(old, new) of the tracks that filter_short_siblings() changes; new is null for those that go. For tracks and segments."""
    first = tracks.groupBy("track_id").agg(F.min("parent_track_id").alias("parent"), F.count(F.lit(1)).alias("n"))
    first = durable(first)
    below = first.groupBy(F.col("parent").alias("track_id")).agg(F.min("track_id").alias("a"), F.max("track_id").alias("b"), F.count(F.lit(1)).alias("children"))
    rows = durable(first.join(below, "track_id", "left"))
    if rows.where("children <> 2").head(1):
        raise ValueError("a track has one child or more than two")
    known = merged_lengths(rows.select("track_id", "n", "a", "b"), min_length)
    is_short = known.select("track_id", (F.col("childless") & (F.col("length") <= min_length)).alias("short"))
    pairs = rows.where("a IS NOT NULL").select("track_id", "a", "b")
    for x in "ab":
        pairs = pairs.join(is_short.toDF(x, f"short_{x}"), x)
    pairs = durable(pairs.where("short_a <> short_b"))
    gone = pairs.select(F.when(F.col("short_a"), F.col("a")).otherwise(F.col("b")).alias("old"), F.lit(None).cast("bigint").alias("new"))
    taken = pairs.select(F.when(F.col("short_a"), F.col("b")).otherwise(F.col("a")).alias("id"), F.col("track_id").alias("parent"))
    edges = first.select(F.col("track_id").alias("id")).join(taken, "id", "left").fillna(NO_PARENT, ["parent"])
    return gone.unionByName(heads(edges).where("id <> root").select(F.col("id").alias("old"), F.col("root").alias("new")))


def filter_short_siblings(tracks: DataFrame, min_length: int) -> DataFrame:
    """tracks without short siblings. From leaves up: of two children, exactly one of which is childless and at most
    min_length long, that one goes and the other merges into the parent, which takes over its children. ValueError if a track
    has one child or more than two."""
    mapping = durable(short_sibling_mapping(tracks, min_length))
    kept = tracks.join(mapping.where("new IS NULL").select(F.col("old").alias("track_id")), "track_id", "left_anti")
    found = relabel_tracks(kept, mapping.where("new IS NOT NULL"))
    # The parent of a merged track's first part is that of the whole.
    top = tracks.select(F.col("track_id"), F.col("parent_track_id").alias("_top")).distinct()
    found = found.join(relabel_tracks(top.withColumnRenamed("_top", "parent_track_id").join(mapping.select(F.col("old").alias("track_id")), "track_id", "left_anti"), mapping.where("new IS NOT NULL")).select("track_id", F.col("parent_track_id").alias("_top")), "track_id")
    return found.withColumn("parent_track_id", F.col("_top")).drop("_top")


def _near_stitches(tracks: DataFrame, quantile: float) -> DataFrame:
    """(t, end_track, start_track, dist): ends, and starts of the next frame t nearer than the drift."""
    limit = F.broadcast(drift(tracks, quantile))
    e = track_ends(tracks).select(F.col("track_id").alias("end_track"), (F.col("t") + 1).alias("t"), *(F.col(c).alias(f"_e{c}") for c in AXES))
    s = track_starts(tracks).select(F.col("track_id").alias("start_track"), "t", *(F.col(c).alias(f"_s{c}") for c in AXES))
    dist = l2([F.col(f"_e{c}") for c in AXES], [F.col(f"_s{c}") for c in AXES])
    e, s = (x.join(limit, F.col("drift") > 0) for x in (e, s))
    pairs = _squares(e, "e", F.col("drift"), around=True).join(_squares(s, "s", F.col("drift")).drop("drift"), ["t", "_gy", "_gx"])
    return pairs.withColumn("dist", dist).where("dist < drift").select("t", "end_track", "start_track", "dist")


def _mutually_nearest(pairs: DataFrame) -> DataFrame:
    """Each end's nearest start, and of those the nearest end for each start; of equal distances the least ids."""
    for side in ("end_track", "start_track"):
        w = Window.partitionBy(side).orderBy("dist", "start_track", "end_track")
        pairs = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return pairs


def stitch_candidates(tracks: DataFrame, quantile: float = 0.99) -> DataFrame:
    """(end_track, start_track, dist): each end's nearest start of the next frame, nearer than the drift, and of those the
    nearest end for each start."""
    e = durable(track_ends(tracks).select(F.col("track_id").alias("end_track"), (F.col("t") + 1).alias("_t"), *AXES))
    s = durable(track_starts(tracks).select(F.col("track_id").alias("id"), F.col("t").alias("_t"), *AXES))
    limit = drift(tracks, quantile).head()["drift"]
    if not limit or not limit > 0:
        return e.select("end_track", F.col("end_track").alias("start_track"), F.lit(0.0).alias("dist")).limit(0)
    pairs = e.join(nearest(s, e, 1, limit, AXES), ["_t", *AXES]).groupBy(F.col("id").alias("start_track"))
    return pairs.agg(F.min(F.struct("dist", "end_track")).alias("_end")).select("_end.end_track", "start_track", "_end.dist")


def stitch_tracks(tracks: DataFrame, quantile: float = 0.99, selected: DataFrame | None = None) -> DataFrame:
    """tracks in which the end and the start of each stitch are one track, all along a chain; it has the first one's id.

    Without selected all ends and all starts take part, and all tracks stay. With it, a table of track_id, ends of selected
    tracks take starts of tracks that aren't; what descends from a track so taken is selected from its frame on, and all
    tracks that aren't selected in the end go. Frames with candidates are decided one after the other, as what they select
    decides on later ones.
    """
    if selected is None:
        joins = durable(stitch_candidates(tracks, quantile).select("end_track", "start_track"))
    else:
        joins, selected = _joins_of_selected(tracks, quantile, selected)
        tracks = tracks.join(selected, "track_id", "left_semi")
    merged = relabel_tracks(tracks, durable(_first_of_chain(tracks, joins)))
    # A stitched track has the parent of its first part; the others are roots.
    return merged.withColumn("parent_track_id", F.max("parent_track_id").over(Window.partitionBy("track_id")))


def _joins_of_selected(tracks: DataFrame, quantile: float, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(end_track, start_track) of all stitches, and the track_ids that are selected in the end."""
    near = durable(_near_stitches(tracks, quantile))
    roots = durable(track_roots(tracks))
    selected = durable(selected.select("track_id").distinct())
    joins = durable(near.select("end_track", "start_track").limit(0))
    for row in near.select("t").distinct().orderBy("t").collect():  # one row a frame
        open_ = near.where(F.col("t") == row["t"]).join(selected.withColumnRenamed("track_id", "end_track"), "end_track", "left_semi")
        new = _mutually_nearest(open_.join(selected.withColumnRenamed("track_id", "start_track"), "start_track", "left_anti"))
        new = durable(new.select("end_track", "start_track"))
        if new.head(1):
            below = roots.join(new.select(F.col("start_track").alias("root_id")), "root_id", "left_semi").select("track_id")
            selected, joins = durable(selected.unionByName(below).distinct()), durable(joins.unionByName(new))
    return joins, selected


def first_frame_tracks(tracks: DataFrame, markers: DataFrame, stitch: bool = False, quantile: float = 0.99) -> DataFrame:
    """The tracks that descend from roots of frame 0 which markers (id, z, y, x) are assigned to, at least total distance.

    Roots are the rows of frame 0, whichever track they are of. With stitch, see stitch_tracks().
    """
    first = tracks.where("t = 0").select(F.col("track_id").alias("id"), *AXES)
    taken = nearest_total(markers, first).select(F.col("right_id").alias("root_id"))
    chosen = durable(track_roots(tracks).join(taken, "root_id", "left_semi").select("track_id"))
    return stitch_tracks(tracks, quantile, chosen) if stitch else tracks.join(chosen, "track_id", "left_semi")
