"""The registered queries of the library, each over whole tables, and what DuckDB computes for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import inside_border, link_function
from .operators import hierarchy, lineage, linking, matching, measures, pixels, rasters, solving, summary, tracks, truth
from .plans.config import TrackingConfig
from .plans.layout import window_table
from .sources.durable import durable
from .sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DISTANCE, NEIGHBORS, GAMMA = 15.0, 5, 0.001


def query(sql: str | None, *views: str):
    """Registers a function of the session and the table folder; sql runs on DuckDB, after the named views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def links(spark: SparkSession, d: str, k: int = NEIGHBORS, **more) -> DataFrame:
    return linking.knn_links(view(spark, d, "v_nodes"), DISTANCE, k, GAMMA, **more)


def _knn_sql(k: int = NEIGHBORS) -> str:
    return f"""WITH side AS (SELECT *, floor(y) - h AS y0, floor(y) + h + 1 AS y1, floor(x) - h AS x0, floor(x) + h + 1 AS x1 FROM v_nodes),
    pairs AS (SELECT s.id AS source_id, g.id AS target_id, s.t AS t_source,
        sqrt((s.z - g.z) * (s.z - g.z) + (s.y - g.y) * (s.y - g.y) + (s.x - g.x) * (s.x - g.x)) AS dist, s.area AS sa, g.area AS ga,
        greatest(least(s.y1, g.y1) - greatest(s.y0, g.y0), 0) * greatest(least(s.x1, g.x1) - greatest(s.x0, g.x0), 0) AS inter
      FROM side s JOIN side g ON g.t = s.t + 1 AND abs(s.x - g.x) < {DISTANCE} AND abs(s.y - g.y) < {DISTANCE}),
    near AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist, source_id) AS n FROM pairs WHERE dist < {DISTANCE}),
    weighed AS (SELECT source_id, target_id, t_source, dist, inter / (sa + ga - inter) - {GAMMA} * dist AS weight FROM near WHERE n <= {2 * k}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY weight DESC, dist, source_id DESC) AS n FROM weighed),
    links AS MATERIALIZED (SELECT source_id, target_id, t_source, dist, weight FROM ranked WHERE n <= {k})"""


KNN = _knn_sql()
TREE = """WITH RECURSIVE tr AS (SELECT track_id, min(parent_track_id) AS parent_track_id FROM v_tracks GROUP BY 1),
    up AS (SELECT track_id, track_id AS ancestor, 0 AS depth FROM tr
      UNION ALL SELECT u.track_id, p.parent_track_id, u.depth + 1 FROM up u JOIN tr p ON p.track_id = u.ancestor WHERE p.parent_track_id <> -1),
    roots AS (SELECT u.track_id, u.ancestor AS root_id FROM up u JOIN tr p ON p.track_id = u.ancestor WHERE p.parent_track_id = -1)"""
CLOSURE = """WITH RECURSIVE up AS (SELECT id AS node_id, hier_parent_id AS ancestor_id FROM v_hier WHERE hier_parent_id <> -1
      UNION ALL SELECT u.node_id, h.hier_parent_id FROM up u JOIN v_hier h ON h.id = u.ancestor_id WHERE h.hier_parent_id <> -1)"""


# Nodes


@query("SELECT t, count(*) AS n FROM v_nodes GROUP BY 1", "v_nodes")
def nodes_per_frame(spark, d):
    return summary.nodes_per_frame(view(spark, d, "v_nodes"))


@query("SELECT id, t, y, x, area FROM v_nodes WHERE selected AND t BETWEEN 5 AND 9", "v_nodes")
def frame_range_scan(spark, d):
    return summary.frame_range(view(spark, d, "v_nodes").where("selected"), 5, 9).select("id", "t", "y", "x", "area")


@query("SELECT id, t, area FROM v_nodes WHERE id IN (SELECT ev.event_id FROM events ev WHERE ev.event_type = 'purchase')", "v_nodes")
def node_lookup_semi(spark, d):
    ids = view(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    return view(spark, d, "v_nodes").join(ids, "id", "left_semi").select("id", "t", "area")


@query("SELECT id, t, area FROM v_nodes WHERE id NOT IN (SELECT ev.event_id FROM events ev WHERE ev.event_type = 'error')", "v_nodes")
def node_exclusion_anti(spark, d):
    ids = view(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return view(spark, d, "v_nodes").join(ids, "id", "left_anti").select("id", "t", "area")


@query("SELECT min(y) AS least, max(y) AS most FROM v_nodes WHERE t % (SELECT greatest(1, (max(t) + 1) // 10) FROM v_nodes) = 0", "v_nodes")
def sampled_min_max(spark, d):
    return summary.sampled_min_max(view(spark, d, "v_nodes"), "y")


@query("SELECT id, NOT (y >= 5 AND y <= 95 AND x >= 20 AND x <= 1420) AS is_border FROM v_nodes", "v_nodes")
def border_flag(spark, d):
    inside = inside_border([F.col("y"), F.col("x")], [100, 1440], [5, 20])
    return view(spark, d, "v_nodes").select("id", (~inside).alias("is_border"))


@query(
    """WITH n AS (SELECT tr.id, tr.y, tr.x, 5 AS h, coalesce(lag(tr.id) OVER (PARTITION BY track_id ORDER BY tr.t), -1) AS parent_id FROM v_tracks tr),
    k AS (SELECT * FROM n WHERE greatest(floor(y) - h, 10) < least(floor(y) + h + 1, 90) AND greatest(floor(x) - h, 100) < least(floor(x) + h + 1, 1340))
    SELECT k.id, CAST(coalesce(p.id, -1) AS BIGINT) AS parent_id FROM k LEFT JOIN k p ON p.id = k.parent_id""",
    "v_tracks",
)
def margin_filter_reroot(spark, d):
    nodes = view(spark, d, "v_tracks").withColumn("h", F.lit(5))
    before = F.expr("coalesce(lag(id) over (partition by track_id order by t), -1)")
    nodes = nodes.withColumn("parent_id", before)
    return summary.without_nodes(nodes, summary.outside_margin((10, 100), 100, 1440)).select("id", "parent_id")


@query(
    """WITH n AS (SELECT tr.id, tr.id % 7 + 3 AS h, coalesce(lag(tr.id) OVER (PARTITION BY track_id ORDER BY tr.t), -1) AS parent_id FROM v_tracks tr),
    k AS (SELECT * FROM n WHERE (2 * h + 1) * 0.1 >= 1) SELECT k.id, CAST(coalesce(p.id, -1) AS BIGINT) AS parent_id FROM k LEFT JOIN k p ON p.id = k.parent_id""",
    "v_tracks",
)
def rescale_filter_reroot(spark, d):
    nodes = view(spark, d, "v_tracks").withColumn("h", F.col("id") % 7 + 3)
    nodes = nodes.withColumn("parent_id", F.expr("coalesce(lag(id) over (partition by track_id order by t), -1)"))
    return summary.without_nodes(nodes, summary.vanishes(0.1)).select("id", "parent_id")


@query("SELECT id, t, area FROM v_nodes WHERE area >= 121 AND t <> 3", "v_nodes")
def attribute_filter(spark, d):
    return view(spark, d, "v_nodes").where(summary.compared("area", ">=", 121) & summary.compared("t", "!=", 3)).select("id", "t", "area")


@query("SELECT t, area FROM v_nodes WHERE t BETWEEN 3 AND 6", "v_nodes")
def frame_areas(spark, d):
    return summary.frame_range(view(spark, d, "v_nodes"), 3, 6).select("t", "area")


@query(
    """WITH h AS (SELECT CAST(floor(log2(area) * 100) AS INT) AS bin, count(*) AS n FROM v_nodes GROUP BY 1),
    m AS (SELECT bin, list_sort(list(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS five FROM h),
    s AS (SELECT bin, five[len(five) // 2 + 1] AS smooth FROM m),
    p AS (SELECT *, coalesce(lag(smooth) OVER (ORDER BY bin), -1) AS before, coalesce(lead(smooth) OVER (ORDER BY bin), -1) AS after FROM s)
    SELECT bin, smooth FROM p WHERE smooth > before AND smooth >= after ORDER BY smooth DESC, bin LIMIT 5""",
    "v_nodes",
)
def area_peaks(spark, d):
    return pixels.area_peaks(pixels.area_histogram(view(spark, d, "v_nodes")))


@query("SELECT CAST(floor(log2(area) * 100) AS INT) AS bin, count(*) AS n FROM v_nodes GROUP BY 1", "v_nodes")
def area_log_histogram(spark, d):
    return pixels.area_histogram(view(spark, d, "v_nodes"))


@query(
    """SELECT t, stat, value FROM (SELECT t, round(avg(y), 6) AS mean, min(y) AS min, max(y) AS max FROM v_nodes GROUP BY 1)
    UNPIVOT (value FOR stat IN (mean, min, max))""",
    "v_nodes",
)
def column_over_time(spark, d):
    return summary.column_over_time(view(spark, d, "v_nodes"), "y")


# Links


@query(KNN + " SELECT source_id, target_id, t_source, round(dist, 6) AS dist, round(weight, 6) AS weight FROM links", "v_nodes")
def knn_links(spark, d):
    return links(spark, d).withColumns({c: F.round(c, 6) for c in ("dist", "weight")})


@query(_knn_sql(2) + " SELECT source_id, target_id, t_source, round(dist, 6) AS dist, round(weight, 6) AS weight FROM links", "v_nodes")
def knn_links_two(spark, d):
    return links(spark, d, 2).withColumns({c: F.round(c, 6) for c in ("dist", "weight")})


@query(KNN + " SELECT source_id, target_id, round(pow(weight, 4), 6) AS weight FROM links", "v_nodes")
def link_weight_power(spark, d):
    return links(spark, d).select("source_id", "target_id", F.round(link_function(F.col("weight")), 6).alias("weight"))


@query(
    KNN + """ SELECT t_source, count(*) AS n, round(quantile_cont(weight, 0.25), 6) AS q1, round(quantile_cont(weight, 0.5), 6) AS q2,
    round(quantile_cont(weight, 0.75), 6) AS q3 FROM links GROUP BY 1""",
    "v_nodes",
)
def link_stats_per_frame(spark, d):
    return linking.link_weight_stats(links(spark, d)).withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@query(
    """WITH side AS (SELECT *, floor(y) - h AS y0, floor(y) + h + 1 AS y1, floor(x) - h AS x0, floor(x) + h + 1 AS x1 FROM v_nodes),
    p AS (SELECT a.id AS a_id, b.id AS b_id, a.area AS aa, b.area AS ba, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS i
      FROM side a JOIN side b ON a.t = b.t AND a.id < b.id AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1)
    SELECT a_id, b_id, CAST(i AS BIGINT) AS intersection, round(i / (aa + ba - i), 6) AS iou FROM p""",
    "v_nodes",
)
def box_intersections_same_frame(spark, d):
    # As its SQL rounds, without decimals for each pair.
    return linking.intersecting_pairs(view(spark, d, "v_nodes"), 9).withColumn("iou", F.floor(F.col("iou") * 1e6 + 0.5) / 1e6)


@query(
    """WITH p AS (SELECT s.id AS source_id, g.id AS target_id, round(list_sum(list_transform(range(1, len(s.embedding) + 1), lambda i: CAST(s.embedding[i] AS DOUBLE) * CAST(g.embedding[i] AS DOUBLE)))
      / sqrt(list_sum(list_transform(s.embedding, lambda v: CAST(v AS DOUBLE) * v)) * list_sum(list_transform(g.embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) AS weight
      FROM v_emb s JOIN v_emb g ON g.t = s.t + 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY weight DESC, source_id) AS n FROM p)
    SELECT source_id, target_id, weight FROM r WHERE n <= 3""",
    "v_emb",
)
def cosine_links_topk(spark, d):
    return linking.cosine_links(view(spark, d, "v_emb"), 3)


@query(
    KNN + """ SELECT source_id, target_id, s.area - g.area AS area, s.h - g.h AS h,
    round(sqrt((s.y - g.y) * (s.y - g.y) + (s.x - g.x) * (s.x - g.x) + (s.z - g.z) * (s.z - g.z)), 6) AS dist
    FROM links JOIN v_nodes s ON s.id = source_id JOIN v_nodes g ON g.id = target_id""",
    "v_nodes",
)
def link_features_diff(spark, d):
    diffs = lambda s, g: [F.struct(*linking.feature_diffs(["area", "h"])(s, g)).alias("diffs")]
    found = links(spark, d, extra=diffs).select("source_id", "target_id", "diffs.*")
    return found.withColumn("dist", F.round("dist", 6))


# Hierarchies


@query(CLOSURE + " SELECT node_id, ancestor_id FROM up", "v_hier")
def overlap_closure(spark, d):
    return hierarchy.overlap_closure(view(spark, d, "v_hier"))


@query(CLOSURE + " SELECT node_id, ancestor_id, t FROM up JOIN v_hier ON id = node_id WHERE t BETWEEN 3 AND 7", "v_hier")
def overlaps_in_window(spark, d):
    nodes = view(spark, d, "v_hier")
    return hierarchy.overlaps_in_window(hierarchy.overlap_closure(nodes), nodes, 3, 7)


@query("SELECT c.id, c.t, c.area FROM v_hier c WHERE c.area <= 170 AND NOT EXISTS (SELECT 1 FROM v_hier p WHERE p.id = c.hier_parent_id AND p.area <= 170)", "v_hier")
def topmost_nodes(spark, d):
    return hierarchy.topmost(view(spark, d, "v_hier"), F.col("area") <= 170).select("id", "t", "area")


@query(
    CLOSURE.replace("WITH RECURSIVE up", "WITH RECURSIVE rt AS (SELECT id, id AS root_id FROM v_hier WHERE hier_parent_id = -1 UNION ALL SELECT h.id, r.root_id FROM rt r JOIN v_hier h ON h.hier_parent_id = r.id), up")
    + """, n AS (SELECT h.id, h.t, h.area, root_id, row_number() OVER (PARTITION BY h.t, root_id ORDER BY h.area, h.id) AS k FROM v_hier h JOIN rt ON rt.id = h.id)
    SELECT id, t, area, root_id FROM n WHERE k = 1 OR area <= 150""",
    "v_hier",
)
def hierarchy_cut(spark, d):
    nodes = view(spark, d, "v_hier")
    roots = lineage.heads(nodes.select("id", F.col("hier_parent_id").alias("parent"))).withColumnRenamed("root", "root_id")
    return hierarchy.hierarchy_cut(nodes.join(roots, "id"), 150).select("id", "t", "area", "root_id")


@query(
    """WITH b AS (SELECT hier_parent_id AS p, max(height) AS birth FROM v_hier WHERE hier_parent_id <> -1 GROUP BY 1)
    SELECT id, CAST(height AS DOUBLE) AS node_death, round(coalesce(CAST(birth AS DOUBLE), (SELECT min(height) FROM v_hier) - 0.00001), 6) AS node_birth
    FROM v_hier LEFT JOIN b ON p = id""",
    "v_hier",
)
def persistence_features(spark, d):
    return hierarchy.persistence(view(spark, d, "v_hier")).select("id", "node_death", F.round("node_birth", 6).alias("node_birth"))


@query("SELECT c.id, coalesce(p.height, (SELECT max(height) FROM v_hier)) AS parent_frontier FROM v_hier c LEFT JOIN v_hier p ON p.id = c.hier_parent_id", "v_hier")
def parent_frontier(spark, d):
    return hierarchy.parent_frontier(view(spark, d, "v_hier")).select("id", "parent_frontier")


# Ground truth


def _gt_links(spark, d):
    return view(spark, d, "v_nodes").where("gt_track_id > 0").select(F.col("id").alias("source_id"), F.col("gt_track_id").alias("target_id"), (F.col("id") % 3 > 0).alias("selected"))


@query("SELECT id, CASE WHEN gt_track_id > 0 AND id % 3 > 0 THEN gt_track_id ELSE -1 END AS gt_track_id FROM v_nodes", "v_nodes")
def gt_left_join(spark, d):
    return matching.gt_matches(view(spark, d, "v_nodes").drop("gt_track_id"), _gt_links(spark, d)).select("id", "gt_track_id")


@query(
    CLOSURE + """, a AS (SELECT v.id, CASE WHEN v.id IN (SELECT u.node_id FROM up u JOIN v_nodes p ON p.id = u.ancestor_id WHERE p.gt_track_id <> -1) THEN 0 ELSE v.gt_track_id END AS g FROM v_nodes v)
    SELECT a.id, CAST(CASE WHEN a.id IN (SELECT u.ancestor_id FROM up u JOIN a p ON p.id = u.node_id WHERE p.g <> -1) THEN 0 ELSE a.g END AS BIGINT) AS gt_track_id FROM a""",
    "v_nodes", "v_hier",
)
def blocked_propagation(spark, d):
    overlaps = hierarchy.overlap_closure(view(spark, d, "v_hier"))
    return matching.blocked(view(spark, d, "v_nodes"), overlaps).select("id", "gt_track_id")


GT = ", gt AS (SELECT source_id, target_id, s.gt_track_id > 0 AND g.gt_track_id > 0 AND s.gt_track_id = g.gt_track_id AS gt FROM links JOIN v_nodes s ON s.id = source_id JOIN v_nodes g ON g.id = target_id)"


@query(KNN + GT + " SELECT * FROM gt", "v_nodes")
def gt_link_labels(spark, d):
    return matching.link_labels(links(spark, d), view(spark, d, "v_nodes")).select("source_id", "target_id", "gt")


@query(KNN + GT + " SELECT source_id, target_id, gt FROM gt QUALIFY max(CAST(gt AS INT)) OVER (PARTITION BY target_id) = 1", "v_nodes")
def competing_links(spark, d):
    return matching.competing_links(gt_link_labels(spark, d))


@query(
    """WITH m AS (SELECT sqrt(pow(coalesce(y - lag(y) OVER w, 0), 2) + pow(coalesce(x - lag(x) OVER w, 0), 2)) AS dist FROM v_tracks WINDOW w AS (PARTITION BY track_id ORDER BY v_tracks.t)),
    f AS (SELECT c.area, coalesce(p.height, (SELECT max(height) FROM v_hier)) AS pf FROM v_hier c LEFT JOIN v_hier p ON p.id = c.hier_parent_id)
    SELECT round((SELECT quantile_cont(dist, 0.99) FROM m) + 1.0, 6) AS max_distance, round(min(area) * 0.95, 6) AS min_area, round(max(area) * 1.025, 6) AS max_area,
    round(greatest(min(pf) - 0.025, 0.0), 6) AS min_frontier FROM f""",
    "v_hier", "v_tracks",
)
def optimized_config(spark, d):
    nodes = hierarchy.parent_frontier(view(spark, d, "v_hier"))
    found = matching.optimized_config(nodes, tracks.drift(view(spark, d, "v_tracks")))
    return found.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in found.columns))


# Tracks


def _tracks(spark, d):
    return view(spark, d, "v_tracks")


def _movement_sql(lag: int) -> str:
    return "SELECT track_id, tr.t, " + ", ".join(f"round(coalesce({c} - lag({c}, {lag}) OVER w, 0), 6) AS {c}" for c in "zyx") + " FROM v_tracks tr WINDOW w AS (PARTITION BY track_id ORDER BY tr.t)"


@query(_movement_sql(1), "v_tracks")
def track_movement(spark, d):
    return tracks.movement(_tracks(spark, d)).select("track_id", "t", *(F.round(c, 6).alias(c) for c in "zyx"))


@query(_movement_sql(2), "v_tracks")
def track_movement_lag2(spark, d):
    return tracks.movement(_tracks(spark, d), 2).select("track_id", "t", *(F.round(c, 6).alias(c) for c in "zyx"))


@query(
    """WITH m AS (SELECT sqrt(pow(coalesce(y - lag(y) OVER w, 0), 2) + pow(coalesce(x - lag(x) OVER w, 0), 2)) AS dist FROM v_tracks WINDOW w AS (PARTITION BY track_id ORDER BY v_tracks.t))
    SELECT round(quantile_cont(dist, 0.99), 6) AS drift FROM m""",
    "v_tracks",
)
def drift_quantile(spark, d):
    return tracks.drift(_tracks(spark, d)).select(F.round("drift", 6).alias("drift"))


SPANS = 'WITH s AS (SELECT track_id, min(t) AS "start", max(t) AS "end", min(parent_track_id) AS parent_track_id, max(t) - min(t) + 1 AS length FROM v_tracks GROUP BY 1)'
APPEARING = ', a AS (SELECT * FROM s WHERE "start" = 0 OR parent_track_id <> -1)'
DISAPPEARING = ' SELECT * FROM {0} WHERE "end" = (SELECT max("end") FROM {0}) OR track_id IN (SELECT parent_track_id FROM {0})'


@query(SPANS + " SELECT * FROM s", "v_tracks")
def track_lengths(spark, d):
    return tracks.track_lengths(_tracks(spark, d))


@query(SPANS + APPEARING + " SELECT * FROM a", "v_tracks")
def track_lengths_no_appearing(spark, d):
    return tracks.track_lengths(_tracks(spark, d), include_appearing=False)


@query(SPANS + DISAPPEARING.format("s"), "v_tracks")
def track_lengths_no_disappearing(spark, d):
    return tracks.track_lengths(_tracks(spark, d), include_disappearing=False)


@query(SPANS + APPEARING + DISAPPEARING.format("a"), "v_tracks")
def track_lengths_neither(spark, d):
    return tracks.track_lengths(_tracks(spark, d), False, False)


@query('SELECT track_id AS "L", min(t) AS "B", max(t) AS "E", CAST(CASE WHEN min(parent_track_id) = -1 THEN 0 ELSE min(parent_track_id) END AS BIGINT) AS "P" FROM v_tracks GROUP BY 1', "v_tracks")
def ctc_table(spark, d):
    return tracks.ctc_table(_tracks(spark, d))


@query(
    """WITH k AS (SELECT * FROM v_tracks WHERE track_id % 14 < 7), r AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS n FROM (SELECT DISTINCT track_id FROM k))
    SELECT k.id, r.n AS track_id, CAST(coalesce(p.n, -1) AS BIGINT) AS parent_track_id FROM k JOIN r USING (track_id) LEFT JOIN r p ON p.track_id = k.parent_track_id""",
    "v_tracks",
)
def ctc_relabel(spark, d):
    return tracks.sequential_labels(_tracks(spark, d).where("track_id % 14 < 7")).select("id", "track_id", "parent_track_id")


@query(
    """WITH r AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS n FROM (SELECT DISTINCT track_id FROM v_tracks))
    SELECT k.id, r.n AS track_id, CAST(coalesce(p.n, -1) AS BIGINT) AS parent_track_id FROM v_tracks k JOIN r USING (track_id) LEFT JOIN r p ON p.track_id = k.parent_track_id""",
    "v_tracks",
)
def ctc_relabel_all(spark, d):
    return tracks.sequential_labels(_tracks(spark, d)).select("id", "track_id", "parent_track_id")


@query("SELECT track_id, tr.t, id, y, x FROM v_tracks tr WHERE parent_track_id = -1 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY tr.t) = 1", "v_tracks")
def track_starts(spark, d):
    return tracks.track_starts(_tracks(spark, d)).select("track_id", "t", "id", "y", "x")


@query("SELECT track_id, tr.t, id, y, x FROM v_tracks tr WHERE track_id NOT IN (SELECT parent_track_id FROM v_tracks) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY tr.t DESC) = 1", "v_tracks")
def track_ends(spark, d):
    return tracks.track_ends(_tracks(spark, d)).select("track_id", "t", "id", "y", "x")


def _shifted(spark, d):
    """Tracks without parents start late, so that ends come before starts."""
    rows = _tracks(spark, d)
    return rows.withColumn("t", F.when(F.col("parent_track_id") == -1, F.col("t") + 60).otherwise(F.col("t")))


SHIFTED = "WITH v AS (SELECT track_id, CAST(CASE WHEN parent_track_id = -1 THEN t + 60 ELSE t END AS INT) AS t, z, y, x, parent_track_id FROM v_tracks), e AS (SELECT * FROM v WHERE track_id NOT IN (SELECT parent_track_id FROM v) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v.t DESC) = 1), s AS (SELECT * FROM v WHERE parent_track_id = -1 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v.t) = 1), c AS (SELECT e.track_id AS end_track, s.track_id AS start_track, s.t - e.t - 1 AS gap, sqrt(pow(e.y - s.y, 2) + pow(e.x - s.x, 2)) AS dist, e.t AS te, s.t AS ts, e.y AS ey, s.y AS sy, e.x AS ex, s.x AS sx, e.z AS ez, s.z AS sz FROM e JOIN s ON s.t - e.t - 1 BETWEEN 1 AND 8 AND e.track_id <> s.track_id)"


@query(SHIFTED + " SELECT end_track, start_track, CAST(gap AS INT) AS gap, round(dist, 6) AS dist FROM c WHERE dist < 300", "v_tracks")
def gap_candidates(spark, d):
    return tracks.gap_candidates(_shifted(spark, d), 8, 300.0).withColumn("dist", F.round("dist", 6))


STITCHES = """WITH RECURSIVE v AS (SELECT track_id, CAST(CASE WHEN parent_track_id = -1 THEN t + 60 ELSE t END AS INT) AS t, z, y, x, id, parent_track_id FROM v_tracks),
    m AS (SELECT sqrt(pow(coalesce(y - lag(y) OVER w, 0), 2) + pow(coalesce(x - lag(x) OVER w, 0), 2)) AS dist FROM v WINDOW w AS (PARTITION BY track_id ORDER BY v.t)),
    e AS (SELECT * FROM v WHERE track_id NOT IN (SELECT parent_track_id FROM v) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v.t DESC) = 1),
    s AS (SELECT * FROM v WHERE parent_track_id = -1 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY v.t) = 1),
    c AS (SELECT e.track_id AS end_track, s.track_id AS start_track, sqrt(pow(e.y - s.y, 2) + pow(e.x - s.x, 2)) AS dist FROM e JOIN s ON s.t = e.t + 1),
    o AS (SELECT * FROM c WHERE dist < (SELECT quantile_cont(m.dist, 0.99) FROM m) QUALIFY row_number() OVER (PARTITION BY end_track ORDER BY dist, start_track) = 1),
    j AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY start_track ORDER BY dist, end_track) = 1)"""


@query(STITCHES + " SELECT end_track, start_track, round(dist, 6) AS dist FROM j", "v_tracks")
def stitch_candidates(spark, d):
    return tracks.stitch_candidates(_shifted(spark, d)).withColumn("dist", F.round("dist", 6))


@query(
    STITCHES + """, chain AS (SELECT start_track AS old, end_track AS new, 1 AS n FROM j UNION ALL SELECT chain.old, j.end_track, n + 1 FROM chain JOIN j ON j.start_track = chain.new),
    final AS (SELECT old, arg_max(new, n) AS new FROM chain GROUP BY 1),
    r AS (SELECT v.id, v.t, coalesce(f.new, v.track_id) AS track_id, coalesce(p.new, v.parent_track_id) AS parent FROM v LEFT JOIN final f ON f.old = v.track_id LEFT JOIN final p ON p.old = v.parent_track_id)
    SELECT id, t, track_id, max(parent) OVER (PARTITION BY track_id) AS parent_track_id FROM r""",
    "v_tracks",
)
def stitched_tracks(spark, d):
    return tracks.stitch_tracks(_shifted(spark, d)).select("id", "t", "track_id", "parent_track_id")


@query(
    SHIFTED + """ SELECT start_track AS track_id, CAST(u.k AS INT) AS t, round(ez + (sz - ez) * (u.k - te) / (ts - te), 6) AS z, round(ey + (sy - ey) * (u.k - te) / (ts - te), 6) AS y,
    round(ex + (sx - ex) * (u.k - te) / (ts - te), 6) AS x FROM c, unnest(generate_series(te + 1, ts - 1)) AS u(k) WHERE dist < 300""",
    "v_tracks",
)
def interpolate_gap_rows(spark, d):
    rows = _shifted(spark, d)
    made = tracks.interpolated(rows, tracks.gap_candidates(rows, 8, 300.0).select("end_track", "start_track"))
    return made.withColumns({c: F.round(c, 6) for c in "zyx"})


@query(KNN + " SELECT source_id, target_id, round(weight, 6) AS weight, v.t, v.z, v.y, v.x FROM links JOIN v_nodes v ON v.id = target_id WHERE source_id = 100", "v_nodes")
def node_neighbors(spark, d):
    found = linking.neighbors_of(links(spark, d), view(spark, d, "v_nodes"), 100)
    return found.select("source_id", "target_id", F.round("weight", 6).alias("weight"), "t", "z", "y", "x")


@query(
    TREE + """, n AS (SELECT track_id, count(*) AS n FROM v_tracks GROUP BY 1), c AS (SELECT parent_track_id AS track_id, count(*) AS children FROM tr WHERE parent_track_id <> -1 GROUP BY 1),
    down AS (SELECT track_id, track_id AS root_id, CAST(1 AS DOUBLE) AS weight FROM tr WHERE parent_track_id = -1
      UNION ALL SELECT t.track_id, o.root_id, o.weight / c.children FROM down o JOIN tr t ON t.parent_track_id = o.track_id JOIN c ON c.track_id = o.track_id)
    SELECT root_id, round(sum(weight * (n + CASE WHEN children IS NULL THEN 0 ELSE 1 END)), 6) AS length FROM down JOIN n USING (track_id) LEFT JOIN c USING (track_id) GROUP BY 1""",
    "v_tracks",
)
def tree_lengths(spark, d):
    return tracks.tree_lengths(_tracks(spark, d)).withColumn("length", F.round("length", 6))


@query("SELECT * FROM (SELECT lag(id) OVER (PARTITION BY track_id ORDER BY v_tracks.t) AS source, id AS target FROM v_tracks) WHERE source IS NOT NULL", "v_tracks")
def consecutive_edges(spark, d):
    return lineage.forest_edges(_tracks(spark, d))


def _forest_nodes(spark, d):
    """Nodes with parents: the row before in the track, and for a first row the last one of the parent track."""
    rows = _tracks(spark, d)
    last = rows.groupBy(F.col("track_id").alias("parent_track_id")).agg(F.max_by("id", "t").alias("_last"))
    before = F.expr("lag(id) over (partition by track_id order by t)")
    out = rows.withColumn("_before", before).join(last, "parent_track_id", "left")
    return out.select("id", F.coalesce("_before", "_last", F.lit(-1)).cast("bigint").alias("parent_id"), "track_id", "t")


FOREST = "WITH l AS (SELECT track_id, arg_max(id, v_tracks.t) AS last FROM v_tracks GROUP BY 1), n AS (SELECT v.id, v.track_id, CAST(coalesce(lag(v.id) OVER (PARTITION BY v.track_id ORDER BY v.t), l.last, -1) AS BIGINT) AS parent_id FROM v_tracks v LEFT JOIN l ON l.track_id = v.parent_track_id)"


@query(FOREST + " SELECT parent_id AS source, id AS target FROM n WHERE parent_id <> -1", "v_tracks")
def parent_edges(spark, d):
    return lineage.forest_edges(_forest_nodes(spark, d))


@query("SELECT parent_track_id, array_to_string(list_sort(list(DISTINCT track_id)), ',') AS children FROM v_tracks GROUP BY 1", "v_tracks")
def forest_children(spark, d):
    return lineage.forest(_tracks(spark, d)).withColumn("children", F.array_join("children", ","))


@query("SELECT DISTINCT track_id, parent_track_id FROM v_tracks WHERE parent_track_id <> -1", "v_tracks")
def inverse_forest(spark, d):
    return lineage.inverse_forest(_tracks(spark, d))


@query(TREE + " SELECT * FROM roots", "v_tracks")
def track_roots(spark, d):
    return lineage.track_roots(_tracks(spark, d))


@query(TREE + " SELECT v.id, v.track_id FROM v_tracks v JOIN roots r ON r.track_id = v.track_id WHERE root_id IN (SELECT root_id FROM roots WHERE track_id IN (3, 11, 1000000))", "v_tracks")
def subgraph(spark, d):
    return lineage.subgraph(_tracks(spark, d), [3, 11, 1000000]).select("id", "track_id")


@query(TREE + " SELECT track_id FROM up WHERE ancestor = 1", "v_tracks")
def subtree(spark, d):
    return lineage.subtree(_tracks(spark, d), 1)


@query(TREE + " SELECT u.track_id, v.t, v.id, CAST(-1 AS BIGINT) AS parent_track_id FROM up u JOIN v_tracks v ON v.track_id = u.ancestor WHERE u.track_id NOT IN (SELECT parent_track_id FROM tr)", "v_tracks")
def paths_to_roots(spark, d):
    return lineage.paths_to_roots(_tracks(spark, d)).select("track_id", "t", "id", "parent_track_id")


@query(
    TREE.replace("up AS (", "ord AS (SELECT track_id, parent_track_id, row_number() OVER (PARTITION BY parent_track_id ORDER BY track_id) AS k FROM tr), keys AS (SELECT track_id, track_id AS root_id, '' AS key FROM tr WHERE parent_track_id = -1 UNION ALL SELECT o.track_id, r.root_id, r.key || CASE o.k WHEN 1 THEN '0' ELSE '2' END FROM keys r JOIN ord o ON o.parent_track_id = r.track_id), up AS (", 1)
    + " SELECT root_id, track_id, CAST(row_number() OVER (PARTITION BY root_id ORDER BY key || '1') - 1 AS INT) AS position FROM keys",
    "v_tracks",
)
def inorder_tracks(spark, d):
    return lineage.inorder(_tracks(spark, d))


@query(
    TREE + """, v AS (SELECT t.*, root_id FROM v_tracks t JOIN roots r ON r.track_id = t.track_id)
    SELECT r.root_id, round(coalesce(max(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))), 0), 6) AS radius FROM (SELECT DISTINCT root_id FROM v) r
    LEFT JOIN v a ON a.root_id = r.root_id LEFT JOIN v b ON b.root_id = a.root_id AND b.t = a.t AND a.id < b.id GROUP BY 1""",
    "v_tracks",
)
def tree_max_radius(spark, d):
    return tracks.tree_radius(lineage.with_roots(_tracks(spark, d))).withColumn("radius", F.round("radius", 6))


@query(
    """WITH g AS (SELECT track_id, t, attribute FROM (SELECT DISTINCT track_id FROM v_tracks), (SELECT CAST(unnest(generate_series(0, (SELECT max(t) FROM v_tracks))) AS INT) AS t), (SELECT unnest(['y', 'x']) AS attribute))
    SELECT g.track_id, g.t, attribute, coalesce(CASE attribute WHEN 'y' THEN v.y ELSE v.x END, 0) AS value FROM g LEFT JOIN v_tracks v ON v.track_id = g.track_id AND v.t = g.t""",
    "v_tracks",
)
def profile_matrix_long(spark, d):
    return tracks.profile(_tracks(spark, d), ["y", "x"])


@query(
    FOREST + """, c AS (SELECT parent_id, count(*) AS k FROM n WHERE parent_id <> -1 GROUP BY 1), b AS (SELECT n.track_id, n.id, n.parent_id = -1 OR c.k > 1 AS head FROM n LEFT JOIN c ON c.parent_id = n.parent_id),
    h AS (SELECT track_id, id AS head_id FROM b WHERE head) SELECT b.id, h.head_id FROM b JOIN h ON h.track_id = b.track_id""",
    "v_tracks",
)
def node_paths_to_tracks(spark, d):
    return lineage.assign_tracks(_forest_nodes(spark, d).select("id", "parent_id")).select("id", "head_id")


@query(
    FOREST + """, c AS (SELECT parent_id, count(*) AS k FROM n WHERE parent_id <> -1 GROUP BY 1)
    SELECT count(*) AS segments, CAST(sum(CASE WHEN n.parent_id = -1 THEN 1 ELSE 0 END) AS BIGINT) AS appearances, CAST(sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ends,
    CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS divisions, CAST(sum(CASE WHEN n.parent_id = -1 THEN 1 ELSE 0 END) + sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS tracks FROM n LEFT JOIN c ON c.parent_id = n.id""",
    "v_tracks",
)
def solution_summary(spark, d):
    return summary.solution_summary(_forest_nodes(spark, d))


@query(FOREST + " SELECT parent_id, count(*) AS children FROM n WHERE parent_id <> -1 GROUP BY 1 HAVING count(*) > 1", "v_tracks")
def division_parents(spark, d):
    return summary.division_parents(_forest_nodes(spark, d))


# Pixels

PROPS = """WITH p AS (SELECT t, label, count(*) AS num_pixels, sum(intensity) AS intensity_sum, round(avg(intensity), 6) AS intensity_mean, round(stddev_pop(intensity), 6) AS intensity_std,
    min(intensity) AS intensity_min, max(intensity) AS intensity_max, CAST(round_even(avg(y), 0) AS INT) AS cy, CAST(round_even(avg(x), 0) AS INT) AS cx FROM v_pixels WHERE label > 0 GROUP BY 1, 2)"""


@query(PROPS + " SELECT * FROM p", "v_pixels")
def region_props(spark, d):
    return pixels.region_props(view(spark, d, "v_pixels"))


@query(PROPS + " SELECT v.track_id, v.t, v.id, coalesce(num_pixels, 0) AS num_pixels, coalesce(intensity_sum, 0) AS intensity_sum FROM v_tracks v LEFT JOIN p ON p.t = v.t AND p.label = v.track_id", "v_pixels", "v_tracks")
def region_props_join(spark, d):
    props = pixels.region_props(view(spark, d, "v_pixels"))
    return pixels.join_measurements(_tracks(spark, d), props).select("track_id", "t", "id", "num_pixels", "intensity_sum").fillna(0)


DISPLACED = PROPS + ", m AS (SELECT label, t, num_pixels AS area, coalesce(sqrt(pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)), 0) AS distance FROM p WINDOW w AS (PARTITION BY label ORDER BY p.t))"


@query(DISPLACED + " SELECT label, t, area, round(distance, 6) AS distance FROM m", "v_pixels")
def centroid_displacement(spark, d):
    return pixels.label_displacement(view(spark, d, "v_pixels")).withColumn("distance", F.round("distance", 6))


@query(
    DISPLACED + """ SELECT count(area) AS n, round(avg(area), 6) AS mean, round(stddev_samp(area), 6) AS std, min(area) AS least, quantile_cont(area, 0.25) AS q25,
    quantile_cont(area, 0.5) AS q50, quantile_cont(area, 0.75) AS q75, max(area) AS most FROM m""",
    "v_pixels",
)
def describe_area(spark, d):
    return pixels.describe(pixels.label_displacement(view(spark, d, "v_pixels")), "area")


@query(
    """SELECT a.t, a.y, a.x, a.label > 0 AS foreground, bool_or(b.label <> a.label AND b.label > 0) AS contour FROM v_pixels a
    JOIN v_pixels b ON b.t = a.t AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3, 4""",
    "v_pixels",
)
def contours_from_labels(spark, d):
    return pixels.contours(view(spark, d, "v_pixels"))


@query(
    """WITH a AS (SELECT *, CAST(intensity AS DOUBLE) - (SELECT quantile_cont(CAST(intensity AS DOUBLE), 0.01) FROM v_pixels) AS s FROM v_pixels)
    SELECT t, y, x, round(pow(least(greatest(s / (SELECT quantile_cont(s, 0.99) FROM a), 0), 1), 0.5), 6) AS value FROM a""",
    "v_pixels",
)
def normalize_gamma(spark, d):
    return pixels.normalize(view(spark, d, "v_pixels"), gamma=0.5).select("t", "y", "x", F.round("value", 6).alias("value"))


IN_REGION = "WITH g AS (SELECT v.id, v.t, CAST(round_even(y * 0.64, 0) AS INT) AS cy, CAST(round_even(x * 0.0444, 0) AS INT) AS cx FROM v_nodes v), w AS (SELECT g.*, label FROM g JOIN v_pixels p ON p.t = g.t AND p.y = cy AND p.x = cx WHERE label > 0)"


def _on_grid(spark, d):
    """Nodes with coordinates in pixels."""
    return view(spark, d, "v_nodes").withColumns({"y": F.col("y") * 0.64, "x": F.col("x") * 0.0444})


@query(IN_REGION + " SELECT id, t, label FROM w", "v_nodes", "v_pixels")
def point_containment(spark, d):
    return pixels.containing(view(spark, d, "v_pixels"), _on_grid(spark, d).select("id", "t", "y", "x")).select("id", "t", "label")


@query(
    IN_REGION + """ SELECT w.id, CAST(count(*) AS BIGINT) AS n, CAST(sum(intensity) AS DOUBLE) AS intensity FROM w JOIN v_pixels p
    ON p.t = w.t AND p.label = w.label AND p.y BETWEEN cy - 1 AND cy + 1 AND p.x BETWEEN cx - 1 AND cx + 1 GROUP BY 1""",
    "v_nodes", "v_pixels",
)
def masked_roi(spark, d):
    p = view(spark, d, "v_pixels")
    within = pixels.containing(p, _on_grid(spark, d).select("id", "t", "y", "x"))
    boxes = within.select("id", "t", "label", *((F.bround(c).cast("int") + k).alias(f"{c}{i}") for c in "yx" for i, k in enumerate((-1, 2))))
    return pixels.roi(p, boxes, masked=True).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").cast("double").alias("intensity"))


@query(
    IN_REGION + """, b AS (SELECT hier_parent_id AS id, max(height) AS birth FROM v_hier WHERE hier_parent_id <> -1 GROUP BY 1),
    f AS (SELECT p.t, label, count(*) AS num_pixels, round(avg(intensity), 6) AS intensity_mean, round(stddev_pop(intensity), 6) AS intensity_std FROM v_pixels p WHERE label > 0 GROUP BY 1, 2)
    SELECT v.id, v.t, v.area, w.label, num_pixels, intensity_mean, intensity_std, CAST(height AS DOUBLE) AS node_death,
    round(coalesce(CAST(birth AS DOUBLE), (SELECT min(height) FROM v_hier) - 1e-5), 6) AS node_birth
    FROM v_hier v LEFT JOIN w ON w.id = v.id LEFT JOIN f ON f.t = w.t AND f.label = w.label LEFT JOIN b ON b.id = v.id""",
    "v_nodes", "v_hier", "v_pixels",
)
def node_features(spark, d):
    place = _on_grid(spark, d).select("id", "y", "x")
    found = pixels.node_features(hierarchy.persistence(view(spark, d, "v_hier")).join(place, "id"), view(spark, d, "v_pixels"))
    kept = ("id", "t", "area", "label", "num_pixels", "intensity_mean", "intensity_std", "node_death")
    return found.select(*kept, F.round("node_birth", 6).alias("node_birth"))


@query("SELECT t, y, x, CAST(CASE WHEN label > 0 AND label % 4 = t % 4 THEN label + 100 ELSE label END AS INT) AS label FROM v_pixels", "v_pixels")
def relabel_pixels(spark, d):
    p = view(spark, d, "v_pixels")
    changes = p.where("label > 0 AND label % 4 = t % 4").select("t", "label", (F.col("label") + 100).alias("new_label")).distinct()
    return pixels.relabel(p, changes).select("t", "y", "x", "label")


@query(
    """WITH f AS (SELECT t, y AS cy, x AS cx, CAST(intensity AS DOUBLE) / 1000 AS vy, -CAST(intensity AS DOUBLE) / 2000 AS vx FROM v_pixels),
    c AS (SELECT *, CAST(least(greatest(round_even(y * 0.64, 0), 0), 63) AS INT) AS cy, CAST(least(greatest(round_even(x * 0.0444, 0), 0), 63) AS INT) AS cx FROM v_nodes)
    SELECT c.id, c.cy, c.cx, round(coalesce(vy, 0) * 64 / 2 / 0.64, 6) AS y_shift, round(coalesce(vx, 0) * 64 / 2 / 0.0444, 6) AS x_shift FROM c LEFT JOIN f ON f.t = c.t AND f.cy = c.cy AND f.cx = c.cx""",
    "v_nodes", "v_pixels",
)
def flow_shift_lookup(spark, d):
    value = F.col("intensity").cast("double")
    field = view(spark, d, "v_pixels").select("t", F.col("y").alias("cy"), F.col("x").alias("cx"), (value / 1000).alias("vy"), (-value / 2000).alias("vx"))
    # Sums of intensities grow with the table, so this field has no limit.
    out = pixels.flow_shifts(view(spark, d, "v_nodes"), field, (64, 64), (0.64, 0.0444), limit=None)
    return out.select("id", "cy", "cx", F.round("y_shift", 6).alias("y_shift"), F.round("x_shift", 6).alias("x_shift"))


# Selection


@query(
    """WITH m AS (SELECT max(t) AS last FROM v_nodes), w AS (SELECT CAST(unnest(generate_series(0, CAST(ceil(last / 7.0) AS INT) - 1)) AS INT) AS index, last FROM m)
    SELECT index, CAST(greatest(index * 7 - 2, 0) AS INT) AS solve_start, CAST(least(least(index * 7 + 6, last) + 2, last) AS INT) AS solve_end,
    CAST(greatest(index * 7 - 1, 0) AS INT) AS commit_start, CAST(least(least(index * 7 + 6, last) + 1, last) AS INT) AS commit_end FROM w""",
    "v_nodes",
)
def window_layout(spark, d):
    return window_table(view(spark, d, "v_nodes"), 7, 2)


def _solution(spark, d):
    nodes, found = view(spark, d, "v_nodes"), durable(links(spark, d, 2))  # both the solution and its check read them
    overlaps = hierarchy.overlap_closure(view(spark, d, "v_hier"))
    config = TrackingConfig(appear_weight=-0.1, disappear_weight=-0.1, division_weight=-0.1, window_size=10, link_function="identity")
    return solving.solve(nodes.select("id", "t"), found, overlaps, config), overlaps, found


@query(None)
def greedy_solution(spark, d):
    return _solution(spark, d)[0]


@query(
    """SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('repeated nodes'), ('more than two children'), ('overlapping nodes'), ('links that don''t exist')) AS r(rule)""",
    "v_nodes",
)
def solution_validity(spark, d):
    return solving.violations(*_solution(spark, d))


def _closed_gaps_sql(max_gap: int, radius: float) -> str:
    """All assignments of the few ends of a frame to starts are listed, gap by gap, and the one of least total is taken."""
    parts, used = [], "SELECT NULL AS start_track WHERE FALSE"
    for k in range(1, max_gap + 1):
        parts += [
            f"p{k} AS (SELECT *, dense_rank() OVER (PARTITION BY te ORDER BY end_track) AS n FROM c WHERE gap = {k} AND start_track NOT IN ({used}))",
            f"m{k} AS (SELECT te, n, [start_track] AS s, [end_track] AS e, [dist] AS d, dist AS total FROM p{k} WHERE n = 1 UNION ALL"
            f" SELECT m.te, p.n, list_append(s, start_track), list_append(e, end_track), list_append(d, dist), total + dist FROM m{k} m JOIN p{k} p ON p.te = m.te AND p.n = m.n + 1 AND NOT list_contains(s, start_track))",
            f"b{k} AS (SELECT te, s, e, d FROM m{k} QUALIFY row_number() OVER (PARTITION BY te ORDER BY n DESC, total) = 1)",
            f"j{k} AS (SELECT * FROM (SELECT unnest(e) AS end_track, unnest(s) AS start_track, unnest(d) AS dist FROM b{k}) WHERE dist < {radius})",
        ]
        used = " UNION ALL ".join(f"SELECT start_track FROM j{x}" for x in range(1, k + 1))
    joins = " UNION ALL ".join(f"SELECT end_track, start_track FROM j{x}" for x in range(1, max_gap + 1))
    return SHIFTED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ", ".join(parts) + f""", j AS ({joins}),
    chain AS (SELECT start_track AS old, end_track AS new, 1 AS n FROM j UNION ALL SELECT chain.old, j.end_track, n + 1 FROM chain JOIN j ON j.start_track = chain.new),
    final AS (SELECT old, arg_max(new, n) AS new FROM chain GROUP BY 1),
    made AS (SELECT j.start_track AS track_id, CAST(u.k AS INT) AS t, ez + (sz - ez) * (u.k - te) / (ts - te) AS z, ey + (sy - ey) * (u.k - te) / (ts - te) AS y,
      ex + (sx - ex) * (u.k - te) / (ts - te) AS x, CAST(-1 AS BIGINT) AS parent_track_id FROM j JOIN c USING (end_track, start_track), unnest(generate_series(te + 1, ts - 1)) AS u(k)),
    every AS (SELECT * FROM v UNION ALL SELECT * FROM made),
    r AS (SELECT w.t, w.z, w.y, w.x, coalesce(f.new, w.track_id) AS track_id, coalesce(p.new, w.parent_track_id) AS parent FROM every w LEFT JOIN final f ON f.old = w.track_id LEFT JOIN final p ON p.old = w.parent_track_id)
    SELECT track_id, t, round(z, 6) AS z, round(y, 6) AS y, round(x, 6) AS x, max(parent) OVER (PARTITION BY track_id) AS parent_track_id FROM r"""


@query(_closed_gaps_sql(8, 300.0), "v_tracks")
def closed_gaps(spark, d):
    return tracks.close_gaps(_shifted(spark, d), 8, 300.0).withColumns({c: F.round(c, 6) for c in "zyx"})


@query(None)
def first_frame_tracks(spark, d):
    """Tracks from the regions of the first frame, at the places of their centroids."""
    regions = pixels.region_props(view(spark, d, "v_pixels")).where("t = 0")
    markers = regions.select(F.col("label").cast("bigint").alias("id"), F.lit(0.0).alias("z"), (F.col("cy") * 5).alias("y"), (F.col("cx") * 20).alias("x"))
    return tracks.first_frame_tracks(_tracks(spark, d), markers)


def _short_siblings_sql(min_length: int, levels: int) -> str:
    """Level by level from the leaves; trees of the given tables are that high at most."""
    parts = ["s0 AS (SELECT n.track_id, TRUE AS c, n FROM n WHERE track_id NOT IN (SELECT parent FROM n))"]
    for k in range(1, levels):
        parts.append(
            f"s{k} AS (SELECT * FROM s{k - 1} UNION SELECT p.track_id, CASE WHEN a.sh <> b.sh THEN CASE WHEN a.sh THEN b.c ELSE a.c END ELSE FALSE END, p.n + CASE WHEN a.sh <> b.sh THEN CASE WHEN a.sh THEN b.n ELSE a.n END ELSE 0 END"
            f" FROM kids JOIN n p ON p.track_id = kids.track_id JOIN (SELECT *, c AND n <= {min_length} AS sh FROM s{k - 1}) a ON a.track_id = kids.a JOIN (SELECT *, c AND n <= {min_length} AS sh FROM s{k - 1}) b ON b.track_id = kids.b)"
        )
    return f"""WITH RECURSIVE n AS (SELECT track_id, min(parent_track_id) AS parent, count(*) AS n FROM v_tracks GROUP BY 1),
    kids AS (SELECT parent AS track_id, min(track_id) AS a, max(track_id) AS b FROM n WHERE parent <> -1 GROUP BY 1), {", ".join(parts)},
    f AS (SELECT track_id, c AND n <= {min_length} AS sh FROM s{levels - 1}),
    d AS (SELECT kids.track_id, CASE WHEN x.sh THEN a ELSE b END AS gone, CASE WHEN x.sh THEN b ELSE a END AS stays FROM kids JOIN f x ON x.track_id = a JOIN f y ON y.track_id = b WHERE x.sh <> y.sh),
    up AS (SELECT track_id AS old, track_id AS new, 0 AS k FROM n UNION ALL SELECT up.old, d.track_id, k + 1 FROM up JOIN d ON d.stays = up.new),
    label AS (SELECT old, arg_max(new, k) AS new FROM up GROUP BY 1)
    SELECT v.id, v.t, l.new AS track_id, coalesce(q.new, -1) AS parent_track_id FROM v_tracks v JOIN label l ON l.old = v.track_id JOIN n ON n.track_id = l.new LEFT JOIN label q ON q.old = n.parent
    WHERE v.track_id NOT IN (SELECT gone FROM d)"""


@query(_short_siblings_sql(60, 3), "v_tracks")
def short_siblings_filtered(spark, d):
    return tracks.filter_short_siblings(_tracks(spark, d), 60).select("id", "t", "track_id", "parent_track_id")


@query(
    FOREST.replace("WITH l", "WITH RECURSIVE l") + """, c AS (SELECT parent_id AS id, count(*) AS k FROM n WHERE parent_id <> -1 GROUP BY 1),
    m AS (SELECT n.id, n.parent_id, n.parent_id = -1 OR k > 1 AS starts FROM n LEFT JOIN c ON c.id = n.parent_id),
    walk AS (SELECT id, parent_id, [id] AS heads FROM m WHERE parent_id = -1
      UNION ALL SELECT m.id, m.parent_id, CASE WHEN starts THEN list_append(heads, m.id) ELSE heads END FROM walk w JOIN m ON m.parent_id = w.id),
    numbers AS (SELECT heads, row_number() OVER (ORDER BY heads) AS number FROM (SELECT DISTINCT heads FROM walk))
    SELECT w.id, w.parent_id, CAST(o.number AS BIGINT) AS track_id, CAST(coalesce(p.number, -1) AS BIGINT) AS parent_track_id
    FROM walk w JOIN numbers o ON o.heads = w.heads LEFT JOIN numbers p ON p.heads = w.heads[:-2] AND len(w.heads) > 1""",
    "v_tracks",
)
def track_ids(spark, d):
    return lineage.add_track_ids(_forest_nodes(spark, d).select("id", "parent_id"))


# Whole frames

SIDE = 64
INSIDE = "f AS (SELECT t, y, x FROM v_pixels WHERE label > 0)"
DISTANCES = f"""WITH {INSIDE}, b AS (SELECT t, y, x FROM (SELECT DISTINCT t FROM v_pixels), (SELECT CAST(range AS INT) AS y FROM range({SIDE})), (SELECT CAST(range AS INT) AS x FROM range({SIDE}))
      EXCEPT SELECT t, y, x FROM f),
    d AS (SELECT f.t, f.y, f.x, coalesce(sqrt(min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x))), CAST('inf' AS DOUBLE)) AS distance
      FROM f LEFT JOIN b ON b.t = f.t GROUP BY 1, 2, 3)"""


@query(DISTANCES + " SELECT t, y, x, round(distance, 6) AS distance FROM d", "v_pixels")
def distance_to_background(spark, d):
    inside = view(spark, d, "v_pixels").where("label > 0")
    return rasters.distance_transform(inside, SIDE, SIDE).withColumn("distance", F.round("distance", 6))


@query(
    DISTANCES + """, m AS (SELECT t, max(distance) AS most FROM d GROUP BY 1)
    SELECT v.t, v.y, v.x, round(CASE WHEN d.distance IS NULL THEN 1.0 WHEN most = CAST('inf' AS DOUBLE) THEN 0.0 ELSE 1 - d.distance / most END, 6) AS value
    FROM v_pixels v LEFT JOIN d ON d.t = v.t AND d.y = v.y AND d.x = v.x LEFT JOIN m ON m.t = v.t""",
    "v_pixels",
)
def inverted_distance(spark, d):
    return rasters.inverted_distances(view(spark, d, "v_pixels"), SIDE, SIDE).withColumn("value", F.round("value", 6))


@query(
    """WITH RECURSIVE r AS (SELECT t, y, x, CAST(intensity AS DOUBLE) - 20 AS v FROM v_pixels
      UNION SELECT p.t, p.y, p.x, least(r.v, p.intensity) FROM r JOIN v_pixels p ON p.t = r.t AND p.y BETWEEN r.y - 1 AND r.y + 1 AND p.x BETWEEN r.x - 1 AND r.x + 1
        AND least(r.v, p.intensity) > p.intensity - 20)
    SELECT t, y, x, max(v) AS value FROM r GROUP BY 1, 2, 3""",
    "v_pixels",
)
def reconstructed_background(spark, d):
    rows = view(spark, d, "v_pixels").withColumns({"seed": F.col("intensity") - 20, "mask": F.col("intensity")})
    return rasters.reconstruct(rows, tile=16)


@query("SELECT DISTINCT t, CAST(-3 * t AS BIGINT) AS dy, CAST(2 * t AS BIGINT) AS dx FROM v_pixels", "v_pixels")
def sequence_drift(spark, d):
    """The sum of all frames, moved by a known way in each one."""
    seen = view(spark, d, "v_pixels")
    whole = seen.groupBy("y", "x").agg(F.sum("intensity").alias("intensity"))
    frames = seen.select("t").distinct()
    moved = whole.join(frames, F.col("t").isNotNull()).withColumns({"y": F.pmod(F.col("y") + 3 * F.col("t"), F.lit(SIDE)), "x": F.pmod(F.col("x") - 2 * F.col("t"), F.lit(SIDE))})
    return rasters.sequence_shifts(moved, SIDE, SIDE)


MEASURES = ["area", "extent", "centroid_y", "bbox_y0", "bbox_x1", "equivalent_diameter", "axis_major_length", "eccentricity", "intensity_sum", "weighted_x"]


@query(
    """WITH m AS (SELECT t, label, max(intensity) AS most FROM v_pixels WHERE label > 0 GROUP BY 1, 2),
    a AS (SELECT v.t, v.label, count(*) AS area, count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS extent, avg(y) AS centroid_y, min(y) AS bbox_y0, max(x) + 1 AS bbox_x1,
      sum(intensity) AS intensity_sum, sum(x * intensity) / sum(intensity) AS weighted_x, max(intensity) - min(intensity) AS intensity_range,
      avg(CASE WHEN 2 * intensity > most THEN 1.0 ELSE 0.0 END) AS bright_share, var_pop(y) + 1 / 12 AS yy, var_pop(x) + 1 / 12 AS xx, covar_pop(x, y) AS xy
      FROM v_pixels v JOIN m ON m.t = v.t AND m.label = v.label GROUP BY 1, 2),
    e AS (SELECT *, (yy + xx) / 2 + sqrt(((yy - xx) / 2) * ((yy - xx) / 2) + xy * xy) AS l1, (yy + xx) / 2 - sqrt(((yy - xx) / 2) * ((yy - xx) / 2) + xy * xy) AS l2 FROM a)
    SELECT t, label, area, bbox_y0, bbox_x1, round(extent, 6) AS extent, round(centroid_y, 6) AS centroid_y, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter,
      round(4 * sqrt(l1), 6) AS axis_major_length, round(sqrt(greatest(1 - l2 / l1, 0)), 4) AS eccentricity, CAST(intensity_sum AS DOUBLE) AS intensity_sum, round(weighted_x, 6) AS weighted_x,
      CAST(intensity_range AS DOUBLE) AS intensity_range, round(bright_share, 6) AS bright_share FROM e""",
    "v_pixels",
)
def region_measures(spark, d):
    extra = {
        "intensity_range": (F.max("intensity") - F.min("intensity")).cast("double"),
        "bright_share": lambda y, x, v: (2 * v > v.max()).mean(),
    }
    made = measures.measured(view(spark, d, "v_pixels"), MEASURES, extra)
    made = made.withColumn("intensity_sum", F.col("intensity_sum").cast("double")).withColumn("eccentricity", F.round("eccentricity", 4))
    return made.withColumns({c: F.round(c, 6) for c in ("extent", "centroid_y", "equivalent_diameter", "axis_major_length", "weighted_x", "bright_share")})


def _truth_overlaps(spark, d):
    """(t, source_id, target_id, weight): each node with each true label of its frame, by how much their boxes share.

    All of them, which grow with the square of a frame's nodes; the matches below list the best ones only.
    """
    nodes = view(spark, d, "v_nodes")
    pairs = linking.intersecting_pairs(nodes, 9).select("a_id", "b_id", "intersection")
    turned = pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "intersection")
    side = 2 * F.col("h") + 1
    itself = nodes.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), (side * side).cast("bigint").alias("intersection"))
    truth = nodes.where("gt_track_id > 0").select(F.col("id").alias("b_id"), "t", "gt_track_id")
    rows = pairs.unionByName(turned).unionByName(itself).join(truth, "b_id")
    shared = rows.groupBy("t", F.col("a_id").alias("source_id"), F.col("gt_track_id").alias("target_id"))
    return shared.agg(F.sum("intersection").cast("double").alias("weight"))


def _boxes(spark, d):
    """Nodes, and those of true labels with the label as id. A node without a place meets itself only, so it stands alone."""
    alone, apart = F.col("y").isNull() | F.col("x").isNull(), -1e9 - 100.0 * F.col("id")
    nodes = view(spark, d, "v_nodes").withColumns({c: F.when(alone, apart).otherwise(F.col(c)) for c in "yx"})
    return nodes, nodes.where("gt_track_id > 0").withColumn("id", F.col("gt_track_id"))


@query(None)
def gt_frame_matches(spark, d):
    nodes, labels = (x.withColumn("w", F.col("t")).withColumns({c: F.lit(0.0) for c in ("plus", "minus")}) for x in _boxes(spark, d))
    found = truth.match_boxes(nodes, labels, hierarchy.overlap_closure(view(spark, d, "v_hier")))
    return found.select(F.col("w").cast("int").alias("t"), "source_id", F.col("label").alias("target_id"))


@query(
    """WITH n AS (SELECT t, CAST(floor(log2(area) * 100) AS INT) AS bin, count(*) AS n FROM v_nodes WHERE area >= 1 GROUP BY 1, 2),
    a AS (SELECT t, bin + k AS bin, list_sort(list(n)) AS l FROM n, (SELECT CAST(range AS INT) - 2 AS k FROM range(5)) GROUP BY 1, 2),
    s AS (SELECT t, bin, l[len(l) - 2] AS smooth FROM a WHERE len(l) > 2 AND bin >= 0),
    p AS (SELECT s.t, s.bin, s.smooth FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.t = s.t AND abs(o.bin - s.bin) <= 25 AND (o.smooth > s.smooth OR o.smooth = s.smooth AND o.bin < s.bin))),
    r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY smooth DESC, bin) AS k FROM p),
    f AS (SELECT t, pow(2.0, bin / 100.0) AS peak FROM r WHERE k <= 5),
    m AS (SELECT t, floor(avg(area)) AS peak FROM v_nodes WHERE area >= 1 AND t NOT IN (SELECT t FROM f) GROUP BY 1)
    SELECT t, round(peak, 6) AS peak FROM f UNION ALL SELECT t, round(peak, 6) FROM m""",
    "v_nodes",
)
def frame_area_peaks(spark, d):
    return pixels.frame_peaks(view(spark, d, "v_nodes")).withColumn("peak", F.round("peak", 6))


@query(None)
def gt_template_matches(spark, d):
    nodes, labels = _boxes(spark, d)
    return truth.match_boxes_by_area(nodes, labels, hierarchy.overlap_closure(view(spark, d, "v_hier")), pixels.frame_peaks(view(spark, d, "v_nodes")))
