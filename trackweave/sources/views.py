"""Domain views over the driver tables: candidate nodes, hierarchies, tracks, pixels and feature vectors.

The same text runs on Spark and on DuckDB; ``{name}`` stands for a table or a view that another one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

V_NODES = """
SELECT CAST(event_id AS BIGINT) AS id, CAST(extract(day FROM ts) AS INT) - 1 AS t,
  CAST(0 AS DOUBLE) AS z, value AS y,
  CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS DOUBLE) AS x,
  CAST(event_id % 7 + 3 AS INT) AS h,
  CAST((2 * (event_id % 7 + 3) + 1) * (2 * (event_id % 7 + 3) + 1) AS INT) AS area,
  CAST(event_type <> 'error' AS BOOLEAN) AS selected,
  CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 0 ELSE user_id + 1 END AS BIGINT) AS gt_track_id
FROM {events}"""

V_HIER = """
WITH r AS (SELECT v.*, CAST(row_number() OVER (PARTITION BY t ORDER BY id) AS INT) - 1 AS k FROM {v_nodes} v)
SELECT c.id, c.t, c.area, c.area + c.k % 7 AS height, c.k % 7 AS local, CAST(coalesce(p.id, -1) AS BIGINT) AS hier_parent_id
FROM r c LEFT JOIN r p ON p.t = c.t AND c.k % 7 > 0
  AND p.k = c.k - c.k % 7 + CAST(floor((c.k % 7 - 1) / 2.0) AS INT)"""

V_TRACKS = """
WITH m AS (SELECT max(user_id) AS mx FROM {events}),
s AS (SELECT user_id, event_id, value, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS t FROM {events})
SELECT user_id AS track_id, s.t, CAST(0 AS DOUBLE) AS z, value AS y,
  CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS DOUBLE) AS x, event_id AS id,
  CAST(CASE WHEN user_id % 7 = 0 OR user_id - user_id % 7 + 6 > mx THEN -1
       ELSE user_id - user_id % 7 + CAST(floor((user_id % 7 - 1) / 2.0) AS BIGINT) END AS BIGINT) AS parent_track_id
FROM s CROSS JOIN m"""

V_PIXELS = """
WITH p AS (SELECT CAST(l_linenumber - 1 AS INT) AS t, CAST(l_partkey % 64 AS INT) AS y, CAST(l_suppkey % 64 AS INT) AS x, sum(l_quantity) AS intensity
 FROM {lineitem} GROUP BY 1, 2, 3)
SELECT t, y, x, intensity, CAST(CASE WHEN intensity < 20 THEN 0
  ELSE CAST(floor(y / 8.0) AS INT) * 8 + CAST(floor(x / 8.0) AS INT) + 1 END AS INT) AS label FROM p"""

V_EMB = "SELECT vec_id AS id, CAST(label AS INT) AS t, embedding FROM {embeddings}"

TEXTS = {"v_nodes": V_NODES, "v_hier": V_HIER, "v_tracks": V_TRACKS, "v_pixels": V_PIXELS, "v_emb": V_EMB}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or else a table of sf_dir."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    inputs = [x for x in ("v_nodes", "events", "lineitem", "embeddings") if f"{{{x}}}" in text]
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in inputs})


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB that starts with the named views, and those they read, as common table expressions."""
    needed = [n for n in TEXTS if n in names or n == "v_nodes" and "v_hier" in names]
    plain = {n: TEXTS[n].format(**{x: x for x in ("v_nodes", "events", "lineitem", "embeddings")}) for n in needed}
    heads = [f"{n} AS MATERIALIZED ({text})" for n, text in plain.items()]
    recursive, _, rest = sql.strip().partition("WITH RECURSIVE ")
    if rest and not recursive:
        return f"WITH RECURSIVE {', '.join(heads)}, {rest}"
    _, _, rest = sql.strip().partition("WITH ")
    return f"WITH {', '.join(heads)}, {rest}" if sql.strip().startswith("WITH ") else f"WITH {', '.join(heads)} {sql}"
