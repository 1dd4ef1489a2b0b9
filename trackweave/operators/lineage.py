"""Track forests: parents, children, roots, paths, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from .ranks import numbered

NO_PARENT = -1


def first_rows(tracks: DataFrame) -> DataFrame:
    """(track_id, parent_track_id), a row a track. All rows of a track name the same parent."""
    return tracks.groupBy("track_id").agg(F.min("parent_track_id").alias("parent_track_id"))


def inverse_forest(tracks: DataFrame) -> DataFrame:
    """(track_id, parent_track_id) of the tracks that have a parent."""
    return first_rows(tracks).where(F.col("parent_track_id") != NO_PARENT)


def forest(tracks: DataFrame, remove_roots: bool = False) -> DataFrame:
    """(parent_track_id, children), children in ascending order; roots are under NO_PARENT."""
    edges = inverse_forest(tracks) if remove_roots else first_rows(tracks)
    return edges.groupBy("parent_track_id").agg(F.array_sort(F.collect_list("track_id")).alias("children"))


def ancestors(edges: DataFrame, max_steps: int = 64) -> DataFrame:
    """(id, ancestor, depth) of every node and each of its proper ancestors, from (id, parent).

    Pointer doubling: after step k all ancestors up to 2**k are known, so a chain of T needs log2(T) joins.
    """
    known = durable(edges.where(F.col("parent") != NO_PARENT).select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    for _ in range(max_steps):
        far = known.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("via"))
        more = known.select(F.col("id").alias("via"), "ancestor", "depth")
        new = far.join(more, "via").select("id", "ancestor", (F.col("depth") + reach).alias("depth"))
        new = durable(new)
        if not new.head(1):
            return known
        known = durable(known.unionByName(new))
        reach *= 2
    raise ValueError("the parents form a cycle")


def heads(edges: DataFrame, max_steps: int = 64, ends: Column | None = None) -> DataFrame:
    """(id, root) of every node, from (id, parent); root is where the parents end, at NO_PARENT or as ends tells.

    Pointer doubling.
    """
    ends = F.col("parent") == NO_PARENT if ends is None else ends
    state = durable(edges.select("id", F.when(ends, F.col("id")).otherwise(F.col("parent")).alias("root")))
    for _ in range(max_steps):
        up = state.select(F.col("id").alias("root"), F.col("root").alias("above"))
        state = state.join(up, "root", "left").select("id", "root", F.coalesce("above", "root").alias("above"))
        state = durable(state)
        done = not state.where(F.col("above") != F.col("root")).head(1)
        state = state.select("id", F.col("above").alias("root"))
        if done:
            return state
    raise ValueError("the parents form a cycle")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) of every end of edges (a, b): the least id that edges connect it with.

    In rounds each root is hung below the least root that an edge leads it to, if that is less; pointer doubling then
    finds the new roots. Edges within one tree leave, repeated ones are one, so what is left shrinks round by round.
    """
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    found, left = ends.withColumn("root", F.col("id")), edges.select("a", "b")
    for _ in range(max_rounds):
        left = durable(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if not left.head(1):
            return found
        hung = left.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "id")
        roots = found.select(F.col("root").alias("id")).distinct().join(hung, "id", "left")
        state = heads(roots, ends=F.col("parent").isNull())
        found = durable(found.withColumnRenamed("root", "_old").join(state.toDF("_old", "root"), "_old").select("id", "root"))
        for side in ("a", "b"):
            left = left.withColumnRenamed(side, "_old").join(state.toDF("_old", side), "_old").drop("_old")
    raise ValueError("the components weren't done in time")


def track_roots(tracks: DataFrame) -> DataFrame:
    """(track_id, root_id)."""
    edges = first_rows(tracks).select(F.col("track_id").alias("id"), F.col("parent_track_id").alias("parent"))
    return heads(edges).select(F.col("id").alias("track_id"), F.col("root").alias("root_id"))


def with_roots(tracks: DataFrame) -> DataFrame:
    """tracks with root_id: the forest split into trees, as a key to partition by."""
    return tracks.join(track_roots(tracks), "track_id")


def subgraph(tracks: DataFrame, track_ids: list[int]) -> DataFrame:
    """All rows of the trees that hold one of the tracks; unknown ids find nothing."""
    roots = track_roots(tracks)
    wanted = roots.where(F.col("track_id").isin(track_ids)).select("root_id").distinct()
    members = roots.join(F.broadcast(wanted), "root_id", "left_semi").select("track_id")
    return tracks.join(members, "track_id", "left_semi")


def subtree(tracks: DataFrame, track_id: int) -> DataFrame:
    """(track_id) of a track and all that descend from it."""
    edges = first_rows(tracks).select(F.col("track_id").alias("id"), F.col("parent_track_id").alias("parent"))
    below = ancestors(edges).where(F.col("ancestor") == track_id).select(F.col("id").alias("track_id"))
    return below.unionByName(edges.where(F.col("id") == track_id).select(F.col("id").alias("track_id")))


def lineage_pairs(tracks: DataFrame) -> DataFrame:
    """(track_id, ancestor, depth), with every track as its own ancestor of depth 0."""
    edges = first_rows(tracks).select(F.col("track_id").alias("id"), F.col("parent_track_id").alias("parent"))
    own = edges.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(ancestors(edges)).withColumnRenamed("id", "track_id")


def paths_to_roots(tracks: DataFrame, node_index: int | None = None, track_index: int | None = None) -> DataFrame:
    """The rows from a root to each leaf, as tracks of their own: track_id is the leaf's, without parents.

    With a track, only its path; with a node, the path of its track up to that node.
    """
    if node_index is not None and track_index is not None:
        raise ValueError("give a node or a track")
    pairs = lineage_pairs(tracks)
    if node_index is not None:
        own = tracks.where(F.col("id") == node_index).select("track_id", F.col("t").alias("_until"))
        pairs = pairs.join(F.broadcast(own), "track_id")
    elif track_index is not None:
        pairs = pairs.where(F.col("track_id") == track_index)
    else:
        parents = first_rows(tracks).select(F.col("parent_track_id").alias("track_id")).distinct()
        pairs = pairs.join(parents, "track_id", "left_anti")
    leaf = pairs.withColumnRenamed("track_id", "leaf")
    rows = tracks.withColumnRenamed("track_id", "ancestor").join(leaf, "ancestor")
    if node_index is not None:
        rows = rows.where((F.col("depth") > 0) | (F.col("t") <= F.col("_until")))
    columns = [c for c in tracks.columns if c not in ("track_id", "parent_track_id")]
    return rows.select(F.col("leaf").alias("track_id"), *columns, F.lit(NO_PARENT).cast("bigint").alias("parent_track_id"))


def path_keys(tracks: DataFrame) -> DataFrame:
    """(track_id, root_id, key): key spells the way from the root, '0' for a first child and '2' for a second one.

    Children are ordered by their ids. More than two children are an error.
    """
    edges = first_rows(tracks)
    order = F.row_number().over(Window.partitionBy("parent_track_id").orderBy("track_id"))
    steps = edges.where(F.col("parent_track_id") != NO_PARENT).withColumn("_k", order)
    digit = F.when(F.col("_k") == 1, "0").when(F.col("_k") == 2, "2").otherwise(F.raise_error(F.lit("a track has more than two children")))
    steps = steps.select(F.col("track_id").alias("ancestor"), digit.alias("digit"))
    way = lineage_pairs(tracks).join(steps, "ancestor")
    spelt = way.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "digit"))).alias("way"))
    spelt = spelt.select("track_id", F.array_join(F.transform("way", lambda x: x["digit"]), "").alias("key"))
    return track_roots(tracks).join(spelt, "track_id", "left").withColumn("key", F.coalesce("key", F.lit("")))


def inorder(tracks: DataFrame) -> DataFrame:
    """(root_id, track_id, position): first child, the track itself, second child, tree by tree, from 0 within a tree."""
    keys = path_keys(tracks).withColumn("key", F.concat("key", F.lit("1")))
    position = F.row_number().over(Window.partitionBy("root_id").orderBy("key")) - 1
    return keys.select("root_id", "track_id", position.alias("position"))


def assign_tracks(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """nodes (id, parent_id) with head_id: the first node of the maximal path without branching that a node lies on.

    A node starts a path if it has no parent, or if its parent has two children.
    """
    children = nodes.where(F.col(parent) != NO_PARENT).groupBy(parent).agg(F.count(F.lit(1)).alias("_n"))
    children = children.withColumnRenamed(parent, "_p")
    marked = nodes.join(children, nodes[parent] == children["_p"], "left").drop("_p")
    starts = F.col(parent) == NO_PARENT
    up = F.when(starts | (F.col("_n") > 1), F.lit(NO_PARENT)).otherwise(F.col(parent)).cast("bigint")
    found = heads(marked.select("id", up.alias("parent"))).withColumnRenamed("root", "head_id")
    return nodes.join(found, "id")


def add_track_ids(nodes: DataFrame) -> DataFrame:
    """nodes with track_id and parent_track_id, numbered from 1 in depth-first order: roots and children by ids.

    The order is over tracks, one row each.
    """
    labelled = durable(assign_tracks(nodes))
    by_head = labelled.where(F.col("id") == F.col("head_id")).select("head_id", F.col("parent_id").alias("_above"))
    above = labelled.select(F.col("id").alias("_above"), F.col("head_id").alias("_parent_head"))
    heads_ = by_head.join(above, "_above", "left").select("head_id", F.coalesce("_parent_head", F.lit(NO_PARENT)).cast("bigint").alias("parent_head"))
    forest_ = heads_.select(F.col("head_id").alias("track_id"), F.col("parent_head").alias("parent_track_id"))
    keys = path_keys(forest_)
    numbers = numbered(keys.withColumnRenamed("track_id", "head_id"), "track_id", "root_id", "key").select("head_id", "track_id")
    parents = numbers.select(F.col("head_id").alias("parent_head"), F.col("track_id").alias("parent_track_id"))
    table = heads_.join(numbers, "head_id").join(parents, "parent_head", "left")
    table = table.select("head_id", "track_id", F.coalesce("parent_track_id", F.lit(NO_PARENT)).cast("bigint").alias("parent_track_id"))
    return labelled.join(table, "head_id").drop("head_id")


def relabel_tracks(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Track ids and the parents that name them, old to new, by (old, new)."""
    own = mapping.select(F.col("old").alias("track_id"), F.col("new").alias("_new"))
    parents = mapping.select(F.col("old").alias("parent_track_id"), F.col("new").alias("_new_parent"))
    out = tracks.join(own, "track_id", "left").join(parents, "parent_track_id", "left")
    changed = {"track_id": F.coalesce("_new", "track_id"), "parent_track_id": F.coalesce("_new_parent", "parent_track_id")}
    return out.withColumns(changed).select(*tracks.columns)


def forest_edges(tracks: DataFrame) -> DataFrame:
    """(source, target) between nodes: parent and child if parent_id is there, else neighbouring rows of a track."""
    if "parent_id" in tracks.columns:
        return tracks.where(F.col("parent_id") != NO_PARENT).select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    before = F.lag("id").over(Window.partitionBy("track_id").orderBy("t"))
    return tracks.select(before.alias("source"), F.col("id").alias("target")).where(F.col("source").isNotNull())


def reroot(nodes: DataFrame, parent: str = "parent_id", key: str = "id") -> DataFrame:
    """Parents that aren't among the nodes become NO_PARENT."""
    known = nodes.select(F.col(key).alias("_known")).distinct()
    out = nodes.join(known, nodes[parent] == known["_known"], "left")
    fixed: Column = F.when(F.col("_known").isNull(), F.lit(NO_PARENT)).otherwise(F.col(parent)).cast("bigint")
    return out.withColumn(parent, fixed).drop("_known")
