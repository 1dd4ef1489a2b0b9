"""Counts and filters over nodes and solutions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import NO_PARENT, reroot


def nodes_per_frame(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def max_frame(nodes: DataFrame) -> int:
    found = nodes.agg(F.max("t")).head()[0]
    if found is None:
        raise ValueError("there are no nodes")
    return found


def frame_range(nodes: DataFrame, first: int, last: int) -> DataFrame:
    return nodes.where(F.col("t").between(first, last))


def compared(column: str, operator: str, value) -> Column:
    """A condition from its parts."""
    c = F.col(column)
    kinds = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "==": c == value, "!=": c != value}
    if operator not in kinds:
        raise ValueError(f"unknown operator {operator!r}")
    return kinds[operator]


def sampled_min_max(nodes: DataFrame, column: str, frames: int = 10) -> DataFrame:
    """(least, most) of a column over about that many frames, evenly spaced."""
    step = max(1, (max_frame(nodes) + 1) // frames)
    return nodes.where(F.col("t") % step == 0).agg(F.min(column).alias("least"), F.max(column).alias("most"))


def without_nodes(nodes: DataFrame, condition: Column) -> DataFrame:
    """nodes without those that meet the condition; children of these have no parent any more."""
    return reroot(nodes.where(~condition))


def outside_margin(margin: tuple[int, int], height: int, width: int) -> Column:
    """Whether a node's box, of half extent h, doesn't meet the image less a margin in y and one in x."""
    low = lambda c: F.floor(F.col(c)) - F.col("h")
    high = lambda c: F.floor(F.col(c)) + F.col("h") + 1
    meets = lambda c, m, n: F.greatest(low(c), F.lit(m)) < F.least(high(c), F.lit(n - m))
    return ~(meets("y", margin[0], height) & meets("x", margin[1], width))


def vanishes(scale: float) -> Column:
    """Whether a box is less than a pixel wide after scaling."""
    return (2 * F.col("h") + 1) * scale < 1


def column_over_time(nodes: DataFrame, column: str) -> DataFrame:
    """(t, stat, value) with the mean, least and most of each frame."""
    stats = nodes.groupBy("t").agg(
        F.round(F.avg(column), 6).alias("mean"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max")
    )
    return stats.unpivot("t", ["mean", "min", "max"], "stat", "value")


def solution_summary(nodes: DataFrame) -> DataFrame:
    """One row about nodes (id, t, parent_id): segments, appearances, ends, divisions, tracks.

    Tracks are the heads: appearances, and both children of each division.
    """
    children = nodes.where(F.col("parent_id") != NO_PARENT).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    per = nodes.join(children.withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left")
    appears, divides = F.col("parent_id") == NO_PARENT, F.coalesce("n", F.lit(0)) > 1
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return per.agg(
        F.count(F.lit(1)).alias("segments"), count(appears).alias("appearances"), count(F.col("n").isNull()).alias("ends"),
        count(divides).alias("divisions"), (count(appears) + F.coalesce(F.sum(F.when(divides, F.col("n"))), F.lit(0))).alias("tracks"),
    )


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a table has no rows; one that isn't there has none."""
    try:
        return spark.read.parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return True


def division_parents(nodes: DataFrame) -> DataFrame:
    """(parent_id, children) of the nodes with more than one child."""
    found = nodes.where(F.col("parent_id") != NO_PARENT).groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    return found.where("children > 1")


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in a random order, for annotation."""
    return rows.orderBy(F.rand(seed)).limit(n)
