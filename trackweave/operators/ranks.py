"""Global order without a task that holds a whole table: ranges of the order, shifted by the sizes of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows written in ranges of the order, with the range's number as _part."""
    return durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their number from 1 in an order that is total. What one task sums up is one number a range."""
    spread = dealt(rows, *order)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.join(F.broadcast(sizes), "_part").withColumn(name, (own + F.col("_before")).cast("bigint")).drop("_part", "_before")


def quantiles(rows: DataFrame, column: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q): the exact quantiles of a column, on the straight line between the two values around each.

    Nulls don't count, nor do rows with a null in by; without any value q holds nulls. Equal values are counted first, and
    the counts are dealt by ranges of the value, so neither a column nor a large group meets in one task.
    """
    value = F.col(column).cast("double").alias("_v")
    spread = dealt(rows.where(F.col(column).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), *by, "_v")
    group = Window.partitionBy(*by)
    sizes = spread.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), (F.sum("_m").over(group) - 1).alias("_last"))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    ranked = spread.join(sizes, [*by, "_part"]).withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    def quantile(share: float):
        place = F.col("_last") * F.lit(float(share))
        low, high, over = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return low * (1 - over) + high * over

    return ranked.groupBy(*by).agg(F.array(*(quantile(s) for s in shares)).alias("q"))
