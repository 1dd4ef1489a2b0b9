"""Linking frames as they arrive: a file stream whose batches extend the table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.linking import knn_links


def link_stream(spark: SparkSession, nodes_path: str, schema: str, links_path: str, checkpoint: str, max_distance: float = 15.0, max_neighbors: int = 5, distance_weight: float = 0.0) -> StreamingQuery:
    """Starts a query that links every frame that new files bring with its neighbours in time, and stops with the files.

    A frame comes whole, in one or more files of one batch. Batches are told apart by their number, so one that runs
    again after a failure replaces what it wrote.
    """

    def extend(batch: DataFrame, number: int) -> None:
        fresh = [r["t"] for r in batch.select("t").distinct().collect()]
        if not fresh:
            return
        around = sorted({t + d for t in fresh for d in (-1, 0, 1)})
        nodes = spark.read.schema(schema).parquet(nodes_path).where(F.col("t").isin(around))
        found = knn_links(nodes, max_distance, max_neighbors, distance_weight)
        touched = F.col("t_source").isin(fresh) | (F.col("t_source") + 1).isin(fresh)
        found.where(touched).write.mode("overwrite").parquet(f"{links_path}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(nodes_path)
    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_links(spark: SparkSession, links_path: str) -> DataFrame:
    """The links of all batches, each once: a pair of frames that two batches touched is the same in both."""
    return spark.read.parquet(links_path).drop("batch").dropDuplicates(["source_id", "target_id"])
