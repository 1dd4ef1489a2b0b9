"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a table of fixed-width keys is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of characters other than white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_trackweave_tables"):
        spark._trackweave_tables = []
    return spark._trackweave_tables


def n_written(spark: SparkSession) -> int:
    return len(_paths(spark))


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that written() made after the first since ones, but for the last keep of them.

    Results that read them must have been stored before.
    """
    known = _paths(spark)
    end = max(len(known) - keep, since)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in known[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del known[since:end]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; the caller has written it, so the count is cheap."""
    return F.broadcast(df) if df.count() <= limit else df


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in dropped (one column); a row without an id stays."""
    return docs.join(small(dropped), id_col, "left_anti")
