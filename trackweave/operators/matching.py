"""Ground truth: matches, blocked nodes, labels of links, estimated parameters; and the tables that classifiers use."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_OVERLAP, BLOCKED = -1, 0


class ProbabilisticClassifier(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> Any: ...
    def predict_proba(self, x: np.ndarray) -> np.ndarray: ...


def gt_matches(nodes: DataFrame, gt_links: DataFrame) -> DataFrame:
    """nodes with gt_track_id: the label of their selected link, or NO_OVERLAP."""
    chosen = gt_links.where("selected").groupBy("source_id").agg(F.min("target_id").alias("gt_track_id"))
    out = nodes.join(chosen, nodes["id"] == chosen["source_id"], "left").drop("source_id")
    return out.withColumn("gt_track_id", F.coalesce("gt_track_id", F.lit(NO_OVERLAP).cast("bigint")))


def blocked(nodes: DataFrame, overlaps: DataFrame) -> DataFrame:
    """nodes whose overlapping partner is matched become BLOCKED: first those below a matched one, then those above.

    The second pass sees the results of the first, in which BLOCKED counts as matched.
    """
    for own, other in (("node_id", "ancestor_id"), ("ancestor_id", "node_id")):
        matched = nodes.where(F.col("gt_track_id") != NO_OVERLAP).select(F.col("id").alias(other))
        hit = overlaps.join(matched, other, "left_semi").select(F.col(own).alias("_hit")).distinct()
        nodes = nodes.join(hit, nodes["id"] == hit["_hit"], "left")
        nodes = nodes.withColumn("gt_track_id", F.when(F.col("_hit").isNotNull(), F.lit(BLOCKED).cast("bigint")).otherwise(F.col("gt_track_id"))).drop("_hit")
    return nodes


def link_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links with gt: both ends matched, to the same track."""
    side = lambda n: nodes.select(F.col("id").alias(f"{n}_id"), F.col("gt_track_id").alias(f"_{n}"))
    both = links.join(side("source"), "source_id").join(side("target"), "target_id")
    gt = (F.col("_source") > 0) & (F.col("_target") > 0) & (F.col("_source") == F.col("_target"))
    return both.withColumn("gt", gt).drop("_source", "_target")


def competing_links(labelled: DataFrame) -> DataFrame:
    """All links of the targets that have a true one."""
    any_true = F.max(F.col("gt").cast("int")).over(Window.partitionBy("target_id"))
    return labelled.withColumn("_any", any_true).where("_any = 1").drop("_any")


def optimized_config(matched: DataFrame, drift: DataFrame) -> DataFrame:
    """One row: parameters that the matched nodes (area, parent_frontier) and the one row of drift suggest."""
    found = matched.agg(
        (F.min("area") * 0.95).alias("min_area"),
        (F.max("area") * 1.025).alias("max_area"),
        F.greatest(F.min("parent_frontier") - 0.025, F.lit(0.0)).alias("min_frontier"),
    )
    both = found.join(F.broadcast(drift), F.lit(True) == F.lit(True))
    return both.select((F.col("drift") + 1.0).alias("max_distance"), *found.columns)


def set_values(nodes: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """nodes with the columns of patch where it has a row; a patch row without a node is an error."""
    columns = [c for c in patch.columns if c != key]
    if patch.join(nodes.select(key), key, "left_anti").head(1):
        raise ValueError("values for nodes that don't exist")
    new = patch.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = nodes.join(new, key, "left")
    kept = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c in nodes.columns else F.col(f"_{c}") for c in columns}
    return out.withColumns(kept).drop("_hit", *(f"_{c}" for c in columns))


def get_values(nodes: DataFrame, ids: list[int], columns: list[str]) -> DataFrame:
    """Rows of the ids; an unknown id, or one given twice, is an error."""
    found = nodes.where(F.col("id").isin(ids)).select("id", *columns)
    if found.count() != len(ids):
        raise ValueError("not every id has one node")
    return found


def set_link_weights(links: DataFrame, probs: DataFrame) -> DataFrame:
    """links with the weights of probs (source_id, target_id, weight); a pair that is no link is an error."""
    keys = ["source_id", "target_id"]
    if probs.join(links, keys, "left_anti").head(1):
        raise ValueError("probabilities for links that don't exist")
    new = probs.select(*keys, F.col("weight").alias("_w"))
    return links.join(new, keys, "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")


def fit_classifier(rows: DataFrame, features: list[str], label: str, model: ProbabilisticClassifier, max_rows: int = 100_000, seed: int = 1) -> Any:
    """Fits on a sample of at most about max_rows labelled rows, which is what the driver holds."""
    share = min(1.0, max_rows / max(rows.count(), 1))
    sample = rows.sample(share, seed) if share < 1 else rows
    pdf = sample.select(*features, F.col(label).cast("int").alias("_y")).toPandas()
    return model.fit(pdf[features].to_numpy(float), pdf["_y"].to_numpy())


def predict(rows: DataFrame, keys: list[str], features: list[str], model: ProbabilisticClassifier) -> DataFrame:
    """(keys, prob): the probability of the last class."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pdf[keys].copy()
            probs = np.asarray(model.predict_proba(pdf[features].to_numpy(float)))
            made["prob"] = probs[:, -1] if probs.ndim == 2 else probs
            yield made

    return rows.select(*keys, *features).mapInPandas(run, f"{kinds}, prob double")


class LogisticClassifier:
    """A plain default: logistic regression by gradient descent on standardised features."""

    def __init__(self, steps: int = 300, rate: float = 0.5):
        self.steps, self.rate = steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> LogisticClassifier:
        self.mean, self.std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            self.w -= self.rate * z.T @ (1 / (1 + np.exp(-z @ self.w)) - y) / len(y)
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-z @ self.w))
        return np.stack([1 - p, p], axis=1)
