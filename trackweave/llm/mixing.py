"""Operator 9: mixing sources to target weights by entropy balancing.

Among all document rates between 0 and a cap whose words add up to each source's target, entropy balancing takes those
nearest to one copy each in relative entropy: rate = min(cap, exp(lambda * size / mean size of the source)). The lambdas
solve a convex dual problem; its gradient and curvature are sums over the documents, so every Newton step is one grouped
aggregation, over the histogram of sizes that is made once. A bracket guards the steps. Rates are rounded into copies
along the order of sizes, so what is rounded off in one size is made up in the next, and what is left at the end is mended
by words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
#: Newton steps stop once every source is within this share of its size; a step that leaves its bracket halves it.
TOLERANCE = 1e-5
#: After so many steps, by when the brackets are below what rates can tell apart, the dual counts as unsolvable.
MAX_STEPS = 200
#: Copies by which a source's rounded total is mended, at most.
MENDED = 6
#: Rates are whole multiples of 1 / RATE_UNIT, so that sums are exact and don't depend on the order of rows.
RATE_UNIT = 1_000_000
#: Documents of one source and size that are ranked together at most, on average.
RANKED = 500


def ranked_sources(sources: DataFrame, col: str) -> DataFrame:
    """Adds source_rank, from 0 by code point with null last: a range partitioning, then ranks within partitions.

    What reaches the driver is one count a partition.
    """
    null_last = F.col(col).isNull()
    spread = sources.repartitionByRange(null_last, col).withColumn("part", F.spark_partition_id())
    spread = written(spread, "sources")
    counts = {r["part"]: r["n"] for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    if not offsets:
        return spread.withColumn("source_rank", F.lit(0).cast("bigint")).drop("part")
    offset = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[F.col("part")]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(col).isNull(), col)) - 1
    return spread.withColumn("source_rank", (within + offset).cast("bigint")).drop("part")


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """sources (source_size, source_rank) with target: shares by weight, none above cap times its size.

    All sources below their cap get level * weight. Each round, sources whose share is above the cap are set to it, and
    the level is taken anew for the rest; the capped ones never come back, as the level only rises.
    """
    weight = F.array(*map(F.lit, weights))[(F.col("source_rank") % len(weights)).cast("int")]
    sources = written(sources.withColumn("weight", weight.cast("double")), "weights")
    limit = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    budget, level = total * share_percent / 100, None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        found = sources.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).head()
        if not found["open"]:
            break
        new = (budget - (found["full"] or 0) * cap) / found["open"]
        if level is not None and new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level if level is not None else 0.0), limit))


def _rate(lam: Column, cap: int) -> Column:
    """Copies in whole RATE_UNITs."""
    tilt = F.exp(F.least(lam * F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9)), F.lit(50.0)))
    return F.round(F.least(tilt, F.lit(float(cap))) * RATE_UNIT).cast("bigint")


def solved(sizes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(source_rank, lambda): Newton steps on the dual, over (source_rank, size, docs)."""
    at_cap = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    ratio = F.col("target") / F.greatest("source_size", F.lit(1))
    state = written(
        sources.select(
            "source_rank",
            "source_size",
            "target",
            (F.col("source_size") / F.col("source_docs")).alias("mean"),
            F.when(at_cap, F.lit(1e6)).otherwise(F.log(F.greatest(ratio, F.lit(1e-9)))).alias("lambda"),
            F.lit(-1e6).alias("low"),
            F.lit(1e6).alias("high"),
            (at_cap | (F.col("source_size") == 0)).alias("done"),
        ),
        "dual-0",
    )
    for step in range(1, MAX_STEPS + 1):
        each = sizes.join(state.where("not done").select("source_rank", "mean", "lambda"), "source_rank")
        rate = _rate(F.col("lambda"), cap)
        taken = F.col("docs") * F.col("size") * rate
        below = rate < cap * RATE_UNIT
        slope = F.when(below, (taken.cast("double") / RATE_UNIT * F.col("size") / F.col("mean")).cast("decimal(38,6)"))
        sums = each.groupBy("source_rank").agg(
            (F.sum(taken.cast("decimal(38,0)")).cast("double") / RATE_UNIT).alias("taken"), F.sum(slope).cast("double").alias("slope")
        )
        lam, low, high = F.col("lambda"), F.col("low"), F.col("high")
        over = F.col("taken") > F.col("target")
        state = (
            state.join(sums, "source_rank", "left")
            .withColumn("done", F.col("done") | (F.abs(F.col("taken") - F.col("target")) <= TOLERANCE * F.col("source_size")))
            .withColumns({"low": F.when(over, low).otherwise(lam), "high": F.when(over, lam).otherwise(high)})
            .withColumn("newton", lam - (F.col("taken") - F.col("target")) / F.greatest("slope", F.lit(1e-12)))
            .withColumn("middle", F.when(low < -1e5, high - 2).when(high > 1e5, low + 2).otherwise((low + high) / 2))
            .withColumn("next", F.when((F.col("newton") > low) & (F.col("newton") < high) & (F.abs(F.col("newton") - lam) <= 2), F.col("newton")).otherwise(F.col("middle")))
            .withColumn("lambda", F.when(F.col("done"), lam).otherwise(F.coalesce("next", lam)))
            .select(*state.columns)
        )
        # A bracket too narrow for rates to change is the solution too: rates are multiples of 1 / RATE_UNIT.
        state = written(state.withColumn("done", F.col("done") | (F.col("high") - F.col("low") < 1e-9)), f"dual-{step}")
        if not state.where("not done").head(1):
            break
    else:
        raise ArithmeticError("the dual of the mix did not converge")
    return state.select("source_rank", "mean", "lambda")


def rounded(sizes: DataFrame, duals: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds copies, all that the documents of one source and size get together.

    Within a source the sizes go up; each gets the copies that bring the running total nearest to that of the rates.
    What the source is then away from its target, in words, is mended copy by copy: each time one copy more or less of
    the size that brings it nearest. A source has as many rows here as it has sizes, however many documents it holds.
    """
    each = sizes.join(duals, "source_rank").withColumn("due", F.col("docs") * _rate(F.col("lambda"), cap))
    upto = Window.partitionBy("source_rank").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda x: F.floor((x + RATE_UNIT / 2) / RATE_UNIT).cast("bigint")
    run = F.sum("due").over(upto)
    each = each.withColumn("copies", whole(run) - whole(run - F.col("due"))).select("source_rank", "size", "docs", "copies")
    each = written(each, "copies-0")
    goal = sources.select("source_rank", "target")
    for step in range(1, MENDED + 1):
        taken = each.groupBy("source_rank").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(goal, "source_rank")
        off = taken.select("source_rank", (F.col("target") - F.col("taken")).alias("off"))
        one = F.signum("off").cast("bigint")
        after = F.abs(F.col("off") - one * F.col("size"))
        able = (F.col("copies") + one).between(0, cap * F.col("docs")) & (after < F.abs("off"))
        best = each.join(off, "source_rank").where(able).groupBy("source_rank").agg(
            F.min_by(F.struct("size", one.alias("change")), F.struct(after, "size")).alias("best")
        )
        best = written(best.select("source_rank", "best.size", "best.change"), f"mend-{step}")
        if not best.head(1):
            break
        changed = F.col("copies") + F.coalesce("change", F.lit(0))
        each = written(each.join(best, ["source_rank", "size"], "left").select("source_rank", "size", "docs", changed.alias("copies")), f"copies-{step}")
    return each


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row a row of docs: id, size, source_size, target, taken, copies.

    size counts words (null text: 0). Sources in the order of code points, null last as a source of its own, take the
    weights in turn, and share share_percent of all words; see targets(). taken is copies * size, of at most cap copies.
    Documents of one source and size share their copies evenly; which of them get one more follows a hash of the id, then
    the id, so reruns agree. Rows that repeat an id are documents of their own. Documents without words get one copy each
    and take nothing. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.size(words(F.col(text_col))).cast("bigint").alias("size"))
    rows = written(rows, "sizes")
    cells = written(rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("docs")), "cells")
    by_source = cells.groupBy("src").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("source_docs")
    )
    sources = written(targets(ranked_sources(by_source, "src"), weights, share_percent, cap), "targets")
    known = cells.join(sources.select("src", "source_rank"), cells["src"].eqNullSafe(sources["src"])).drop("src")
    known = written(known.select("source_rank", "size", "docs"), "histogram")
    shares = rounded(known, solved(known, sources, cap), sources, cap)
    # What the documents of one source and size need: all fits in a row, and large groups are ranked in buckets.
    buckets = F.ceil(F.col("docs") / RANKED)
    per_cell = written(
        shares.join(sources, "source_rank").select("src", "size", "source_size", "target", "docs", F.col("copies").alias("cell_copies"), buckets.alias("buckets")),
        "shares",
    )
    point = F.xxhash64(F.col("id").cast("string"), F.lit("mix"))
    same = rows["src"].eqNullSafe(per_cell["src"]) & (rows["size"] == per_cell["size"])
    placed = rows.join(per_cell, same).select(
        "id", rows["src"], rows["size"], "source_size", "target", "docs", "cell_copies",
        F.pmod(point, F.col("buckets")).alias("bucket"), point.alias("point"),
    )
    placed = written(placed, "placed")
    counts = placed.groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumnRenamed("n", "bucket_docs")
    same = placed["src"].eqNullSafe(before["src"]) & (placed["size"] == before["size"]) & (placed["bucket"] == before["bucket"])
    joined = placed.join(before, same).select(placed["*"], "before")
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("point", "id")) - 1 + F.col("before")
    # The k-th of n documents gets the whole part of k * copies / n, less that of the one before.
    upto_this = F.floor((F.col("rank") + 1) * F.col("cell_copies") / F.col("docs"))
    copies = (upto_this - F.floor(F.col("rank") * F.col("cell_copies") / F.col("docs"))).cast("bigint")
    return joined.withColumn("rank", rank).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )
