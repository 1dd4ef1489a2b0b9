"""Matches of nodes with true labels by how much their boxes share, without a list of all pairs.

Pairs that meet grow with the square of a frame's nodes. A window of up to TOGETHER rows is one task, which holds its rows
and the best few pairs of each label only: it takes the best pair of all, again and again, and lists those of a label anew,
from the nodes that are left around it, when all it had are gone. Larger windows are dealt: pairs are added up in tasks, part
by part of a frame, and only the best few of each node and of each label leave. A pair is taken if it is the best of its node, of its label and of what
overlaps the node, as best_links() takes them; what isn't listed of a node or label is worth less than its last listed pair,
and holds back all that is worth less than that. Of what is open then the best few are listed again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from .ranks import numbered
from .solving import both_ways

#: Pairs that are listed of a node or label: as many as make that many for all nodes, within limits.
LISTED, LEAST, MOST = 4_000_000, 4, 64
#: Nodes of a part of a frame, about, and the boxes that are compared at once.
DEALT, COMPARED = 5_000, 1_000_000
#: Rows of a window that are matched in one task, and the pairs that it holds of a label.
TOGETHER, HELD = 2_000_000, 16
#: The share of a listing's pairs that a round must bring, or the best of what is open are listed anew.
TAIL = 0.1

SIDES = ["id", "y", "x", "h"]
FOUND = "w bigint, source_id bigint, label bigint, value double"
LISTS = "w bigint, source_id bigint, label bigint, value double, of_source boolean, more boolean"


class _Around:
    """The sources of a window that are left, by bands of y and then by x."""

    def __init__(self, s: dict[str, np.ndarray], penalty: float):
        self.most = int(s["h"].max())
        self.high = self.most + 1
        band = s["y"] // self.high
        order = np.lexsort((s["id"], s["x"], band))
        self.id, self.plus, self.minus, self.penalty = s["id"][order], s["plus"][order], s["minus"][order], penalty
        small = max(int(np.abs(s[a]).max()) for a in "yx") < 2**30 and self.most < 2**14
        self.low, self.end = ([(s[a] + sign * s["h"] + more)[order].astype(np.int32 if small else np.int64) for a in "yx"] for sign, more in ((-1, 0), (1, 1)))
        # Ranks instead of places, so that any places fit a key.
        self.bands, self.places = np.unique(band), np.unique(s["x"])
        self.key = np.searchsorted(self.bands, band[order]) * (len(self.places) + 1) + np.searchsorted(self.places, s["x"][order])
        self.at, self.left, self.sums = np.arange(len(order)), bytearray(b"\1" * len(order)), np.zeros(len(order), np.int64)
        self.open = np.frombuffer(self.left, bool)

    def slices(self, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of boxes g where the sources lie that may meet them: from and to, a column a band."""
        reach = g["h"] + self.most
        low, high = (g["y"] - reach) // self.high, (g["y"] + reach) // self.high
        bands = low[:, None] + np.arange(int((high - low).max()) + 1)
        rank = np.minimum(np.searchsorted(self.bands, bands), len(self.bands) - 1)
        there = (self.bands[rank] == bands) & (bands <= high[:, None])
        first = rank * (len(self.places) + 1)
        ends = (np.searchsorted(self.key, first + np.searchsorted(self.places, x, side)[:, None]) for x, side in ((g["x"] - reach, "left"), (g["x"] + reach, "right")))
        return tuple(np.where(there, end, 0) for end in ends)

    def met(self, ranges: list[tuple[int, int]], y: tuple[int, int], x: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The sources left in ranges whose boxes meet that of y and x, and the pixels shared."""
        at = np.concatenate([self.at[a:b] for a, b in ranges])
        at = at[self.open[at]]
        shared = np.minimum(self.end[1][at], x[1]) - np.maximum(self.low[1][at], x[0])
        at, shared = at[shared > 0], shared[shared > 0]
        other = np.minimum(self.end[0][at], y[1]) - np.maximum(self.low[0][at], y[0])
        meets = other > 0
        return at[meets], shared[meets] * other[meets]

    def added(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The sources of several boxes, each once, with what they share in all."""
        new = []
        for at, shared in found:
            new.append(at[self.sums[at] == 0])
            self.sums[at] += shared
        at = np.concatenate(new)
        shared = self.sums[at]
        self.sums[at] = 0
        return at, shared

    def best(self, at: np.ndarray, shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """The best k of sources by value, then by id, with their values, and whether there are more."""
        value = shared.astype(float) - self.penalty + self.plus[at] - self.minus[at]
        at, value = at[value > 0], value[value > 0]
        more = len(at) > k
        if more:
            least = np.partition(value, len(value) - k)[len(value) - k]
            at, value = at[value >= least], value[value >= least]
        order = np.lexsort((self.id[at], -value))[:k]
        return at[order], value[order], more


def _matched(s: dict[str, np.ndarray], g: dict[str, np.ndarray], clashes: tuple[np.ndarray, np.ndarray], penalty: float) -> tuple[list[int], list[int], list[float]]:
    """(id, label, value) of the pairs that are taken, the best of all that are left first.

    A label waits in a heap with the best pair that it had when it was looked at; as sources only go, none of its pairs is
    better, so what comes out on top with a source that is left is the best of all.
    """
    around = _Around(s, penalty)
    left, ids, k = around.left, around.id, HELD
    order = np.argsort(g["id"], kind="stable")
    g = {c: x[order] for c, x in g.items()}
    labels, first = np.unique(g["id"], return_index=True)
    first, labels = [*first.tolist(), len(g["id"])], labels.tolist()
    lows, highs = (x.tolist() for x in around.slices(g))
    sides = {a: list(zip((g[a] - g["h"]).tolist(), (g[a] + g["h"] + 1).tolist(), strict=True)) for a in "yx"}
    rank = np.argsort(ids)
    # The sources that each one rules out, both ways.
    ends = [np.minimum(np.searchsorted(ids, c, sorter=rank), len(ids) - 1) for c in clashes]
    ends = [rank[e] for e in ends]
    known = (ids[ends[0]] == clashes[0]) & (ids[ends[1]] == clashes[1])
    a, b = (np.concatenate(x) for x in ((ends[0][known], ends[1][known]), (ends[1][known], ends[0][known])))
    by = np.argsort(a, kind="stable")
    ruled, start = b[by], np.searchsorted(a[by], np.arange(len(ids) + 1))
    held, values = np.zeros((len(labels), k), np.int32), np.zeros((len(labels), k))
    n, at, cut = [0] * len(labels), [0] * len(labels), bytearray(len(labels))

    def listed(label: int) -> None:
        found = []
        for box in range(first[label], first[label + 1]):
            ranges = [x for x in zip(lows[box], highs[box], strict=True) if x[0] < x[1]]
            if ranges:
                found.append(around.met(ranges, sides["y"][box], sides["x"][box]))
        n[label], cut[label] = 0, False
        if not found:
            return
        sources, value, more = around.best(*(found[0] if len(found) == 1 else around.added(found)), k)
        held[label, : len(sources)], values[label, : len(sources)] = sources, value
        n[label], at[label], cut[label] = len(sources), 0, more

    heap = []
    for label in range(len(labels)):
        listed(label)
        if n[label]:
            heap.append((-float(values[label, 0]), int(ids[held[label, 0]]), -labels[label], label))
    heapq.heapify(heap)
    taken: tuple[list[int], list[int], list[float]] = ([], [], [])
    while heap:
        value, source_id, _, label = heap[0]
        source = int(held[label, at[label]])
        if left[source]:
            heapq.heappop(heap)
            left[source] = 0
            for other in ruled[start[source] : start[source + 1]].tolist():
                left[other] = 0
            for column, x in zip(taken, (source_id, labels[label], -value), strict=True):
                column.append(x)
            continue
        while at[label] < n[label] and not left[held[label, at[label]]]:
            at[label] += 1
        if at[label] == n[label] and cut[label]:
            listed(label)
        if at[label] < n[label]:
            source = int(held[label, at[label]])
            heapq.heapreplace(heap, (-float(values[label, at[label]]), int(ids[source]), -labels[label], label))
        else:
            heapq.heappop(heap)
    return taken


def _together(sources: DataFrame, truth: DataFrame, overlaps: DataFrame, windows: int, penalty: float) -> DataFrame:
    """match_boxes() with a window a task."""

    def solve(rows: pd.DataFrame, clashes: pd.DataFrame) -> pd.DataFrame:
        of = rows["truth"].to_numpy()
        s, g = ({c: rows[c].to_numpy()[of == side] for c in (*SIDES, "plus", "minus")} for side in (False, True))
        taken = _matched(s, g, tuple(clashes[c].to_numpy() for c in ("node_id", "ancestor_id")), penalty) if len(s["id"]) and len(g["id"]) else ([], [], [])
        return pd.DataFrame({"w": np.full(len(taken[0]), rows["w"].iloc[0] if len(rows) else 0), **dict(zip(("source_id", "label", "value"), taken, strict=True))})

    # Few windows are dealt to many partitions, so that hardly two of them meet in one.
    parts = min(8 * windows, 2000)
    own = sources.select("w", F.lit(False).alias("truth"), *SIDES, "plus", "minus")
    rows = own.unionByName(truth.select("w", F.lit(True).alias("truth"), *SIDES, F.lit(0.0).alias("plus"), F.lit(0.0).alias("minus")))
    clashes = overlaps.join(sources.select("w", F.col("id").alias("node_id")), "node_id").select(F.col("w").alias("_w"), "node_id", "ancestor_id")
    return durable(rows.repartition(parts, "w").groupBy("w").cogroup(clashes.repartition(parts, "_w").groupBy("_w")).applyInPandas(solve, FOUND))


def _firsts(owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted owners, which rows are among the first k of theirs, and which of these are the k-th before others."""
    first = np.searchsorted(owner, owner)
    at = np.arange(len(owner)) - first
    return at < k, (at == k - 1) & (np.searchsorted(owner, owner, side="right") - first > k)


def _leaf(s: dict[str, np.ndarray], g: dict[str, np.ndarray], k: int, penalty: float) -> list[tuple[np.ndarray, ...]]:
    """(id, label, value, more) of the best k of each source, and the same of each label. Sources come by ids."""
    edge = lambda n, a: (n[a] - n["h"], n[a] + n["h"] + 1)
    shared = []
    for a in "yx":
        (low, high), (g_low, g_high) = edge(s, a), edge(g, a)
        shared.append(np.minimum(high[:, None], g_high) - np.maximum(low[:, None], g_low))
    row, column = np.nonzero((shared[0] > 0) & (shared[1] > 0))
    labels, number = np.unique(g["id"], return_inverse=True)
    n, m = len(s["id"]), len(labels)
    total = np.bincount(row * m + number[column], shared[0][row, column].astype(float) * shared[1][row, column], n * m)
    at = np.flatnonzero(total)
    value = total[at] - penalty + s["plus"][at // m] - s["minus"][at // m]
    at, value = at[value > 0], value[value > 0]
    values = np.unique(value)
    v, worse = len(values), len(values) - 1 - np.searchsorted(values, value)
    made = []
    # By source, value and label downwards; by label, value and source upwards.
    for by, other, size in ((at // m, m - 1 - at % m, m), (at % m, at // m, n)):
        key = np.sort((by * v + worse) * size + other)
        keep, more = _firsts(key // (v * size), k)
        key, more = key[keep], more[keep]
        own, rest, best = key // (v * size), key % size, values[v - 1 - key // size % v] if v else key.astype(float)
        source, label = (own, m - 1 - rest) if not made else (rest, own)
        made.append((s["id"][source], labels[label], best, more))
    return made


def _part(s: dict[str, np.ndarray], g: dict[str, np.ndarray], k: int, penalty: float) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, ...]]]:
    """The lists of a part's sources, and those of its labels, by halving the sources until few boxes are to be compared."""
    own, theirs = [], []
    reach = int(s["h"].max() + g["h"].max())
    todo = [(np.argsort(s["id"]), np.arange(len(g["id"])))]
    while todo:
        some, near = todo.pop()
        for a in "yx":
            at = g[a][near]
            near = near[(at >= s[a][some].min() - reach) & (at <= s[a][some].max() + reach)]
        if not len(near):
            continue
        if len(some) > 1 and len(some) * len(near) > COMPARED:
            a = max("yx", key=lambda c: np.ptp(s[c][some]))
            order, half = np.argsort(s[a][some], kind="stable"), len(some) // 2
            todo += [(some[np.sort(order[:half])], near), (some[np.sort(order[half:])], near)]
            continue
        lists = _leaf({c: x[some] for c, x in s.items()}, {c: x[near] for c, x in g.items()}, k, penalty)
        own.append(lists[0])
        theirs.append(lists[1])
    if len(theirs) > 1:
        ids, label, value, more = (np.concatenate(x) for x in zip(*theirs, strict=True))
        cut = np.isin(label, label[more])
        order = np.lexsort((ids, -value, label))
        keep, last = _firsts(label[order], k)
        upto = np.arange(len(order)) - np.searchsorted(label[order], label[order]) == k - 1
        kept = order[keep]
        theirs = [(ids[kept], label[kept], value[kept], (last | (upto & cut[order]))[keep])]
    return own, theirs


def _lists(k: int, penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (w, by, bx, truth, SIDES, plus, minus) come sorted by the first three, out go LISTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def solved() -> Iterator[pa.RecordBatch]:
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            s, g = ({c: x[rows["truth"] == side] for c, x in rows.items()} for side in (False, True))
            if not len(s["id"]) or not len(g["id"]):
                return
            for of_source, lists in zip((True, False), _part(s, g, k, penalty), strict=True):
                for ids, label, value, more in lists:
                    columns = [np.full(len(ids), rows["w"][0]), ids, label, value, np.full(len(ids), of_source), more]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w", "source_id", "label", "value", "of_source", "more"])

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            keys = np.stack([rows[c] for c in ("w", "by", "bx")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *new], [*new, batch.num_rows], strict=True):
                if low == high:
                    continue
                if held and any(held[-1][c][-1] != rows[c][low] for c in ("w", "by", "bx")):
                    yield from solved()
                held.append({c: x[low:high] for c, x in rows.items()})
        if held:
            yield from solved()

    return run


def _listed(sources: DataFrame, truth: DataFrame, penalty: float) -> DataFrame:
    """The best pairs of each source and of each label as LISTS; more at a list's last row if pairs were left out."""
    n, half = (x or 0 for x in sources.agg(F.count(F.lit(1)), F.max("h")).head())
    reach = 2 * max(half, truth.agg(F.max("h")).head()[0] or 0) + 1
    k = min(max(LISTED // max(n, 1), LEAST), MOST)
    cells = sources.select("w", F.floor(F.col("y") / reach), F.floor(F.col("x") / reach)).distinct().count()
    side = reach * max(1, math.isqrt(DEALT * cells // max(n, 1)))
    place = lambda c, by=0: F.floor((F.col(c) + by) / side)
    own = sources.select("w", place("y").alias("by"), place("x").alias("bx"), F.lit(False).alias("truth"), *SIDES, "plus", "minus")
    near = truth.withColumn("by", F.explode(F.sequence(place("y", -reach), place("y", reach)))).withColumn("bx", F.explode(F.sequence(place("x", -reach), place("x", reach))))
    near = near.select("w", "by", "bx", F.lit(True).alias("truth"), *SIDES, F.lit(0.0).alias("plus"), F.lit(0.0).alias("minus"))
    key, parts = ["w", "by", "bx"], math.ceil(2 * n / DEALT) or 1
    rows = own.unionByName(near).repartition(parts, *key).sortWithinPartitions(*key)
    made = durable(rows.mapInArrow(_lists(k, penalty), LISTS))
    # A label's nodes lie in several parts.
    w = Window.partitionBy("w", "label")
    labels = made.where("not of_source").withColumns({"_n": F.row_number().over(w.orderBy(F.desc("value"), "source_id")), "_all": F.count(F.lit(1)).over(w), "_cut": F.max("more").over(w)})
    labels = labels.where(F.col("_n") <= k).withColumn("more", (F.col("_n") == k) & ((F.col("_all") > k) | F.col("_cut")))
    return durable(made.where("of_source").unionByName(labels.select(made.columns)))


def _gone(new: DataFrame, clashes: DataFrame) -> DataFrame:
    """(w, truth, a): the sources and labels of pairs that are taken, and the sources that overlap one of these."""
    ends = new.select("w", F.lit(False).alias("truth"), F.col("source_id").alias("a")).unionByName(new.select("w", F.lit(True).alias("truth"), F.col("label").alias("a")))
    hit = clashes.join(new.select("w", F.col("source_id").alias("b")), ["w", "b"], "left_semi").select("w", F.lit(False).alias("truth"), "a")
    return ends.unionByName(hit).distinct()


def _rounds(lists: DataFrame, clashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that are taken, ends that are gone) of lists, as long as rounds bring enough or nothing was left out."""
    order = F.struct("value", (-F.col("source_id")).alias("s"), F.col("label").alias("g")).alias("key")
    ends = [lists.select("w", F.lit(c == "label").alias("truth"), F.col(c).alias("a"), F.col("source_id"), F.col("label"), order, "more", "of_source") for c in ("source_id", "label")]
    # A pair at each of its ends; of a list that is cut, its last pair stays when the pair itself is gone.
    floors = ends[0].where("more and of_source").unionByName(ends[1].where("more and not of_source")).select("w", "truth", "a", "key")
    free, floors = durable(lists.select("w", "source_id", "label", order).distinct()), durable(floors)
    taken, gone, total, cut = [], [], 0, bool(floors.head(1))
    while free.head(1):
        every = floors
        for c in ("source_id", "label"):
            every = every.unionByName(free.select("w", F.lit(c == "label").alias("truth"), F.col(c).alias("a"), "key"))
        best = every.groupBy("w", "truth", "a").agg(F.max("key").alias("key"))
        best = durable(best)
        around = clashes.join(best.where("not truth").select("w", F.col("a").alias("b"), "key"), ["w", "b"]).groupBy("w", "a").agg(F.max("key").alias("rival"))
        source = best.where("not truth").join(around, ["w", "a"], "left").where("key.s = -a and (rival IS NULL or key >= rival)")
        both = source.select("w", "key").join(best.where("truth and key.g = a").select("w", "key"), ["w", "key"])
        new = durable(both.select("w", (-F.col("key.s")).alias("source_id"), F.col("key.g").alias("label"), F.col("key.value").alias("value")))
        more = new.count()
        if not more:
            break
        total += more
        taken.append(new)
        gone.append(durable(_gone(new, clashes)))
        if cut and more <= TAIL * total:
            break
        for c in ("source_id", "label"):
            free = free.join(gone[-1].where(F.col("truth") == F.lit(c == "label")).select("w", F.col("a").alias(c)), ["w", c], "left_anti")
        free, floors = durable(free), floors.join(gone[-1], ["w", "truth", "a"], "left_anti")
        floors = durable(floors) if cut else floors
    return _union(taken), _union(gone)


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def match_boxes(sources: DataFrame, truth: DataFrame, overlaps: DataFrame, penalty: float = 1e-3) -> DataFrame:
    """(w, source_id, label, value): the pairs that best_links() takes of all sources and labels whose boxes share pixels.

    sources: w (a window), id, y, x, h (half extent), plus, minus; truth: w, id (the label), y, x, h, any number of rows a
    label; overlaps: node_id, ancestor_id. A pair's value is what the source's box shares with those of the label, less
    penalty, plus plus less minus; pairs without value aren't taken. A source has one label, a label one source, and of
    overlapping sources one is taken; equal values are told apart by the smaller source, then the larger label. Rows with a
    null aren't matched.
    """
    whole = [F.floor(c).cast("bigint").alias(c) for c in "yx"]
    sources = durable(sources.select(F.col("w").cast("bigint").alias("w"), "id", *whole, F.col("h").cast("bigint").alias("h"), *(F.col(c).cast("double").alias(c) for c in ("plus", "minus"))).dropna())
    truth = durable(truth.select(F.col("w").cast("bigint").alias("w"), "id", *whole, F.col("h").cast("bigint").alias("h")).dropna())
    sizes = sources.select("w").unionByName(truth.select("w")).groupBy("w").count().agg(F.count(F.lit(1)), F.max("count")).head()
    if (sizes[1] or 0) <= TOGETHER:
        return _together(sources, truth, overlaps, max(sizes[0], 1), penalty)
    clashes = durable(both_ways(overlaps.join(sources.select("w", F.col("id").alias("node_id")), "node_id").select("w", "node_id", "ancestor_id")))
    taken = [sources.sparkSession.createDataFrame([], FOUND)]
    while True:
        lists = _listed(sources, truth, penalty)
        if not lists.head(1):
            return _union(taken)
        new, gone = _rounds(lists, clashes)
        taken.append(new)
        # Those without a pair have none later on.
        met = lists.select("w", F.lit(False).alias("truth"), F.col("source_id").alias("a")).unionByName(lists.select("w", F.lit(True).alias("truth"), F.col("label").alias("a")))
        left = durable(met.distinct().join(gone, ["w", "truth", "a"], "left_anti"))
        of = lambda side: left.where(F.col("truth") == F.lit(side)).select("w", F.col("a").alias("id"))  # noqa: E731, B023
        sources, truth = durable(sources.join(of(False), ["w", "id"], "left_semi").select(sources.columns)), durable(truth.join(of(True), ["w", "id"], "left_semi").select(truth.columns))


def match_boxes_by_area(nodes: DataFrame, truth: DataFrame, overlaps: DataFrame, peaks: DataFrame, penalty: float = 1e-3) -> DataFrame:
    """(t, source_id, target_id, peak): what solving.match_frames_by_area() gives for all nodes (t, id, y, x, h, area) and
    labels (t, id, y, x, h) whose boxes share pixels, without their list."""
    most = nodes.groupBy("t").agg(F.max("area").alias("plus"))
    templates = durable(numbered(peaks.join(most, "t").select("t", "peak", "plus").dropna(), "w", "t", "peak"))
    few = F.broadcast(templates)  # some rows a frame
    sources = nodes.join(few, "t").select("w", "id", "y", "x", "h", "plus", F.abs(F.col("peak") - F.col("area")).alias("minus"))
    found = durable(match_boxes(sources, truth.join(few, "t").select("w", "id", "y", "x", "h"), overlaps, penalty).join(few, "w"))
    worth = found.groupBy("t", "peak").agg(F.round(F.sum("value"), 6).alias("worth"))
    kept = worth.groupBy("t").agg(F.max_by("peak", F.struct("worth", -F.col("peak"))).alias("peak"))
    return found.join(kept, ["t", "peak"]).select("t", "source_id", F.col("label").alias("target_id"), "peak")
