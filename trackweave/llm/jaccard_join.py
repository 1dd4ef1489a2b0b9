"""Operator 7: exact Jaccard join of documents as sets of word shingles, by metric-space regions.

Jaccard distance is a metric, but unrelated documents are all nearly 1 apart: windows of twice the radius around the
borders of pivots drawn from the whole corpus would replicate every document into every region. The corpus therefore
falls into regions by two exact levels first, and pivots, Voronoi cells and windows join the regions:

1. Shells. Under the symmetric-difference metric the distance to the empty set is the size. Sizes are cut into shells,
   and documents within the triangle-inequality window of a shell's upper border are replicated into it.
2. Parts. In a shell, linked sets differ in at most K shingles. A hash deals the shingles into m > K parts, so linked sets
   agree on at least m - K of them, and sets that agree on a part of some shingles share its cell. Shingles of passages
   that very many documents share are left out where the others suffice, by counts over all documents.
3. Regions. Cells that share documents make up a region; every link lies within one. Every region, however small, is
   joined by pivots: a document links with a pivot within the radius, goes into the cell of its nearest pivot and into
   each other whose pivot is at most 2 * radius farther, and cells are joined in the same way, down to single documents.
   Documents that links connect already need no comparison, so pivots are taken from the others, and a group of near
   copies costs as many comparisons as it has members. Regions too large for a task are parted by Spark jobs.

Links are never listed pair by pair: what leaves a cell is each document's smallest linked one there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .pieces import portions, ranges

#: Defaults: words in a shingle; linked if PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 3, 90
SHELL_RATIO = 1.5
#: More parts than linked sets differ in, by this factor, so that empty parts do no harm.
PARTS = 1.25
#: How often a set is dealt out anew if too many of its parts are empty; after that all such sets of a shell share a cell.
DEALS = 3
#: Shingles are counted in 2 ** SLOT_BITS slots; those of slots with more than HOT_LEAST, and HOT roots of the mean above
#: it, are hot: a passage of more copies than its slot's count varies by chance.
SLOT_BITS, HOT, HOT_LEAST = 20, 5, 8
#: Counts that travel together, and how many streams each such block is first added up in.
BLOCK, STREAMS = 1 << 14, 16
#: Distinct sets a task remembers to join copies at once; when full, it starts anew.
REMEMBERED = 100_000
#: Regions of up to so many sets and shingles are joined within a task.
REGION_SETS, REGION_SHINGLES = 4096, 3_000_000
#: Rows and columns that are compared at once, the cost of a shared shingle against that of a place in a matrix, and the
#: shared shingles that are counted at once.
COMPARED, SPARSE, MET = 512, 450, 2_000_000
#: Share of a region's pairs that its Voronoi cells may leave; else it stays whole, without the pivots.
PARTED = 0.5
#: Pivots of a large region in its first round, about, and at most as they double from round to round, fewer if they are
#: long; how many of them have a Voronoi cell; and the sets that a task compares with them, at least.
PIVOTS, MOST_PIVOTS, CENTRES, DEALT = 256, 1024, 64, 1000
#: Texts that are made into sets at once, by number and by bytes.
TEXTS, TEXT_BYTES = 400, 3_000_000
#: Bytes up to which words are hashed all at once.
LONG = 64

_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


# Shingles


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all other bytes as they are."""
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    data[(data >= 65) & (data <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes, 8 of them at a time for all words at once; long words, which are few, by xxhash."""
    from xxhash import xxh64_intdigest

    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, left = offsets[:-1] - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        found = mixed(left.astype(np.uint64) * _C3 + _C2)
        at = np.flatnonzero(left <= LONG)
        for k in range(0, LONG, 8):
            at = at[left[at] > k]
            if not len(at):
                break
            unused = np.uint64(8) * np.maximum(8 + k - left[at], 0).astype(np.uint64)
            piece = eights[start[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)
            found[at] = mixed((found[at] ^ piece) * _C1)
    for k in np.flatnonzero(left > LONG).tolist():
        found[k] = xxh64_intdigest(data[start[k] : start[k] + left[k]].tobytes())
    return found


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' shingles in order, and the number of the text that each is of.

    A text of fewer words is one shingle, which no whole shingle equals.
    """
    words = pc.ascii_split_whitespace(ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat, offsets = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    h = word_hashes(flat.filter(pa.array(real)))
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(offsets[1:], n) - np.arange(len(h))
    with np.errstate(over="ignore"):
        s = mixed(h)
        for k in range(1, size):
            ahead = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
            s = mixed(s * _C1 + np.where(left > k, ahead, np.uint64(0)))
        short = (n > 0) & (n < size)
        at = offsets[:-1][short]
        s[at] = mixed(s[at] ^ (_C3 + n[short].astype(np.uint64)))
    whole = left >= size
    whole[at] = True
    return s[whole], doc[whole]


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the texts' shingles, one text after the other, and how many each has."""
    s, doc = shingles(texts, size)
    # By hash, then by text, whose few numbers a stable sort deals out.
    order = np.argsort(s)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[first], np.bincount(doc[first], minlength=len(texts))


# Hot shingles


def slots(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ _C1) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, counts), counts as int64 in binary, added up by keys as they stream by."""
    schema = ", ".join([*(f"{k} int" for k in keys), "counts binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(BLOCK, np.int64)
        made = lambda: pa.RecordBatch.from_arrays(
            [*(pa.array([k], pa.int32()) for k in current), pa.array([total.tobytes()], pa.binary())], names=[*keys, "counts"]
        )
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if current is not None:
                        yield made()
                    current, total = key, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(data, np.int64)
        if current is not None:
            yield made()

    return rows.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def hot_slots(base: DataFrame, size: int) -> np.ndarray:
    """Which slots are hot, as packed bits: 2 ** SLOT_BITS of them, whatever the number of documents.

    Shingles of all documents are counted, repeated ones too. What is hot decides only by which shingles documents meet,
    not which ones link.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stream = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for _, texts in portions(batch.column(0), TEXTS, TEXT_BYTES):
                found = shingles(texts, size)[0]
                stream = (stream * 31 + len(found)) % STREAMS
                total += np.bincount(slots(found), minlength=1 << SLOT_BITS)
        for block, counts in enumerate(total.reshape(-1, BLOCK)):
            if counts.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([stream], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["block", "stream", "counts"]
                )

    rows = _added(_added(base.select("text").mapInArrow(counted, "block int, stream int, counts binary"), "block", "stream"), "block")
    total = np.zeros((1 << SLOT_BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for row in written(rows, "slots").collect():
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.packbits(total.ravel() > max(HOT_LEAST, total.mean() + HOT * math.sqrt(total.mean())))


# Shells and cells


@lru_cache(maxsize=4)
def shells(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each shell: its smallest size, the largest size in its window, K and the number of parts."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * SHELL_RATIO)))
    low = np.array(lows, np.int64)
    top = low[1:] - 1
    window = 100 * top // percent
    # |A| + |B| = s and 100 * common >= percent * union leave a difference of at most s * (100 - percent) / (100 + percent).
    differ = (top + window) * (100 - percent) // (100 + percent)
    return low, window, differ, np.where(differ > 0, np.ceil((differ + 1) * PARTS), 1).astype(np.int64)


def _cells(sets: np.ndarray, lengths: np.ndarray, shell: np.ndarray, hot: np.ndarray, percent: int, deal: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, cell) of sets that lie one after the other, each dealt into the parts of its shell.

    Linked sets agree on m - K parts. If a set has fewer empty ones, one of those has shingles, and lies among its first
    K + 1 full parts if that holds for both: then K + 1 cells do. A set with more empty parts gets cells for all full ones
    and is dealt out anew. The first deal leaves hot shingles out.
    """
    differ, m = (x[shell] for x in shells(percent)[2:])
    prefix = mixed(shell.astype(np.uint64) * np.uint64(DEALS + 1) + np.uint64(deal) + _C1)
    if deal == DEALS or not len(shell):
        return np.arange(len(shell)), prefix
    entry, dealt = np.repeat(np.arange(len(lengths)), lengths), sets
    if not deal:
        cold = ~hot[slots(sets)]
        entry, dealt = entry[cold], sets[cold]
    offset = np.concatenate([[0], np.cumsum(m)])
    total = int(offset[-1])
    with np.errstate(over="ignore"):
        value = mixed(dealt + np.uint64(deal + 1) * _C3)
        place = (mixed(value) >> np.uint64(20)).astype(np.int64) % m[entry] + offset[entry]
        full = np.bincount(place, minlength=total) > 0
        content = np.zeros(total, np.uint64)
        for k in range(4):
            piece = ((value >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64)
            content += np.bincount(place, piece, total).astype(np.uint64) << np.uint64(16 * k)
        owner = np.repeat(np.arange(len(m)), m)
        part = (np.arange(total) - offset[owner]).astype(np.uint64)
        key = mixed(mixed(prefix[owner] + (part + np.uint64(1)) * _C2) ^ mixed(content))
    good = np.add.reduceat(full.astype(np.int64), offset[:-1]) > differ
    upto = np.cumsum(full)
    nth = upto - np.repeat(upto[offset[:-1]] - full[offset[:-1]], m)
    taken = full & (~good[owner] | (nth <= differ[owner] + 1))
    found = [(owner[taken], key[taken])]
    bad = np.flatnonzero(~good)
    if len(bad):
        starts = np.cumsum(lengths) - lengths
        e, c = _cells(sets[ranges(starts[bad], lengths[bad])], lengths[bad], shell[bad], hot, percent, deal + 1)
        found.append((bad[e], c))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def cells_of(sets: np.ndarray, lengths: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, cell) for each cell of each set that isn't empty: of its own shell, and of the one below if in its window."""
    low, window = shells(percent)[:2]
    owner = np.flatnonzero(lengths)
    shell = np.searchsorted(low, lengths[owner], side="right") - 1
    entries, shells_of = [owner], [shell]
    while True:
        lower = shells_of[-1] - 1
        below = (lower >= 0) & (lengths[entries[-1]] <= window[np.maximum(lower, 0)])
        if not below.any():
            break
        entries.append(entries[-1][below])
        shells_of.append(lower[below])
    entry, shell = np.concatenate(entries), np.concatenate(shells_of)
    starts = np.cumsum(lengths) - lengths
    e, cell = _cells(sets[ranges(starts[entry], lengths[entry])], lengths[entry], shell, hot, percent, 0)
    return entry[e], cell


def _list(values: np.ndarray, lengths: np.ndarray, kind=np.int64) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values.view(kind)))


def _documents(hot: np.ndarray, size: int, percent: int):
    """(id, n_shingles, rep, cells): rep is the first id that the task met with an equal set; only that one has cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        is_hot = np.unpackbits(hot).astype(bool)
        for batch in batches:
            for start, texts in portions(batch.column(1), TEXTS, TEXT_BYTES):
                ids = batch.column(0).slice(start, len(texts)).to_pylist()
                sets, n = shingle_sets(texts, size)
                ends = np.concatenate([[0], np.cumsum(n)])
                with np.errstate(over="ignore"):
                    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets + _C3), dtype=np.uint64)])
                    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ _C2), dtype=np.uint64)])
                    keys = zip(n.tolist(), (one[ends[1:]] - one[ends[:-1]]).tolist(), (two[ends[1:]] - two[ends[:-1]]).tolist(), strict=True)
                if len(seen) > REMEMBERED:
                    seen.clear()
                reps, own = [], np.zeros(len(n), bool)
                for k, (i, key) in enumerate(zip(ids, keys, strict=True)):
                    if i is None or not key[0]:
                        reps.append(i)
                        continue
                    rep = seen.setdefault(key, i)
                    own[k] = rep == i
                    reps.append(rep)
                lengths = np.where(own, n, 0)
                entry, cell = cells_of(sets[np.repeat(own, n)], lengths, is_hot, percent)
                order = np.argsort(entry, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(reps, pa.int64()), _list(cell[order], np.bincount(entry, minlength=len(n)))],
                    names=["id", "n_shingles", "rep", "cells"],
                )

    return run


# Components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): root is the smallest node that is connected.

    Each step links all neighbours of a node to the smallest of them, first the larger ones, then the smaller ones. Both
    are a grouped minimum and a join, whose skewed keys Spark can split; steps are about the logarithm of the longest
    path.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        across = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        new = least.select("a", F.col("m").alias("b"), F.lit(False).alias("moved")).unionByName(across)
        new = written(new.groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        # Stars: every node has one link, and no smallest node is itself linked to a smaller one.
        edges = new.select("a", "b")
        if not new.where("moved").head(1) and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# Joins within a task


class _Sets:
    """Sets of one region: their hashes replaced by numbers, those that only one set has left out but counted."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[number] > 1
        again = np.cumsum(times > 1) - 1
        self.number, owner = again[number[shared]], owner[shared]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        self.universe = int((times > 1).sum())

    def common(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, some rows and columns at a time: by the shingles that they share, or, if that is
        cheaper, by products of 0/1 matrices over slices of the universe."""
        if len(rows) > COMPARED:
            return np.concatenate([self.common(rows[k : k + COMPARED], columns) for k in range(0, len(rows), COMPARED)])
        if len(columns) > COMPARED:
            return np.concatenate([self.common(rows, columns[k : k + COMPARED]) for k in range(0, len(columns), COMPARED)], axis=1)
        parts = [self._matrix_entries(rows), self._matrix_entries(columns)]
        (row, number), (column, of_column) = parts
        times = np.bincount(of_column, minlength=self.universe)
        met = times[number]
        if SPARSE * met.sum() < len(rows) * len(columns) * self.universe:
            # Each shingle of a row meets the columns that have it.
            at = column[np.argsort(of_column, kind="stable")]
            first = np.cumsum(times) - times
            total = np.zeros(len(rows) * len(columns), np.int64)
            upto = np.cumsum(met)
            cuts = np.searchsorted(upto, np.arange(MET, upto[-1] if len(upto) else 0, MET), side="right")
            for some in np.split(np.arange(len(met)), cuts):
                pair = np.repeat(row[some] * len(columns), met[some]) + at[ranges(first[number[some]], met[some])]
                total += np.bincount(pair, minlength=len(total))
            return total.reshape(len(rows), len(columns))
        total = np.zeros((len(rows), len(columns)), np.float64)
        step = 8192
        for low in range(0, self.universe, step):
            made = []
            for (who, number), count in zip(parts, (len(rows), len(columns)), strict=True):
                inside = (number >= low) & (number < low + step)
                matrix = np.zeros((count, min(step, self.universe - low)), np.float32)
                matrix[who[inside], number[inside] - low] = 1
                made.append(matrix)
            total += made[0] @ made[1].T
        return np.rint(total).astype(np.int64)

    def _matrix_entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.ends[which + 1] - self.ends[which]
        return np.repeat(np.arange(len(which)), lengths), self.number[ranges(self.ends[which], lengths)]

    def linked_and_distance(self, rows: np.ndarray, columns: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        inter = self.common(rows, columns)
        union = self.size[rows][:, None] + self.size[columns][None, :] - inter
        return 100 * inter >= percent * union, 1 - inter / np.maximum(union, 1)


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self, which: np.ndarray) -> np.ndarray:
        found = self.parent[which]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of rows to columns as (row, its first column) and (column, column): those that connect the same, of which
    there are no more than rows and pairs of columns."""
    some = np.flatnonzero(linked.any(axis=1))
    first = linked[some].argmax(axis=1)
    row, column = np.nonzero(linked[some])
    pairs = np.unique(first[row] * linked.shape[1] + column) if len(row) else np.empty(0, np.int64)
    return some, first, pairs // max(linked.shape[1], 1), pairs % max(linked.shape[1], 1)


def voronoi(distance: np.ndarray, radius: float) -> np.ndarray:
    """Which cells a document goes to: its nearest pivot's, and those within the window of the triangle inequality.

    If d(x, y) <= radius and p is nearest to x, q to y, then d(y, p) <= d(x, p) + radius <= d(x, q) + radius <=
    d(y, q) + 2 * radius: y is replicated into the cell of p.
    """
    return distance <= distance.min(axis=1, keepdims=True) + 2 * radius + 1e-9


def join_region(sets: _Sets, which: np.ndarray, found: _Union, percent: int) -> None:
    """Recursively, by a stack: pivots, links with them, Voronoi cells of the others with their windows.

    A cell is done when links connect all of it, or one set is left. Its pivots aren't among the sets that most others
    of the cell are connected with. Cells that would leave too many pairs are given up for the whole without its pivots.
    """
    cells = [which]
    while cells:
        cell = cells.pop()
        names, number, counts = np.unique(found.roots(cell), return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        others = cell[number != counts.argmax()]
        count = min(len(others), max(1, math.isqrt(len(cell))))
        pivots = others[np.linspace(0, len(others) - 1, count).astype(int)]
        linked, distance = sets.linked_and_distance(cell, pivots, percent)
        row, first, a, b = stars(linked)
        for x, y in [*zip(cell[row], pivots[first], strict=True), *zip(pivots[a], pivots[b], strict=True)]:
            found.join(x, y)
        left = ~np.isin(cell, pivots)
        rest = cell[left]
        inside = np.unique(voronoi(distance[left], 1 - percent / 100).T, axis=0) if len(rest) else np.ones((0, 0), bool)
        if (inside.sum(axis=1, dtype=float) ** 2).sum() > PARTED * len(rest) ** 2:
            inside = np.ones((1, len(rest)), bool)
        cells += [rest[x] for x in inside]


def _regions(percent: int):
    """Rows (region, id, label, set) come sorted by region; out go (a, b): an id and the smallest one it is linked with.

    Sets of one label are known to be connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        current = None
        made: list[tuple[int, int]] = []

        def solve() -> None:
            if len(held) < 2:
                return
            sets, found = _Sets([s for *_, s in held]), _Union(len(held))
            at: dict[int, int] = {}
            for k, (_, label, _) in enumerate(held):
                found.join(k, at.setdefault(label, k))
            join_region(sets, np.arange(len(held)), found, percent)
            least: dict[int, int] = {}
            roots = found.roots(np.arange(len(held))).tolist()
            for (i, *_), r in zip(held, roots, strict=True):
                least[r] = min(i, least.get(r, i))
            made.extend((i, least[r]) for (i, *_), r in zip(held, roots, strict=True) if i != least[r])

        def out() -> pa.RecordBatch:
            pairs = np.array(made, np.int64).reshape(-1, 2)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            for region, i, label, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if region != current:
                    solve()
                    held, current = [], region
                held.append((i, label, np.frombuffer(data, "<u8")))
            yield out()
        solve()
        yield out()

    return run


def _sets_of(size: int):
    """(id, region, text) to (region, id, set, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column(2), TEXTS, TEXT_BYTES):
                sets, n = shingle_sets(texts, size)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * 8
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(sets.astype("<u8"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(start, len(n)), batch.column(0).slice(start, len(n)), data.cast(pa.binary()), pa.array(n, pa.int64())],
                    names=["region", "id", "set", "n"],
                )

    return run


# Joins as Spark jobs


def _to_pivots(percent: int):
    """Rows (region, deal, role, id, set) come sorted, pivots (role 0: with a Voronoi cell, 1: without) before members
    (role 2; 3: pivots as members). Out go rows (region, id, pivot, linked): links that connect all that are linked, and
    one for each Voronoi cell of a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivots, members, held = None, [], [], 0

        def compared() -> pa.RecordBatch:
            both, k = _Sets([np.frombuffer(x["set"], "<u8") for x in [*pivots, *members]]), len(pivots)
            linked, distance = both.linked_and_distance(np.arange(k, k + len(members)), np.arange(k), percent)
            row, first, a, b = stars(linked)
            centre = np.array([p["role"] == 0 for p in pivots])
            inside = np.zeros(linked.shape, bool)
            if centre.any():
                inside[:, centre] = voronoi(distance[:, centre], 1 - percent / 100)
            inside[[m["role"] == 3 for m in members]] = False
            at, cell = np.nonzero(inside)
            ids, own = np.array([p["id"] for p in pivots], np.int64), np.array([m["id"] for m in members], np.int64)
            left, right = np.concatenate([own[row], ids[a], own[at]]), np.concatenate([ids[first], ids[b], ids[cell]])
            is_link = np.arange(len(left)) < len(row) + len(a)
            keep = (left != right) | ~is_link
            columns = [pa.array(np.full(keep.sum(), current[0])), pa.array(left[keep]), pa.array(right[keep]), pa.array(is_link[keep])]
            members.clear()
            return pa.RecordBatch.from_arrays(columns, names=["region", "id", "pivot", "linked"])

        for batch in batches:
            for start in range(0, batch.num_rows, COMPARED):
                for row in batch.slice(start, COMPARED).to_pylist():
                    if (row["region"], row["deal"]) != current:
                        if members and pivots:
                            yield compared()
                        current, pivots, members, held = (row["region"], row["deal"]), [], [], 0
                    if row["role"] < 2:
                        pivots.append(row)
                        continue
                    members.append(row)
                    held += len(row["set"])
                    if len(members) >= max(COMPARED, len(pivots)) or held > 8 * REGION_SHINGLES:
                        yield compared()
                        held = 0
        if members and pivots:
            yield compared()

    return run


SETS = "region bigint, id bigint, set binary, n bigint"


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    rows = sets.select("region", "id", "label", "set").repartition("region").sortWithinPartitions("region")
    return rows.mapInArrow(_regions(percent), "a bigint, b bigint")


def _chance(round_: int, *cols: str):
    return F.pmod(F.xxhash64(*cols, F.lit(round_)), F.lit(1 << 30)) / (1 << 30)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links within the regions of sets.

    Regions that fit a task are joined there. The others take pivots round by round, from the sets that aren't connected
    with most of their region, until all of a region is connected, its cells fit tasks or all of these were pivots.
    """
    sizes = sets.groupBy("region").agg(F.count(F.lit(1)).alias("sets_in"), F.sum("n").alias("shingles_in"))
    fit = (F.col("sets_in") <= REGION_SETS) & (F.col("shingles_in") <= REGION_SHINGLES)
    large = written(sizes.where(~fit).select("region"), "large")
    found = [_joined(sets.join(small(large), "region", "left_anti").withColumn("label", F.col("id")), percent)]
    if not large.head(1):
        return found[0]
    contents = written(sets.join(small(large), "region", "left_semi").select("region", "id", "n", "set"), "contents")
    cells, known, pivots = contents.dropDuplicates(["region", "id"]).select("region", "id", "n", F.col("id").alias("label")), [], PIVOTS
    contents = contents.select("id", "set")
    for round_ in range(1, 1 << 30):
        labels = cells.groupBy("region", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        state = labels.groupBy("region").agg(
            F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"),
            F.sum("c").alias("sets_in"), F.sum("s").alias("shingles_in"), (F.sum("c") - F.max("c")).alias("others"),
        )
        state = written(state.where("labels > 1"), f"state-{round_}")
        if not state.head(1):
            break
        members = cells.join(small(state), "region")
        found.append(_joined(members.where(fit).join(contents, "id"), percent))
        # Members are dealt out, whatever the size of their region; its pivots go along with each deal.
        deals = F.ceil(F.col("sets_in") / max(DEALT, pivots)).cast("int")
        wanted = F.least(F.lit(float(pivots)), F.col("sets_in") * REGION_SHINGLES / F.col("shingles_in") + 4)
        pivot = (F.col("label") != F.col("main")) & (_chance(round_, "region", "id") < wanted / F.col("others"))
        centre = _chance(-round_, "region", "id") < F.lit(float(CENTRES)) / F.least(F.col("others"), wanted)
        members = members.where(~fit).withColumns({"deals": deals, "pivot": pivot, "centre": centre})
        members = written(members.select("region", "id", "n", "sets_in", "deals", "pivot", "centre"), f"members-{round_}")
        if not members.head(1):
            break
        deal = F.pmod(F.xxhash64("id", F.lit("deal")), F.col("deals")).cast("int")
        rows = members.select("region", deal.alias("deal"), F.when(F.col("pivot"), 3).otherwise(2).alias("role"), "id")
        each = F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")
        rows = rows.unionByName(members.where("pivot").select("region", each, F.when(F.col("centre"), 0).otherwise(1).alias("role"), "id"))
        rows = rows.join(contents, "id").select("region", "deal", "role", "id", "set")
        near = rows.repartition("region", "deal").sortWithinPartitions("region", "deal", "role").mapInArrow(_to_pivots(percent), "region bigint, id bigint, pivot bigint, linked boolean")
        near = written(near, f"near-{round_}")
        known.append(near.where("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        found.append(known[-1])
        inside = near.where("not linked").groupBy("region", "pivot").agg(F.count(F.lit(1)).cast("double").alias("c"))
        pairs = inside.groupBy("region").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        regions = members.groupBy("region").agg(F.first("sets_in").alias("sets_in"))
        parted = pairs.join(regions, "region").where(F.col("pairs") <= PARTED * F.col("sets_in") * F.col("sets_in"))
        parted = written(parted.select("region"), "parted")
        left = members.where("not pivot").select("region", "id", "n")
        into = near.where("not linked").join(small(parted), "region", "left_semi").join(left, ["region", "id"])
        into = into.select(F.xxhash64("region", "pivot", F.lit(round_)).alias("region"), "id", "n")
        cells = into.unionByName(left.join(small(parted), "region", "left_anti")).dropDuplicates(["region", "id"])
        roots = components(_union(known))
        cells = cells.join(roots, cells["id"] == roots["node"], "left").select("region", "id", "n", F.coalesce("root", "id").alias("label"))
        cells, pivots = written(cells, f"cells-{round_}"), min(2 * pivots, MOST_PIVOTS)
    return _union(found)


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a row of docs: id, n_shingles, component_id (the smallest id that links reach).

    A document is the set of the shingles, of that many words, of its whole text, however long, with A-Z in lower case;
    fewer words are one shingle as a whole. Two link if 100 * intersection >= percent * union. Null and empty texts, and
    those of white space, have no shingles and link with nothing. The id column is an integer; a row with a null id links
    with nothing and has a null component_id. Rows that repeat an id share its component. Shingles are compared by 64-bit
    hashes. Other columns of docs play no part; an empty table gives an empty result.
    """
    if not 0 < percent <= 100 or shingle < 1:
        raise ValueError("percent is above 0 and at most 100, a shingle has a word at least")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, n_shingles bigint, rep bigint, cells array<bigint>"
    known = written(base.mapInArrow(_documents(hot_slots(base, shingle), shingle, percent), schema), "shingles")
    cells = known.where(F.size("cells") > 0).select("id", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    shared = written(shared.select("cell", "least"), "cells")
    together = cells.join(shared, "cell").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    regions = written(components(together).withColumnRenamed("root", "region"), "regions")
    members = base.join(small(regions.withColumnRenamed("node", "id")), "id").select("id", "region", "text")
    sets = written(members.mapInArrow(_sets_of(shingle), SETS), "sets")
    copies = known.where("rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(sets, percent).unionByName(copies))
    return known.join(roots, known["id"] == roots["node"], "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id")
    )
