"""Operator 13: spelling variants of the words of a corpus, by blocked Gram matrices.

One edit changes the counts of at most two letters: a replacement leaves letter-count vectors at a squared distance of two
at the same length, an insertion or deletion at one with a length more. The letters are dealt into four groups, so words
one edit apart agree on all letters of at least two groups: every word stands in six blocks, one for each two groups and
their counts. Within a block, tiles of words in order of length are multiplied with those of the same and the next length;
the products give all squared distances, and pairs of one or two are verified as edits. A pair counts in the first block
that it shares only. Blocks beyond a size are dealt into parts, and every two parts are a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

MIN_LENGTH, MIN_OCCURRENCES = 7, 2
#: The run of every DELETE_EVERY-th crc32 loses a letter.
DELETE_EVERY = 31
#: A near word is a word's form if it occurs so many times as often.
FORM_RATIO = 10
#: Letters are a to z and U+00C0 to U+00FF; runs hold A to Z too.
LETTERS = 26 + 64
RUN = rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"
GROUPS = 4
#: Two groups that words agree on, in the order in which a pair's first block is looked for.
AGREED = list(combinations(range(GROUPS), 2))
#: Rows of one Gram matrix, and rows of a block that stay together.
TILE, BLOCK_ROWS = 256, 16_384
#: Words shorter than that are verified as rows of a matrix, longer ones one by one.
MATRIX_LENGTH = 48
#: Letters at both ends of a word, of which one edit leaves those of one end.
END = MIN_LENGTH // 2
#: Rows a task compares, about.
TASK_ROWS = 150_000

ROWS = "agreed int, key bigint, length int, word string, n bigint"


def spelt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, some with a letter less, that are long enough and occur often enough."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    # lower() would change letters beyond A to Z too.
    ascii_only = F.length("run") == F.octet_length("run")
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hashed = runs.select(lower.alias("run"), F.crc32(F.concat("id", F.lit(":"), lower)).alias("h"))
    at: Column = F.expr("CAST(h % length(run) AS INT)")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_OCCURRENCES)


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of letter counts a word, and the lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(points < 128, points - 97, points - 0xC0 + 26)
    at = np.repeat(np.arange(len(words)), lengths) * LETTERS + letter
    return np.bincount(at, minlength=len(words) * LETTERS).reshape(len(words), LETTERS), lengths


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter: letters in order of how often they stand in words, dealt back and forth."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += letter_counts(batch.column(0).to_pylist())[0].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS)), pa.array(total)], names=["letter", "n"])

    total = np.zeros(LETTERS, np.int64)
    for row in words.select("word").mapInArrow(count, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect():  # 90 rows
        total[row["letter"]] = row["n"]
    deal = np.concatenate([np.arange(GROUPS), np.arange(GROUPS)[::-1]])
    group = np.empty(LETTERS, np.int64)
    group[np.argsort(-total, kind="stable")] = deal[np.arange(LETTERS) % len(deal)]
    return group


def letter_weights() -> np.ndarray:
    """A fixed random number for each letter; no two are equal."""
    return np.random.default_rng(13).integers(0, 1 << 63, LETTERS, dtype=np.uint64)


def _block_rows(batches: Iterator[pa.RecordBatch], group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every word in its six blocks. A block's key is a sum of fixed random numbers; equal keys of unlike counts do no harm."""
    masked = np.stack([np.where(np.isin(group, two), letter_weights(), 0).astype(np.uint64) for two in AGREED], axis=1)
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            part = batch.slice(start, 10_000)
            counts, lengths = letter_counts(part.column(0).to_pylist())
            keys = np.ascontiguousarray((counts.astype(np.uint64) @ masked).T).view(np.int64)
            for k, key in enumerate(keys):
                columns = [pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(lengths.astype(np.int32)), part.column(0), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced character; b is as long as a, or longer by one."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return a[k:] == b[k + 1 :]


def one_edit_rows(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """one_edit() for rows of code points, filled up with zeros; longer tells where b has one more."""
    unlike = a != b
    made = unlike.sum(axis=1) == 1
    if longer.any():
        a, b, unlike = a[longer], b[longer], unlike[longer]
        shifted = a != np.pad(b[:, 1:], ((0, 0), (0, 1)))
        width = a.shape[1]
        last = np.where(shifted.any(axis=1), width - 1 - np.argmax(shifted[:, ::-1], axis=1), -1)
        made[longer] = last < np.argmax(unlike, axis=1)
    return made


class Tile:
    """Rows of the sorted blocks, with letter counts, their squared norms, and a number for what each group of letters holds."""

    def __init__(self, part: pa.RecordBatch, weights: np.ndarray, before: Tile | None):
        column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        self.words, self.n = part.column(3).to_pylist(), column(4)
        self.agreed, self.low, self.high, self.deal = column(0), column(5), column(6), column(7)
        key = np.stack([self.agreed.astype(np.int64), column(1), self.low.astype(np.int64), self.high.astype(np.int64)], axis=1)
        self.last_key = key[-1].tolist()
        new = np.append(before is None or before.last_key != key[0].tolist(), (key[1:] != key[:-1]).any(axis=1))
        self.block = np.cumsum(new) + (before.block[-1] if before else 0)
        counts, self.length = letter_counts(self.words)
        self.held = counts.astype(np.uint64) @ weights
        # Exact: products stay below 2^24 for floats of 32 bits, below 2^53 for those of 64.
        counts = counts.astype(np.float32 if self.length.max() < 1024 else np.float64)
        # Blocks are one more coordinate, so that rows of unlike ones are at a squared distance of four and more.
        vectors = np.column_stack([counts, 2 * (self.block - self.block[0]).astype(counts.dtype)])
        one, norms, plain = np.ones((len(counts), 1), counts.dtype), (vectors**2).sum(axis=1, keepdims=True), (counts**2).sum(axis=1, keepdims=True)
        #: The product of a row of the first and one of the second is their squared distance; with blocks, and without.
        self.gram = np.hstack([vectors, norms, one]), np.hstack([-2 * vectors, one, norms])
        self.plain_gram = np.hstack([counts, plain, one]), np.hstack([-2 * counts, one, plain])
        points = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8)
        ends = np.cumsum(self.length)
        spelt = lambda at: sum(points[at + k].astype(np.int64) << (8 * k) for k in range(END))
        self.head, self.tail = spelt(ends - self.length), spelt(ends - END)
        self.points = None
        if self.length.max() < MATRIX_LENGTH:
            self.points = np.zeros((len(self.words), MATRIX_LENGTH), np.uint8)
            at = np.arange(len(points)) - np.repeat(ends - self.length, self.length)
            self.points[np.repeat(np.arange(len(self.words)), self.length), at] = points


def _near(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a and of b that are words one edit apart, each pair in the first block and the part that it counts in."""
    if a is b:
        distance, start = a.gram[0] @ a.gram[1].T, 0
        close = np.triu(distance < 2.5, 1)
    else:
        # Of a what stands in the first block of b at its first length or the one before, of b that block.
        start = max(np.searchsorted(a.block, b.block[0]), np.searchsorted(np.where(a.block == b.block[0], a.length, -1), b.length[0] - 1))
        distance = a.plain_gram[0][start:] @ b.plain_gram[1][: np.searchsorted(b.block, b.block[0], side="right")].T
        close = distance < 2.5
    found = np.flatnonzero(close)
    at = distance.ravel()[found]
    i, j = np.divmod(found[at > 0.5], distance.shape[1])
    i, at = i + start, at[at > 0.5]
    # An edit leaves the first letters or the last ones as they are.
    some = (a.head[i] == b.head[j]) | (a.tail[i] == b.tail[j])
    i, j, at = i[some], j[some], at[some]
    # At a squared distance of 1 the lengths differ by one, at 2 by none, or by two. Rows of a block are in order of length.
    more = b.length[j] - a.length[i]
    right = more == (at < 1.5)
    # Parts of a divided block: the pair counts where both are at home.
    low, high = np.minimum(a.deal[i], b.deal[j]), np.maximum(a.deal[i], b.deal[j])
    right &= (low == a.low[i]) & (high == a.high[i])
    # Two letters at most differ, so a group's numbers are equal only if its counts are.
    agree = a.held[i] == b.held[j]
    first = np.argmax(np.stack([agree[:, x] & agree[:, y] for x, y in AGREED], axis=1), axis=1) if len(i) else i
    right &= first == a.agreed[i]
    i, j, longer = i[right], j[right], more[right] == 1
    if a.points is not None and b.points is not None:
        width = int(max(a.length.max(), b.length.max())) + 1
        edits = one_edit_rows(a.points[i, :width], b.points[j, :width], longer)
    else:
        edits = np.fromiter((one_edit(a.words[x], b.words[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
    return i[edits], j[edits]


def _compared(batches: Iterator[pa.RecordBatch], group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of near words of rows sorted by block and length: (word, other, other_n), both ways.

    A tile is compared with itself and with those before that hold its first block at its first length, or the one before.
    """
    weights = np.where(group[:, None] == np.arange(GROUPS), letter_weights()[:, None], 0).astype(np.uint64)
    window: list[Tile] = []
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            part = batch.slice(start, TILE)
            tile = Tile(part, weights, window[-1] if window else None)
            window = [t for t in window if t.block[-1] == tile.block[0] and t.length[-1] >= tile.length[0] - 1]
            window.append(tile)
            for other in window:
                i, j = _near(other, tile)
                if len(i):
                    one, two = [other.words[k] for k in i.tolist()], [tile.words[k] for k in j.tolist()]
                    n = np.concatenate([tile.n[j], other.n[i]])
                    yield pa.RecordBatch.from_arrays([pa.array(one + two, pa.string()), pa.array(two + one, pa.string()), pa.array(n, pa.int64())], names=["word", "other", "other_n"])


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, other, other_n): all pairs of words (distinct, with their n) one edit apart, both ways. words is a written table."""
    group = letter_groups(words)
    rows = written(words.select("word", "n").mapInArrow(lambda batches: _block_rows(batches, group), ROWS), "blocks")
    large = rows.groupBy("agreed", "key").count().where(F.col("count") > block_rows)
    large = written(large.select("agreed", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("parts")), "large-blocks")
    n_parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(small(large), ["agreed", "key"], "left").withColumn("deal", F.pmod(F.xxhash64("word"), n_parts).cast("int"))
    # A part of a block of several meets every part, itself too.
    other = F.explode(F.sequence(F.lit(0), n_parts - 1))
    dealt = dealt.withColumn("other", other).withColumn("low", F.least("deal", "other")).withColumn("high", F.greatest("deal", "other"))
    dealt = dealt.select(*[x.split()[0] for x in ROWS.split(", ")], "low", "high", "deal")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(AGREED) * words.count() // TASK_ROWS))
    blocks = dealt.repartition(tasks, "agreed", "key", "low", "high").sortWithinPartitions("agreed", "key", "low", "high", "length")
    return blocks.mapInArrow(lambda batches: _compared(batches, group), "word string, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by doubling. A form occurs FORM_RATIO times as often as its
    word, so a chain has a dozen steps or so, and no circle."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        moved = written(to.join(on, "root", "left").select("word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")), "roots")
        to = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return to


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of all texts, a row a word.

    Runs of letters A to Z, a to z and U+00C0 to U+00FF count with A to Z in lower case, once per occurrence, after the run
    whose crc32 with the id 31 divides has lost a letter; those of at least 7 characters that occur at least twice are words.
    Near words are one inserted, deleted or replaced character apart, n_near of them. form is the near word with the largest
    n (of equal n the smallest by code points) if that is ten times the word's or more, else null; root follows forms to the
    last, and is the word itself without a form. Null texts have no words; a null id is written as nothing; repeated rows
    count again. Texts and words may have any length. Other columns of docs play no part, and an empty table gives no words.
    """
    words = written(spelt_words(docs, id_col, text_col), "words")
    found = near_words(words, block_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other")).alias("best"))
    chosen = F.col("best.minus_n") * -1 >= F.col("n") * FORM_RATIO
    near = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, F.col("best.minus_n") * -1).alias("form_n")
    )
    near = written(near, "near-words")
    return near.join(roots(near.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
