"""Operator 2: exact deduplication through counting quotient filters.

Every partition puts the 64-bit fingerprints of its texts into a counting quotient filter: the high bits (the
quotient) name a block and a slot within it, the low bits (the remainder) are stored in sorted runs with a count.
Filters merge without loss, as the quotient and the remainder together are the whole fingerprint: blocks of the same
number meet, and equal remainders of a slot add their counts. Fingerprints whose count is one are proven unique. The
others are candidates, whose texts are compared byte for byte by grouping on the text itself, which Spark
pre-aggregates before the shuffle, so a group of copies costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small, written

BLOCK_BITS = 14
SLOT_BITS = 8
REMAINDER_BITS = 64 - BLOCK_BITS - SLOT_BITS
#: Fingerprints that a task holds before it emits a filter.
FILTER_ROWS = 4_000_000

FILTER_SCHEMA = "block int, occupied binary, run_lengths array<int>, remainders array<bigint>, counts array<bigint>"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def filter_blocks(fingerprints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A counting quotient filter over distinct sorted uint64 fingerprints, one row a block that isn't empty."""
    quotient = (fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.int64)
    remainder = (fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.int64)
    run_start = np.flatnonzero(np.diff(quotient, prepend=-1))
    run_quotient = quotient[run_start]
    run_length = np.diff(np.append(run_start, len(quotient))).astype(np.int32)
    run_block = run_quotient >> SLOT_BITS
    first_run = np.flatnonzero(np.diff(run_block, prepend=-1))
    blocks = run_block[first_run]
    occupied = np.zeros((len(blocks), 1 << SLOT_BITS), np.uint8)
    row = np.repeat(np.arange(len(blocks)), np.diff(np.append(first_run, len(run_block))))
    occupied[row, run_quotient & ((1 << SLOT_BITS) - 1)] = 1
    bitmaps = np.packbits(occupied, axis=1)
    run_offsets = np.append(first_run, len(run_block)).astype(np.int32)
    slot_offsets = np.append(run_start[first_run], len(quotient)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(blocks.astype(np.int32)),
            pa.array([b.tobytes() for b in bitmaps], pa.binary()),
            pa.ListArray.from_arrays(run_offsets, pa.array(run_length)),
            pa.ListArray.from_arrays(slot_offsets, pa.array(remainder)),
            pa.ListArray.from_arrays(slot_offsets, pa.array(counts.astype(np.int64))),
        ],
        names=["block", "occupied", "run_lengths", "remainders", "counts"],
    )


def filter_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that the blocks of a batch hold, block after block."""
    bits = np.frombuffer(b"".join(batch.column("occupied").to_pylist()), np.uint8)
    occupied = np.unpackbits(bits.reshape(batch.num_rows, -1), axis=1)
    row, slot = np.nonzero(occupied)
    block = batch.column("block").to_numpy(zero_copy_only=False).astype(np.uint64)
    quotient = (block[row] << np.uint64(SLOT_BITS)) | slot.astype(np.uint64)
    runs = batch.column("run_lengths").flatten().to_numpy(zero_copy_only=False)
    remainder = batch.column("remainders").flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
    return (np.repeat(quotient, runs) << np.uint64(REMAINDER_BITS)) | remainder, counts


def _added(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
    return fingerprints[start], np.add.reduceat(counts, start)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        rows += batch.num_rows
        if rows >= FILTER_ROWS:
            yield filter_blocks(*np.unique(np.concatenate(held), return_counts=True))
            held, rows = [], 0
    if rows:
        yield filter_blocks(*np.unique(np.concatenate(held), return_counts=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive in order; what belongs to the last one waits, as its next row may come with the next batch."""
    waiting = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def repeated(entries: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        many = entries[1] > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(entries[0][many].view(np.int64)), pa.array(entries[1][many])], names=["fingerprint", "copies"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        new = filter_entries(batch)
        fingerprints, counts = _added(*(np.concatenate(x) for x in zip(waiting, new, strict=True)))
        block = fingerprints >> np.uint64(64 - BLOCK_BITS)
        done = np.searchsorted(block, block[-1])
        yield repeated((fingerprints[:done], counts[:done]))
        waiting = fingerprints[done:], counts[done:]
    yield repeated(waiting)


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, copies) of the values of a bigint column that occur more than once."""
    filters = fingerprints.mapInArrow(_build, FILTER_SCHEMA)
    return (
        filters.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "fingerprint bigint, copies bigint")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once each run of white space is one space (nothing is trimmed). A null text
    is the empty text, and all empty texts are one group. The row with the smallest id stays; a row with a null id
    stays only if its whole group has none. group_size counts rows. Rows that repeat an id and a text are alike in the
    result: if that id is the smallest, all of them are kept. Other columns of docs play no part. An empty table gives
    an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn(
        "fingerprint", F.xxhash64("text")
    )
    digests = written(base.select("id", "fingerprint", F.sha2("text", 256).alias("text_sha256")), "digests")
    candidates = written(repeated_fingerprints(digests.select("fingerprint")).select("fingerprint"), "repeated")
    groups = (
        base.join(small(candidates), "fingerprint", "left_semi")
        .groupBy("fingerprint", "text")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    size = F.coalesce("group_size", F.lit(1).cast("bigint"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return digests.join(groups, "text_sha256", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
