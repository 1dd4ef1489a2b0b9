"""Operator 11: the tokens of two tokenizers aligned over the same bytes, by pointer jumping.

Tokens are spans of bytes. Each points to the token of the other side that covers its last byte, which is the one that
overlaps it and reaches farthest right; a token that no other outreaches points to itself. Doubling the pointers of all
tokens of a portion at once leaves each at the last token of its component: its group. Groups come to products of counts,
so that a long group never becomes all its pairs.

Documents are encoded once, and their distinct links written. How many documents hold a pair is a grouped count. It goes
back to the links by a broadcast join for pairs that many documents hold, which can't be many, and by a shuffle for others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of_symbol
from .common import written
from .pieces import portions, ranges, sums_by_list, tokenizer
from .sentence_pieces import model, piece_ids
from .token_files import token_ids

#: Bytes of text that are aligned at once; a longer text is taken alone.
TEXT_BYTES = 750_000
#: Pairs whose counts are broadcast at most. A pair that more than the HOT_PAIRS-th part of all links hold is among them.
HOT_PAIRS = 400_000
#: An id pair is one integer: the A id times this, and the B id.
SHIFT = 1 << 24

ALIGNED = "row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"


@lru_cache(maxsize=2)
def _plain_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens of a byte-level vocabulary, one after the other, and how many each has."""
    symbols = byte_of_symbol()
    vocabulary = tokenizer(path).get_vocab()
    made = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in symbols for c in token):
            made[i] = bytes(symbols[c] for c in token)
    return np.frombuffer(b"".join(made), np.uint8), np.array([len(b) for b in made], np.int64)


def plain_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (large strings) and their numbers; strings of special tokens are ordinary text."""
    special = pa.array(np.zeros(len(texts), bool))
    for added in tokenizer(path).get_added_tokens_decoder().values():
        special = pc.or_(special, pc.match_substring(texts, added.content))
    ids, n = token_ids(pc.if_else(special, pa.scalar("", pa.large_string()), texts), path, None)
    whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
    if len(whole):
        own = [e.ids for e in _plain_tokenizer(path).encode_batch_fast([texts[k].as_py() for k in whole.tolist()], add_special_tokens=False)]
        ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[whole], [len(x) for x in own]), np.concatenate(own))
        n[whole] = [len(x) for x in own]
    return ids, n


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The B token at which the component of each A token, and of each B token, ends.

    The spans of each side follow one another without a gap over the same bytes.
    """
    n_a = len(ends_a)
    over_a = n_a + np.searchsorted(ends_b, ends_a - 1, side="right")
    over_b = np.searchsorted(ends_a, ends_b - 1, side="right")
    # A token of B that ends where the other side's token ends reaches as far as any.
    over_b = np.where(ends_a[over_b] == ends_b, n_a + np.arange(len(ends_b)), over_b) if len(ends_b) else over_b
    to = np.concatenate([over_a, over_b])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n_a] - n_a, to[n_a:] - n_a
        to = farther


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), in order, and how often each occurs."""
    key, n = np.unique(group * SHIFT + ids, return_counts=True)
    return key // SHIFT, key % SHIFT, n


def group_links(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc_of_group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (document, pair), in order, and the number of its links: products of the counts within each group."""
    ga, ia, na = _counted(group_a, a)
    gb, ib, nb = _counted(group_b, b)
    first, last = np.searchsorted(gb, ga, side="left"), np.searchsorted(gb, ga, side="right")
    width = last - first
    other = ranges(first, width)
    pair = np.repeat(ia, width) * SHIFT + ib[other]
    n = np.repeat(na, width) * nb[other]
    doc = doc_of_group[np.repeat(ga, width)]
    # Ids of both sides are below 2^20, documents of a portion below 2^19.
    key = (doc << 44) | pair
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[new] >> 44, key[new] & ((1 << 44) - 1), np.add.reduceat(n, new) if len(new) else n


@lru_cache(maxsize=2)
def _spelt(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every id as decimal digits with a place for a mark after it: bytes, where each starts and how long it is."""
    made = [b"%d " % i for i in range(size)]
    lengths = np.array([len(m) for m in made], np.int64)
    return np.frombuffer(b"".join(made), np.uint8), np.cumsum(lengths) - lengths, lengths


def group_digests(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc_of_group: np.ndarray, docs: int) -> list[str]:
    """sha256 of `a1,a2|b1;a3|b2,b3` for each document; empty for one without tokens."""
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
    flat, starts, lengths = _spelt(int(ids.max()) + 1 if len(ids) else 1)
    n = lengths[ids]
    text = flat[ranges(starts[ids], n)]
    ends = np.cumsum(n)
    if len(ids):
        last = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True)
        text[ends - 1] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    upto = np.concatenate([[0], ends])
    bounds = upto[np.searchsorted(doc_of_group[group] if len(ids) else group, np.arange(docs + 1))].tolist()
    view = memoryview(text)
    return [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def aligned(texts: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], tuple[np.ndarray, ...]]:
    """Per text n_a, n_b, n_groups, n_links and the digest; and the distinct links of all: text, pair, number."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    given = pc.greater(pc.binary_length(texts), 0)
    marked = pc.if_else(given, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
    a, n_a = plain_ids(marked, path_a)
    b, n_b = piece_ids(texts, path_b)
    known = model(path_b)
    flat_a, size_a = token_bytes(path_a)
    flat_b, size_b = np.frombuffer(b"".join(known.bytes), np.uint8), known.lengths
    # Texts whose tokens don't spell them, by length and then by bytes, have none.
    spelt = []
    for flat, size, ids, n in ((flat_a, size_a, a, n_a), (flat_b, size_b, b, n_b)):
        upto = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
        spelt.append((memoryview(flat[ranges((np.cumsum(size) - size)[ids], size[ids])]), upto))
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1].tolist()
    data = memoryview(np.frombuffer(marked.buffers()[2] or b"", np.uint8))
    right = np.array(
        [all(view[u[k] : u[k + 1]] == data[offsets[k] : offsets[k + 1]] for view, u in spelt) for k in range(len(texts))], bool
    ).reshape(len(texts))
    a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
    n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
    # The texts follow one another, so components never reach across.
    group_a, group_b = terminals(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
    last, group_b = np.unique(group_b, return_inverse=True)
    group_a = np.searchsorted(last, group_a)
    doc_of_group = np.repeat(np.arange(len(texts)), n_b)[last]
    of, pair, n = group_links(group_a, a, group_b, b, doc_of_group)
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, doc_of_group, np.bincount(group_a, minlength=len(last)) * np.bincount(group_b, minlength=len(last)))
    digests = group_digests(group_a, a, group_b, b, doc_of_group, len(texts))
    return n_a, n_b, np.bincount(doc_of_group, minlength=len(texts)), links, digests, (of, pair, n)


def _aligned_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    names = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    for batch in batches:
        for start, texts in portions(batch.column(1), size=TEXT_BYTES):
            *numbers, digests, (of, pair, n) = aligned(texts, path_a, path_b)
            held = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            columns = [batch.column(0).slice(start, len(texts)), *(pa.array(x, pa.int64()) for x in numbers)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, held)], names=names)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The alignment of every document, and of the corpus: (row, id, n_a, n_b, n_groups, n_links, groups_sha256, links) and
    (pair, a_id, b_id, n_docs, best). Both are written tables.

    path_a is a byte-level vocabulary of the tokenizers library, which encodes a space and the text; path_b a model of
    sentencepiece, which adds the space by itself. Special tokens are ordinary text. Bytes at which a token of both ends cut
    the document into groups; the links of a group are all its pairs of an A and a B token; links holds the distinct id pairs
    with the number of their links. n_docs counts the rows of docs that hold a pair, and best tells that no pair of the same
    A id has more. Texts that are null or empty, or that the tokens don't spell (those with a U+2581), have no tokens.
    Repeated rows are rows of their own; ids may be null. A task holds the tokens of one portion, or of one longer text, at
    a time. Other columns of docs play no part, and an empty table gives empty results.
    """
    # A row is told by a number of its own, as ids may repeat; written, so that it stays the same.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.select("row", "text", "id")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for made in _aligned_batches(iter([batch]), path_a, path_b):
                ids = batch.column(2).slice(start, made.num_rows)
                start += made.num_rows
                yield pa.RecordBatch.from_arrays([*made.columns, ids], names=[*made.schema.names, "id"])

    per_doc = written(found.mapInArrow(run, f"{ALIGNED}, id {kind}"), "aligned")
    counts = per_doc.select(F.inline("links")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = written(counts.withColumn("a_id", F.expr(f"pair div {SHIFT}")), "pair-counts")
    # One row for each id of the vocabulary at most.
    most = F.broadcast(counts.groupBy("a_id").agg(F.max("n_docs").alias("most")))
    corpus = counts.join(most, "a_id").select("pair", "a_id", F.expr(f"pair % {SHIFT}").alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    return per_doc, written(corpus, "pairs")


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a row of docs; see align_tokenizers().

    n_best counts the links whose pair is best; count_sum adds up n_docs over the links. Pairs in at least a hot_pairs-th
    part of all distinct links of documents are at most hot_pairs, and are broadcast; no other pair has more rows than that.
    """
    per_doc, corpus = align_tokenizers(docs, path_a, path_b, id_col, text_col)
    total = corpus.agg(F.sum("n_docs"), F.count(F.lit(1))).head()
    least = 0 if total[1] <= hot_pairs else -(-total[0] // hot_pairs)
    links = per_doc.select("row", F.inline("links"))
    corpus = corpus.select("pair", "n_docs", "best")

    def summed(joined: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0))
        return joined.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))

    # Links of a row stand together, so its sums are added up before the shuffle.
    hot = corpus.where(F.col("n_docs") >= least)
    sums = summed(links.join(F.broadcast(hot), "pair"))
    if least:
        rare = corpus.where(F.col("n_docs") < least)
        rest = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair")
        sums = sums.unionByName(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return per_doc.drop("links").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *numbers, "groups_sha256")
