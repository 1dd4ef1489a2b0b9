"""Operator 6: token ids in binary files, coded by a static range asymmetric numeral system (rANS).

File format: a table of groups that Spark writes as Parquet, one row a group. A group holds
whole documents in ascending order of their ids: their ids, their token counts, and a payload of independent blocks.
A block of up to BLOCK_TOKENS tokens is coded by LANES interleaved coders, token i by lane i mod LANES, all under one
frequency table for the whole corpus, which is stored beside the groups. Its header has the number of tokens, the
number of words, a crc32 of the tokens and a checkpoint, the end state of each lane, from which decoding starts; so
blocks, and groups, decode in parallel. The coders of a group's blocks run side by side as one numpy vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .pieces import PieceCache, fragments, portions, ranges, sums_by_list, tokenizer

LANES = 256
BLOCK_TOKENS = 16_384
#: Tokens from which a group is closed; a document is never parted.
GROUP_TOKENS = 500_000
SCALE_BITS = 20
#: Coder states stay in [LOWER, LOWER << 32).
LOWER = np.uint64(1 << 31)
HEADER = np.dtype([("magic", "<u4"), ("tokens", "<u4"), ("words", "<u4"), ("crc32", "<u4")])
MAGIC = 0x31534E52

GROUPS = "part int, seq int, in_part bigint, n_tokens bigint, doc_ids binary, doc_tokens binary, payload binary"


# Encoding texts


@lru_cache(maxsize=1)
def cuts() -> np.ndarray:
    """Pairs of bytes that the tokenizer's pattern parts wherever they stand: printable ASCII of unlike kinds (letter,
    digit, other), but for the apostrophe, which may start a word; and printable ASCII before a line's end. How the
    pattern parts white space depends on what follows, so that is never cut off."""
    kind = np.zeros(256, np.int8)
    kind[33:127] = 3
    kind[[b for b in range(128) if chr(b).isalpha()]] = 1
    kind[[b for b in range(128) if chr(b).isdigit()]] = 2
    kind[ord("'")] = 0
    plain, line = kind > 0, np.arange(256) == 10
    found = (kind[:, None] != kind[None, :]) & plain[:, None] & plain[None, :]
    return found | plain[:, None] & line[None, :]


@lru_cache(maxsize=2)
def _marks(path: str) -> tuple[np.ndarray, int]:
    """Which tokens start with a space, and the token of a line's end."""
    vocab = tokenizer(path).get_vocab()
    found = np.zeros(max(vocab.values()) + 1, bool)
    found[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
    return found, vocab["Ċ"]


def _encode_pieces(path: str, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of letters after a space, or after a line's end, share a text; they are told apart by the tokens that start
    with a space, or end a line. All else is encoded alone."""
    order: list[str] = []
    made: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    starts, line = _marks(path)
    encode = lambda texts: [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    kinds: dict[str, list[str]] = {" ": [], "\n": [], "": []}
    for p in pieces:
        kinds[p[0] if p[0] in " \n" and p[1:].isalpha() else ""].append(p)
    alone = kinds.pop("")
    for gap, words in kinds.items():
        for k in range(0, len(words), 512):
            part = words[k : k + 512]
            ids = np.array(encode(["".join(part)])[0], np.int64)
            at = np.flatnonzero(starts[ids] if gap == " " else ids == line)
            if len(at) != len(part) or at[0]:
                alone += part
                continue
            order += part
            made.append(ids)
            lengths.append(np.diff(np.append(at, len(ids))))
    found = encode(alone)
    order += alone
    made += [np.array(x, np.int64) for x in found]
    lengths.append(np.array([len(x) for x in found], np.int64))
    return order, np.concatenate(made) if made else np.empty(0, np.int64), np.concatenate(lengths)


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    return PieceCache(lambda pieces: _encode_pieces(path, pieces))


#: A space after white space: not a certain cut, as both may be in one token.
UNSURE = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}] "


def token_ids(texts: pa.Array, path: str, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: empty), each followed by end if given, and their numbers.

    The tokenizer parts words before a space, so a text is cut there, unless white space comes before the space; texts
    with such a place, or with an added token, are encoded as a whole. What lies between is cut at cuts().
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    unsure = pc.match_substring_regex(texts, UNSURE)
    for added in tokenizer(path).get_added_tokens_decoder().values():
        unsure = pc.or_(unsure, pc.match_substring(texts, added.content))
    cut = pc.split_pattern(pc.if_else(unsure, pa.scalar("", pa.large_string()), texts), " ")
    offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    before = np.full(len(cut.flatten()), " ", object)
    before[offsets[:-1]] = ""
    pieces = pc.binary_join_element_wise(pa.array(before, pa.large_string()), cut.flatten(), pa.scalar("", pa.large_string()))
    coded = pieces.dictionary_encode()
    parts, n_parts = fragments(coded.dictionary, cuts())
    ids, lengths = _cache(path).gathered(parts)
    # From pieces to fragments to ids.
    piece = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_parts)])]
    starts, sizes = ends[:-1][piece], np.diff(ends)[piece]
    ids, n = ids[ranges(starts, sizes)], sums_by_list(sizes, offsets)
    whole = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
    if len(whole):
        own = [e.ids for e in tokenizer(path).encode_batch_fast([texts[k].as_py() for k in whole.tolist()], add_special_tokens=False)]
        ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[whole], [len(x) for x in own]), np.concatenate(own))
        n[whole] = [len(x) for x in own]
    if end is None:
        return ids, n
    return np.insert(ids, np.cumsum(n), end), n + 1


def encoded_docs(docs: DataFrame, path: str, id_col: str, text_col: str, end: int | None) -> DataFrame:
    """(id, n_tokens, tokens): ids as little-endian unsigned 16-bit integers if the vocabulary allows, else 32-bit."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(path)
        for batch in batches:
            for start, texts in portions(batch.column(1)):
                ids, counts = token_ids(texts, path, end)
                data = ids.astype(width)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * data.itemsize
                tokens = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(counts), tokens], names=["id", "n_tokens", "tokens"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, tokens binary")


def _width(path: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


# The coder


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 1 << SCALE_BITS, at least 1 for each symbol that occurs."""
    total = 1 << SCALE_BITS
    present = counts > 0
    scaled = np.where(present, np.maximum(counts * (total - present.sum()) // max(int(counts.sum()), 1) + 1, 1), 0).astype(np.int64)
    if present.any():
        scaled[int(np.argmax(counts))] += total - scaled.sum()
    return scaled


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, tokens: np.ndarray) -> bytes:
        """Blocks of tokens, side by side: row r of a block codes its tokens r * LANES and on, last row first."""
        n = len(tokens)
        blocks = -(-n // BLOCK_TOKENS)
        rows = BLOCK_TOKENS // LANES
        padded = np.full(blocks * BLOCK_TOKENS, tokens[0] if n else 0, np.int64)
        padded[:n] = tokens
        grid = padded.reshape(blocks, rows, LANES)
        live = (np.arange(blocks * BLOCK_TOKENS) < n).reshape(blocks, rows, LANES)
        state = np.full((blocks, LANES), LOWER, np.uint64)
        words = np.zeros((blocks, rows, LANES), np.uint32)
        sent = np.zeros((blocks, rows, LANES), bool)
        shift, limit = np.uint64(32), np.uint64(31 - SCALE_BITS + 32)
        for r in range(rows - 1, -1, -1):
            t, on = grid[:, r], live[:, r]
            f = self.freq[t]
            out = on & (state >= (f << limit))
            words[:, r][out] = (state[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            sent[:, r] = out
            state = np.where(out, state >> shift, state)
            q = state // f
            coded = (q << np.uint64(SCALE_BITS)) + (state - q * f) + self.start[t]
            state = np.where(on, coded, state)
        made = []
        for b in range(blocks):
            own = tokens[b * BLOCK_TOKENS : (b + 1) * BLOCK_TOKENS]
            body = words[b][sent[b]]
            head = np.array([(MAGIC, len(own), len(body), zlib.crc32(own.astype("<u4").tobytes()))], HEADER)
            made += [head.tobytes(), state[b].astype("<u8").tobytes(), body.astype("<u4").tobytes()]
        return b"".join(made)

    def decode(self, payload: bytes) -> np.ndarray:
        """The tokens of a payload; a wrong header or checksum is an error."""
        at, heads, states, bodies = 0, [], [], []
        while at < len(payload):
            head = np.frombuffer(payload, HEADER, 1, at)[0]
            if head["magic"] != MAGIC:
                raise ValueError("not a block of token ids")
            at += HEADER.itemsize
            states.append(np.frombuffer(payload, "<u8", LANES, at))
            at += 8 * LANES
            bodies.append(np.frombuffer(payload, "<u4", head["words"], at))
            at += 4 * int(head["words"])
            heads.append(head)
        if not heads:
            return np.empty(0, np.int64)
        counts = np.array([h["tokens"] for h in heads], np.int64)
        state = np.array(states, np.uint64)
        body = np.concatenate(bodies).astype(np.uint64) if bodies else np.empty(0, np.uint64)
        body = np.append(body, np.uint64(0))
        next_word = np.cumsum([0, *[len(x) for x in bodies[:-1]]])
        rows = int(-(-counts.max() // LANES))
        out = np.zeros((len(heads), rows, LANES), np.int64)
        mask, lane = np.uint64((1 << SCALE_BITS) - 1), np.arange(LANES)
        for r in range(rows):
            on = r * LANES + lane[None, :] < counts[:, None]
            slot = state & mask
            t = self.symbol[slot]
            out[:, r] = t
            new = self.freq[t] * (state >> np.uint64(SCALE_BITS)) + slot - self.start[t]
            read = on & (new < LOWER)
            order = np.cumsum(read, axis=1)
            place = np.where(read, next_word[:, None] + order - 1, len(body) - 1)
            new = np.where(read, (new << np.uint64(32)) | body[place], new)
            state = np.where(on, new, state)
            next_word = next_word + order[:, -1]
        if (state != LOWER).any():
            raise ValueError("a block of token ids is damaged")
        made = []
        for b, head in enumerate(heads):
            own = out[b].reshape(-1)[: counts[b]]
            if zlib.crc32(own.astype("<u4").tobytes()) != head["crc32"]:
                raise ValueError("a block of token ids is damaged")
            made.append(own)
        return np.concatenate(made)


# Files


def token_counts(encoded: DataFrame, path: str) -> DataFrame:
    """(token, n) over all documents; every task sends a row a token it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(tokenizer(path).get_vocab_size() + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                data = b"".join(batch.column(0).slice(start, 1000).to_pylist())
                found = np.bincount(np.frombuffer(data, _width(path)))
                counts[: len(found)] += found
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["token", "n"])

    parts = encoded.select("tokens").mapInArrow(run, "token bigint, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def _groups(batches: Iterator[pa.RecordBatch], freq: np.ndarray, width: np.dtype) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    coder, part = Coder(freq), TaskContext.get().partitionId()
    ids: list[int] = []
    counts: list[int] = []
    held: list[bytes] = []
    size = seq = done = 0

    def group() -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(held), width).astype(np.int64)
        row = [part, seq, done, len(tokens), np.array(ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), coder.encode(tokens)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in GROUPS.split(", ")])

    for batch in batches:
        for i, n, tokens in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids.append(NULL_ID if i.as_py() is None else i.as_py())
            counts.append(n.as_py())
            held.append(tokens.as_py())
            size += counts[-1]
            if size >= GROUP_TOKENS:
                yield group()
                seq, done, size = seq + 1, done + size, 0
                ids, counts, held = [], [], []
    if ids:
        yield group()


#: Stands for a null id in files; such documents come first.
NULL_ID = -(1 << 63)


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Writes the files; gives the table of groups and that of frequencies, both as read back from the shared folder."""
    encoded = written(encoded_docs(docs, tokenizer_path, id_col, text_col, end), "tokens")
    table = written(token_counts(encoded, tokenizer_path), "frequencies")
    counts = np.zeros(_vocabulary(tokenizer_path), np.int64)
    for row in table.collect():  # as many rows as the vocabulary has at most
        counts[row["token"]] = row["n"]
    freq, width = frequencies(counts), _width(tokenizer_path)
    parts = docs.sparkSession.sparkContext.broadcast(freq)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionByRange(n, "id").sortWithinPartitions("id")
    groups = ordered.mapInArrow(lambda batches: _groups(batches, parts.value, width), GROUPS)
    return written(groups, "groups"), table


def _vocabulary(path: str) -> int:
    return tokenizer(path).get_vocab_size() + 1


def read_tokens(groups: DataFrame, table: DataFrame, tokenizer_path: str, tokens: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, tokens]) from the files. start counts the ids of all documents before.

    Parts are in the order of ids, so a group starts after the tokens of all parts before its own: one row a part.
    """
    totals = groups.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, starts = 0, {}
    for row in sorted(totals, key=lambda r: r["part"]):
        starts[row["part"]] = before
        before += row["n"]
    counts = np.zeros(_vocabulary(tokenizer_path), np.int64)
    for row in table.collect():
        counts[row["token"]] = row["n"]
    freq = groups.sparkSession.sparkContext.broadcast(frequencies(counts))
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", tokens array<int>" if tokens else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for batch in batches:
            for row in batch.to_pylist():
                found = coder.decode(row["payload"]).astype("<u4")
                ids, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<i8")
                ends = np.cumsum(sizes)
                first = starts[row["part"]] + row["in_part"] + ends - sizes
                view = memoryview(found.tobytes())
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                made = [pa.array(ids, mask=ids == NULL_ID), pa.array(first), pa.array(sizes), pa.array(crc, pa.int64())]
                if tokens:
                    made.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in schema.split(", ")])

    return groups.select("part", "in_part", "doc_ids", "doc_tokens", "payload").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 0) -> DataFrame:
    """Writes the ids of docs to files and reads them back: id, start, n_tokens, ids_crc32.

    The id column is an integer. Each text (null: empty) is followed by the id end. Documents are in ascending order of
    ids; null ids come first, and rows that repeat an id stand side by side, in no set order among themselves. A document
    stays in one group, so a group grows with its longest document. Other columns of docs play no part; an empty table
    gives an empty result.
    """
    groups, table = write_tokens(docs, tokenizer_path, id_col, text_col, end)
    return read_tokens(groups, table, tokenizer_path).withColumnRenamed("id", id_col)
