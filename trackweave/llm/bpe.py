"""Operator 10: BPE encoding and decoding with forced boundaries.

Merges only ever build vocabulary tokens, so two adjacent bytes that no token holds side by side are never merged: the
place between them is a certain cut. The pairs are read off the vocabulary. White space is in no token of a vocabulary
with word ends, so every run of ASCII white space is a certain cut; within what lies between, a pair of unlike kinds
(letter, digit, other) that no token holds is one too, as the library splits there before it merges. Fragments are
encoded independently, each distinct one once, and concatenated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .pieces import PieceCache, fragments, portions, ranges, tokenizer

#: Distinct fragments that a worker remembers, and their bytes; when either is full, it starts anew.
CACHED, CACHED_BYTES = 250_000, 6_000_000
#: Bytes of text that are encoded and joined at once; a longer text is taken alone.
TEXT_BYTES = 1_500_000


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it is printable Latin-1, and else as a code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def joined_pairs(path: str) -> np.ndarray:
    """A 256 by 256 table: whether a token of the vocabulary holds the two bytes side by side."""
    found = np.zeros((256, 256), bool)
    symbols = byte_of_symbol()
    special = {t.content for t in tokenizer(path).get_added_tokens_decoder().values()}
    for token in tokenizer(path).get_vocab():
        if token in special:
            raw = token.encode()
        else:
            raw = bytes(symbols[c] for c in token.removesuffix("</w>") if c in symbols)
        data = np.frombuffer(raw, np.uint8)
        found[data[:-1], data[1:]] = True
    return found


def _kind(byte: int) -> int:
    c = chr(byte)
    return 1 if c.isalpha() else 2 if c.isdigit() else 3


@lru_cache(maxsize=4)
def certain_cuts(path: str) -> np.ndarray:
    """Where a fragment may be cut, as a table of pairs: printable ASCII of unlike kinds that no token joins.

    The library marks the end of a word after a fragment, so bytes of one kind aren't parted. The apostrophe is left
    out, as it may start a word with letters.
    """
    cuts = np.zeros((256, 256), bool)
    plain = [b for b in range(33, 127) if chr(b) != "'"]
    for a in plain:
        for b in plain:
            cuts[a, b] = _kind(a) != _kind(b)
    return cuts & ~joined_pairs(path)


class Fragments:
    """The tokens of distinct fragments, remembered as ids; ids and tokens as text are looked up when they are joined."""

    def __init__(self, path: str):
        self.path = path
        vocabulary = tokenizer(path).get_vocab()
        token = [""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            token[i] = t
        self.ends = np.array([t.endswith("</w>") for t in token])
        self.decimal = pa.array(map(str, range(len(token))), pa.large_string())
        self.token = pa.array(token, pa.large_string())
        self.cache = PieceCache(self.encoded, CACHED, CACHED_BYTES)

    def encoded(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Fragments of letters share a text and are told apart by their ends of words; others are encoded alone."""
        found: dict[str, np.ndarray] = {}
        letters = [p for p in parts if p.isalpha()]
        for k in range(0, len(letters), 256):
            some = letters[k : k + 256]
            ids = np.array(tokenizer(self.path).encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some) and at[-1] == len(ids):
                found.update(zip(some, np.split(ids, at[:-1]), strict=True))
        alone = [p for p in parts if p not in found]
        made = tokenizer(self.path).encode_batch_fast(alone, add_special_tokens=False)
        found.update(zip(alone, (np.array(e.ids, np.int32) for e in made), strict=True))
        order = [found[p] for p in parts]
        return parts, np.concatenate(order), np.array([len(x) for x in order], np.int64)


@lru_cache(maxsize=2)
def _fragments(path: str) -> Fragments:
    return Fragments(path)


def _joined(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    taken = values.take(pa.array(ids))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), taken), pa.scalar(" ", pa.large_string()))


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: empty), one after the other, and where each text starts, and the last one ends."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    words = words.flatten().dictionary_encode()
    parts, n_parts = fragments(words.dictionary, certain_cuts(path))
    # From words to the fragments of distinct words, to their ids.
    ids, lengths = _fragments(path).cache.gathered(parts)
    first = np.concatenate([[0], np.cumsum(n_parts)])
    upto = np.concatenate([[0], np.cumsum(lengths)])[first]
    word = words.indices.to_numpy(zero_copy_only=False)
    n = np.diff(upto)[word]
    return ids[ranges(upto[:-1][word], n)], np.concatenate([[0], np.cumsum(n)])[offsets]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """One row a row of docs: id, n_tokens, ids_sha256, decoded_sha256; or ids and decoded instead of the digests.

    ids are what the tokenizers library gives for the whole text without added special tokens, truncation or padding;
    decoded is what its decode gives for them with skip_special_tokens=False: tokens joined by single spaces, as this
    kind of tokenizer has no decoder. A null text is the empty text, which has no tokens. Repeated rows and equal texts
    give equal results; the length of a text has no limit. Other columns of docs play no part, and an empty table gives an
    empty result.
    """
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, {last}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column(1), size=TEXT_BYTES):
                ids, offsets = encoded(texts, tokenizer_path)
                known = _fragments(tokenizer_path)
                if digests:
                    made = []
                    for values in (known.decimal, known.token):
                        text = _joined(values, ids, offsets)
                        made.append(pa.array([hashlib.sha256(memoryview(x.as_buffer() or b"")).hexdigest() for x in text], pa.string()))
                else:
                    made = [pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids)), _joined(known.token, ids, offsets).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(np.diff(offsets), pa.int64()), *made],
                    names=[id_col, "n_tokens", *[x.split()[0] for x in last.split(", ")]],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
