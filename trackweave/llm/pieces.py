"""Encoding by pieces: what a tokenizer gives for a string is looked up once for each distinct string of a batch.

A batch of texts is cut into pieces where no token can reach across. Arrow finds the distinct pieces, a bounded cache
holds the tokens of those met before, the tokenizers library encodes the others, and the tokens of the texts are put
together by index. Callers see to it that the cuts are certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, and their bytes; when either is full, it starts anew.
CACHED, CACHED_BYTES = 600_000, 12_000_000
#: Texts that are cut and put together at once, by number and by bytes.
TEXTS, TEXT_BYTES = 1000, 8_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def portions(column: pa.Array, texts: int = TEXTS, size: int = TEXT_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string array with their offset, each of a few texts; a long text is one of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        base = sizes[start - 1] if start else 0
        end = int(np.searchsorted(sizes, base + size))
        end = min(max(end, start + 1), start + texts, len(column))
        yield start, column.slice(start, end - start)
        start = end


def fragments(words: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The fragments of all words (large strings), cut wherever the table of byte pairs says so, and how many each word
    has."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    starts[1:-1] |= cuts[data[:-1], data[1:]]
    starts[-1] = False
    before = np.concatenate([[0], np.cumsum(starts)])
    ends = np.append(np.flatnonzero(starts), len(data))
    parts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data.copy()))
    return parts, np.diff(before[offsets])


class PieceCache:
    """Token ids by piece, in one growing array.

    encode takes distinct pieces and gives them in an order of its own, with their ids one after the other and how many
    each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = CACHED, limit_bytes: int = CACHED_BYTES):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.bytes = 0
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def slots_of(self, pieces: list[str]) -> np.ndarray:
        if len(self.slots) + len(pieces) > self.limit or self.bytes > self.limit_bytes:
            self.clear()
        get = self.slots.get
        found = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            order, ids, lengths = self.encode([pieces[k] for k in new])
            self.bytes += sum(map(len, order))
            base = len(self.starts) - 1
            self.slots.update(zip(order, range(base, base + len(order)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            found[new] = [self.slots[pieces[k]] for k in new]
        return found

    def gathered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        if not len(pieces):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        coded = pieces.dictionary_encode()
        slots = self.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.starts[slots + 1] - self.starts[slots]
        return self.ids[ranges(self.starts[slots], lengths)], lengths


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, lengths of them, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_list(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]
