"""Operator 12: SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The distinct words of a portion of texts are one flat numpy array of symbols. Each round finds the best ranked pair of
every word by a segmented minimum and merges its occurrences from the left at once; words without a pair that merges are
set aside, the rest is compacted. A queue would take the occurrences one by one: it comes to the same unless a merge
makes a pair that ranks no worse than itself. Such a merge is the last one of its word in the round.

Words are cut where no piece of the vocabulary holds the two bytes side by side, as only pieces are ever merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .pieces import PieceCache, fragments, portions, ranges

#: U+2581 stands for a space in pieces.
MARK = "▁"
#: Distinct words that a worker remembers, and their characters; when either is full, it starts anew.
CACHED, CACHED_CHARS = 250_000, 6_000_000
#: Bytes of text that are encoded and joined at once; a longer text is taken alone.
TEXT_BYTES = 1_500_000
#: Rank of a pair that doesn't merge.
NEVER = np.int32(2**31 - 1)


class Model:
    """The tables of a BPE model with byte fallback, which adds a space before a text and normalises nothing else."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size, self.end = model.get_piece_size(), model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {pieces[i]: i for i in normal}
        self.byte = np.full(256, -1, np.int32)
        for i in filter(model.is_byte, range(self.size)):
            self.byte[int(pieces[i][3:-1], 16)] = i
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        # Equal scores are equal ranks.
        scores = np.array([model.get_score(i) for i in range(self.size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        splits = [(ids[p[:k]] * self.size + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        made = np.array(sorted(splits), np.int64).reshape(-1, 2)
        self.pairs, self.merged, self.rank = made[:, 0], made[:, 1].astype(np.int32), rank
        text = {i: pieces[i].replace(MARK, " ").encode() for i in normal} | {int(i): bytes([b]) for b, i in enumerate(self.byte) if i >= 0}
        self.bytes = [text.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.cuts = self._cuts([pieces[i] for i in normal])
        self.cache = PieceCache(self.encoded, CACHED, CACHED_CHARS)

    @staticmethod
    def _cuts(pieces: list[str]) -> np.ndarray:
        """Pairs of bytes that no piece holds side by side, at the start of a character. A mark in a text is a space too."""
        joined = np.zeros((256, 256), bool)
        for piece in pieces:
            for form in {piece, piece.replace(MARK, " ")}:
                data = np.frombuffer(form.encode(), np.uint8)
                joined[data[:-1], data[1:]] = True
        mark = MARK.encode()
        joined[mark[-1], 0x20] = joined[0x20, mark[0]] = True
        found = ~joined
        found[:, 0x80:0xC0] = False
        return found

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols makes, and its rank; NEVER if it makes none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        made = self.merged[at]
        return made, np.where(self.pairs[at] == key, self.rank[made], NEVER)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all characters, or of their bytes where the vocabulary lacks them, and the word of each."""
        joined = "".join(words).replace(" ", MARK)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.char[chars]
        lacking = np.flatnonzero(ids < 0)
        if len(lacking):
            spelt = [self.byte[np.frombuffer(chr(c).encode(), np.uint8)] for c in chars[lacking].tolist()]
            n = np.ones(len(ids), np.int64)
            n[lacking] = [len(s) for s in spelt]
            word = np.repeat(word, n)
            ids = np.repeat(ids, n)
            ids[ids < 0] = np.concatenate(spelt)
        return ids, word

    def encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        ids, word = self.symbols(words)
        ids, word = merge_rounds(self, ids, word)
        return words, ids, np.bincount(word, minlength=len(words))


def merge_rounds(model: Model, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words once no pair is left to merge, in the order of the words, and the word of each."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        made, rank = model.looked_up(ids[:-1], ids[1:])
        rank = np.append(np.where(word[1:] == word[:-1], rank, NEVER), NEVER)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        best = np.minimum.reduceat(rank, first)[of]
        over = best == NEVER
        if over.any():
            done.append((ids[over], word[over]))
        at = np.flatnonzero((rank == best) & ~over)
        # Of occurrences that overlap in a row, every other one from the left.
        row = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), np.arange(len(at)), 0)) if len(at) else at
        at = at[(np.arange(len(at)) - row) % 2 == 0]
        at = at[_before_a_better_pair(model, ids, word, rank, made, at)]
        ids = ids.copy()
        ids[at] = made[at]
        keep = ~over
        keep[at + 1] = False
        ids, word = ids[keep], word[keep]
    if not done:
        return ids, word
    ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return ids[order], word[order]


def _before_a_better_pair(model: Model, ids: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the merges at the places at (in order) come no later than the first one of their word that makes a pair which
    ranks no worse."""
    keep = np.ones(len(at), bool)
    if len(at) < 2:
        return keep
    several = np.append(word[at[1:]] == word[at[:-1]], False)
    several[1:] |= several[:-1].copy()
    some = np.flatnonzero(several)
    if not len(some):
        return keep
    here, n = at[some], len(ids)
    left, right = np.maximum(here - 1, 0), np.minimum(here + 2, n - 1)
    # The symbol before may have been merged from the left in the same round.
    before = ids[left].copy()
    follows = np.append(False, here[1:] == here[:-1] + 2)
    before[follows] = made[here[:-1]][follows[1:]]
    one = np.where((here > 0) & (word[left] == word[here]), model.looked_up(before, made[here])[1], NEVER)
    two = np.where((here + 2 < n) & (word[right] == word[here]), model.looked_up(made[here], ids[right])[1], NEVER)
    better = np.minimum(one, two) <= rank[here]
    upto = np.cumsum(better) - better
    first = np.append(True, word[here[1:]] != word[here[:-1]])
    base = upto[np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))]
    keep[some] = upto == base
    return keep


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def piece_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: empty) without any end id, one after the other, and how many each text has."""
    known = model(path)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    given = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False)) > 0
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(pa.array(given)), pa.scalar("", pa.large_string()))
    parts, n_parts = fragments(marked, known.cuts)
    ids, lengths = known.cache.gathered(parts)
    upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_parts)])]
    n = np.zeros(len(texts), np.int64)
    n[given] = np.diff(upto)
    return ids, n


def decoded(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """The text of each list of ids in UTF-8, without the space that encoding adds."""
    known = model(path)
    flat = np.frombuffer(b"".join(known.bytes), np.uint8)
    starts = np.cumsum(known.lengths) - known.lengths
    data = flat[ranges(starts[ids], known.lengths[ids])].tobytes()
    at = np.concatenate([[0], np.cumsum(known.lengths[ids])])[offsets].tolist()
    made = []
    for start, end in zip(at[:-1], at[1:], strict=True):
        text = data[start:end].removeprefix(b" ")
        made.append(text.decode(errors="replace").encode())
    return made


def sentencepiece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """One row a row of docs: id, n_tokens, ids_sha256, decoded_sha256; or ids and decoded instead of the digests.

    ids are what the sentencepiece library gives for the whole text, and the end id after them; decoded is what its decode
    gives for them, where a U+2581 of the text has become a space. A null text is the empty text, which has the end id only.
    Repeated rows and equal texts give equal results, ids may be null, and the length of a text has no limit. Other columns
    of docs play no part, and an empty table gives an empty result.
    """
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, {last}"
    names = [id_col, "n_tokens", *[x.split()[0] for x in last.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = pa.array(map(str, range(model(model_path).size)), pa.large_string())
        for batch in batches:
            for start, texts in portions(batch.column(1), size=TEXT_BYTES):
                ids, n = piece_ids(texts, model_path)
                ids, n = np.insert(ids, np.cumsum(n), model(model_path).end), n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                back = decoded(ids, offsets, model_path)
                if digests:
                    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), decimal.take(pa.array(ids)))
                    spelt = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                    made = [
                        pa.array([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in spelt], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    ]
                else:
                    made = [pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32())), pa.array(back, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), *made], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
