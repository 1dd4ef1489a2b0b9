"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones. An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a document's vector bundles (adds) those of its n-grams; a language's
prototype bundles the documents that are learned from. A document gets the language whose prototype has the largest
cosine to it. Bundles are sums of integers, so partitions add them up in any order with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = 1024
SEED = 7
FOLDS = 5
N = 3
#: Bits of a code point; n-grams are told apart by N of them.
BITS = 21
#: Bound n-grams that a worker remembers, of DIMENSIONS bytes each; when full, it starts anew. Grams that are bound at once.
REMEMBERED, BLOCK = 16_384, 4096


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A vector of plus and minus ones for each code point, from a generator that the point seeds."""
    x = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 40)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits(np.ascontiguousarray(x ^ (x >> np.uint64(32))).view(np.uint8), axis=1)
    return (2 * bits.astype(np.int8) - 1).reshape(len(points), DIMENSIONS)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams: each letter's, rotated by its distance from the last, multiplied."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(N):
        points, which = np.unique(codes >> (BITS * place) & ((1 << BITS) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(points), place, axis=1)[which]
    return out


class _Grams:
    """The vectors of n-grams that this worker has met lately, by code."""

    def __init__(self) -> None:
        self.codes, self.vectors = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """codes are distinct and sorted."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = codes[~known]
            if len(self.codes) + len(new) > REMEMBERED:
                self.codes, self.vectors, new = self.codes[:0], self.vectors[:0], codes
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.vectors = every[order], np.concatenate([self.vectors, gram_vectors(new)])[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]


@lru_cache(maxsize=1)
def _grams() -> _Grams:
    return _Grams()


@lru_cache(maxsize=1)
def symbol_of() -> np.ndarray:
    """A table over all code points: a letter's is its lower case, that of all else, the gap, is 0."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        low = chr(c).lower()[:1]
        if low.isalpha():
            table[c] = ord(low)
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's n-grams of letters and gaps, and their counts. A gap is one symbol, however long."""
    symbols = symbol_of()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = (symbols > 0) | (np.concatenate([[0], symbols[:-1]]) > 0)
    s = np.concatenate([[0], symbols[keep], [0]])
    codes = sum(s[N - 1 - place : len(s) - place] << (BITS * place) for place in range(N))
    return np.unique(codes, return_counts=True)


def bundled(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of n-grams' vectors, exact: float32 holds integers up to 2 ** 24."""
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64
    total = np.zeros(DIMENSIONS, kind)
    for k in range(0, len(codes), BLOCK):
        total += counts[k : k + BLOCK].astype(kind) @ _grams().of(codes[k : k + BLOCK]).astype(kind)
    return total


def bundle(text: str) -> np.ndarray:
    """A document's vector."""
    return bundled(*grams(text))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """Whether the fold, crc32 of the id as text (null: empty) modulo FOLDS, is 0."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, vector) of all rows that have a lang and a letter. Every task sends one vector a language it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[str, np.ndarray] = {}
        for batch in batches:
            met: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if has_letter(text):
                    met.setdefault(lang.as_py(), []).append(grams(text))
            for lang, found in met.items():
                codes, which = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(which, np.concatenate([n for _, n in found])).astype(np.int64)
                vectors[lang] = vectors.get(lang, 0) + bundled(codes, counts).astype(np.int64)
        if vectors:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(vectors), pa.string()), pa.array([v.tolist() for v in vectors.values()], pa.list_(pa.int64()))],
                names=["lang", "vector"],
            )

    parts = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(run, "lang string, vector array<bigint>")
    cells = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    return cells.groupBy("lang").agg(ordered.alias("vector"))


def predict(docs: DataFrame, model: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, from the text alone."""
    langs = sorted(model)
    matrix = np.array([model[x] for x in langs], np.float64).reshape(len(langs), DIMENSIONS)
    norms = np.maximum(np.linalg.norm(matrix, axis=1), 1e-12)
    unit = (matrix / norms[:, None]).astype(np.float32)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                if not langs or not has_letter(text):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                v = bundle(text)
                cosines = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cosines))
                preds.append(langs[best])
                scores.append(float(np.clip(cosines[best], 0, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a row of docs: id, held_out, lang_pred, score.

    Learned from the rows outside the held-out fold that have a lang; lang is no input of a prediction. score is the
    cosine to the prototype, at least 0. A text that is null or has no letter is 'und' with score 0, as is every text if
    nothing can be learned from. Of equal cosines the first lang by code point wins. Whole texts count, however long;
    repeated rows give equal results; a null id counts as the empty text for its fold. Letters of all scripts have vectors
    of their own. The model, 8 kB for each lang value, is all that the driver sees; an empty table gives an empty result.
    """
    train = docs.where(~held_out(id_col))
    model = {r["lang"]: r["vector"] for r in written(prototypes(train, text_col, lang_col), "prototypes").collect()}
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
