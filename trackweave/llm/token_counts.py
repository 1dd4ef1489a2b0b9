"""Operator 5: token counts by section, through an offset map.

Every document is encoded once, as a whole. The bytes of its tokens, added up, give each token's span, which is mapped to
characters; an interval join within the document then gives each token to the section its span meets. A token across a
boundary is allotted by a stated rule. Sections can be lines of a text or fields that were joined into one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A token across a boundary goes to the section of its first character, of its last one, or of most of its bytes (of
#: equal parts the first section).
RULES = ("first", "last", "most")
#: Sections a batch of results holds, about.
ROWS = 20_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, path: str) -> np.ndarray:
    """Where each token of a text ends, in bytes of UTF-8."""
    found, sizes = encoding(path)
    return np.cumsum(sizes[np.asarray(found.encode_to_numpy(text), np.int64)])


def allotted(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. bounds has where each section ends; the last one ends with the text."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    if rule == "first":
        return first
    last = np.searchsorted(bounds, ends - 1, side="right")
    if rule == "last":
        return last
    section = first.copy()
    for k in np.flatnonzero(first != last):
        edges = np.clip(np.concatenate([[starts[k]], bounds[first[k] : last[k]], [ends[k]]]), starts[k], ends[k])
        section[k] = first[k] + int(np.argmax(np.diff(edges)))
    return section


def line_bounds(data: bytes) -> np.ndarray:
    """Where the lines of a text end; a line holds the \\n after it. A last line without characters isn't one."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def section_tokens(
    docs: DataFrame, tokenizer_path: str, fields: list[str] | None = None, rule: str = "first", id_col: str = "doc_id"
) -> DataFrame:
    """(id, section, start_char, end_char, n_tokens): a row a section, from 0.

    With one field, its lines are the sections, each with its \\n. With several, their values (null: empty) are joined
    without a gap, encoded once, and are the sections. tokenizer_path is a file of ranks for tiktoken; strings of special
    tokens count as ordinary text. A section's n_tokens may be 0. A text that is null or empty has one section without
    tokens. Per document the n_tokens add up to those of the whole. Repeated rows give equal results; texts may have any
    length; other columns of docs play no part.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = fields or ["text"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, section int, start_char bigint, end_char bigint, n_tokens bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def sections(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(v or "").encode() for v in values]
        data = b"".join(parts)
        bounds = line_bounds(data) if len(parts) == 1 else np.cumsum([len(p) for p in parts])
        section = allotted(token_ends(data.decode(), tokenizer_path), bounds, rule)
        # A byte starts a character unless it continues one.
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return chars[np.concatenate([[0], bounds])], np.bincount(section, minlength=len(bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for k in range(batch.num_rows):
                edges, counts = sections([batch.column(c + 1)[k].as_py() for c in range(len(fields))])
                held.append((k, edges, counts))
                rows += len(counts)
                if rows >= ROWS or k == batch.num_rows - 1:
                    which = np.repeat([h[0] for h in held], [len(h[2]) for h in held])
                    section = np.concatenate([np.arange(len(h[2]), dtype=np.int32) for h in held])
                    columns = [np.concatenate([f(h) for h in held]) for f in (lambda h: h[1][:-1], lambda h: h[1][1:], lambda h: h[2])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(which)), pa.array(section), *(pa.array(c.astype(np.int64)) for c in columns)], names=names
                    )
                    held, rows = [], 0

    return docs.select(id_col, *fields).mapInArrow(run, schema)
