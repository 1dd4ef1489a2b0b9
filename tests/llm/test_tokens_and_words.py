"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackweave.llm import alignment, sentence_pieces, spelling
from trackweave.llm.bpe import byte_of_symbol
from trackweave.llm.queries import tokenizer_file

ODD = [None, "", " ", "  x", "▁", "a ▁b", "x" * 9_000, "-" * 9_000, "<|endoftext|> <s> </s>", "日本 😀\x00\t\n\n  z", "Éa ñ" * 30, "ing nging" * 40]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def ids_of(texts):
    ids, n = sentence_pieces.piece_ids(pa.array(texts, pa.string()), tokenizer_file("piece_bpe_32k.model"))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_merge_rounds_as_the_library(library):
    rng = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for some in (pieces, pieces[:250], "etaoin  hrlu▁é") for _ in range(1_500)]
    assert ids_of(texts) == library.encode(texts)


def test_sentencepiece_round_trip(docs, spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(0, "again", "y"), (None, "no id", None)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string")
    for given in (docs, odd):
        want = Counter()
        for r in given.collect():
            ids = [*library.encode(r["text"] or ""), 2]
            want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
        made = sentence_pieces.sentencepiece_round_trip(given, tokenizer_file("piece_bpe_32k.model"))
        assert Counter(map(tuple, made.collect())) == want
    real = sentence_pieces.sentencepiece_round_trip(odd, tokenizer_file("piece_bpe_32k.model"), digests=False).where("doc_id = 3").head()
    assert real["ids"] == [*library.encode("  x"), 2] and real["decoded"] == "  x"


def plain_alignment(text, library, tokenizer):
    if not text:
        return None
    symbols = byte_of_symbol()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
    bytes_a = [bytes(symbols[c] for c in tokenizer.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(library.id_to_piece, b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        group = ([], [])
        while not group[0] or at_a != at_b:
            if at_a <= at_b:
                group[0].append(a[i])
                at_a, i = at_a + len(bytes_a[i]), i + 1
            else:
                group[1].append(b[j])
                at_b, j = at_b + len(bytes_b[j]), j + 1
        groups.append(group)
    digest = sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
    return len(a), len(b), len(groups), Counter((x, y) for g in groups for x in g[0] for y in g[1]), digest


@pytest.mark.parametrize("hot_pairs", [40, alignment.HOT_PAIRS])
def test_cross_alignment(docs, spark, library, hot_pairs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(ODD)] + [(0, "again and again"), (None, "no id"), (None, "no id")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").union(docs.select("doc_id", "text"))
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    found = [(r["doc_id"], plain_alignment(r["text"], library, tokenizer)) for r in odd.collect()]
    held = Counter(pair for _, x in found if x for pair in x[3])
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = Counter()
    for i, x in found:
        if x is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        best = sum(n for (a, b), n in x[3].items() if held[a, b] == most[a])
        want[i, x[0], x[1], x[2], x[3].total(), best, sum(n * held[p] for p, n in x[3].items()), x[4]] += 1
    made = alignment.cross_alignment(odd.withColumn("row", odd["doc_id"]), *paths, hot_pairs=hot_pairs)
    assert Counter(map(tuple, made.collect())) == want


def test_pointers_reach_the_end_of_their_component():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        ends = [np.union1d(rng.choice(np.arange(1, size + 1), rng.integers(1, size + 1), replace=False), [size]) for _ in range(2)]
        both = np.intersect1d(*ends)
        a, b = alignment.terminals(*ends)
        assert (ends[1][a] == both[np.searchsorted(both, ends[0])]).all() and (ends[1][b] == both[np.searchsorted(both, ends[1])]).all()


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and distance(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    made = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        made.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return made


def distance(a, b):
    """Edits between two words, up to 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("block_rows", [5, spelling.BLOCK_ROWS])
def test_spelling_variants(docs, spark, block_rows, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(spelling, "TILE", 16)
    base = ["".join(rng.choice("aeérstn") for _ in range(rng.randrange(7, 12))) for _ in range(25)] + ["x" * 60, "y" * 70, "ÿþÀÉabc", "x" * 61, "x" * 59 + "y"]
    rows = [(None, None), (1, ""), (2, "!!")]
    for i in range(150):
        words = []
        for w in rng.choices(base, [2 ** (8 - k % 9) for k in range(len(base))], k=40):
            at = rng.randrange(len(w))
            words.append(rng.choice([w] * 30 + [w[:at] + w[at + 1 :], w[:at] + rng.choice("aés") + w[at:], w[:at] + "é" + w[at + 1 :], w.upper()]))
        rows.append((rng.choice([None, i, i, i]), rng.choice(" \n,×1").join(words)))
    rows.append((901, "stonewall " * 300 + "stonewal " * 26 + "stonewa " * 2))
    rows += rows[20:30] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    given = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    made = spelling.spelling_variants(given, block_rows=block_rows).collect()
    assert len(made) == len(set(map(tuple, made))) and {tuple(r) for r in made} == plain_variants(rows)
    assert any(r["form"] and r["root"] != r["form"] for r in made) and any(r["n_near"] > 3 for r in made)


def test_empty_tables_of_tokens_and_words(empty):
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    for made in (alignment.cross_alignment(empty, *paths), sentence_pieces.sentencepiece_round_trip(empty, paths[1]), spelling.spelling_variants(empty)):
        assert made.collect() == []
