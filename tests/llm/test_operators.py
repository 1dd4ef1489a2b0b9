"""The operators over small rows against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trackweave.llm import bpe, exact_dedup, html_text, jaccard_join, language_id, license_scan, mixing, quality_rules
from trackweave.llm import token_counts, token_files
from trackweave.llm.queries import tokenizer_file

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(docs):
    made = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact_dedup.exact_dedup(docs)))
    groups = defaultdict(list)
    for r in rows(docs):
        groups[SPACE.sub(" ", r["text"] or "")].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), i == keep, digest) for i in ids)
    assert made == want


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    b[:500] = a[:500]
    blocks = [exact_dedup.filter_blocks(*np.unique(x, return_counts=True)) for x in (a, b)]
    merged = pa.Table.from_batches(blocks).sort_by("block").combine_chunks().to_batches()
    found = {}
    for batch in exact_dedup._merge(iter([b.slice(k, 37) for b in merged for k in range(0, b.num_rows, 37)])):
        found.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    want = {int(np.uint64(k).view(np.int64)): n for k, n in Counter(np.concatenate([a, b]).tolist()).items() if n > 1}
    assert found == want


def test_quality_rules(docs):
    made = {r["doc_id"]: r for r in rows(quality_rules.quality_rules(docs, carry=["doc_id", "text"]))}
    for r in made.values():
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = set()
        for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[w] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text[:80]
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_repeated_windows_by_sorting(docs, monkeypatch):
    plain = sorted((r["doc_id"] or 0, r["n_repeat_words"]) for r in rows(quality_rules.quality_rules(docs, carry=["doc_id"])))
    monkeypatch.setattr(quality_rules, "SEARCHED", 0)
    assert plain == sorted((r["doc_id"] or 0, r["n_repeat_words"]) for r in rows(quality_rules.quality_rules(docs, carry=["doc_id"])))


def test_quality_keeps_prose_and_rejects_symbols(spark):
    prose = "the house of the old king and a river in the green land that is for it was with stone " * 1
    clean = [(k, " ".join(f"{w}{'' if w in quality_rules.COMMON_WORDS['en'] else k * 7 + j}" for j, w in enumerate(prose.split() * 4)), "en") for k in range(30)]
    junk = (99, " ".join(f"{w.upper()}{j}%%%" for j, w in enumerate(prose.split() * 4)), "en")
    made = {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rules(spark.createDataFrame([*clean, junk], "doc_id int, text string, lang string")))}
    assert not made[99] and sum(made.values()) == 30


@pytest.mark.parametrize("given", ["en de", ""])
def test_quality_without_a_listed_language(spark, given):
    """Prose of a language stays without its lang, if few others are of it, and in a new language; symbols don't."""
    import random

    rng, new = random.Random(4), "il lo gli che di una per non con sono della nel".split()
    prose = lambda common: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeinrst", k=6)) for _ in range(300))
    spoken = {"en": quality_rules.COMMON_WORDS["en"], "de": quality_rules.COMMON_WORDS["de"], "it": new}
    texts = [(lang, lang if lang in given or lang == "it" and given else None) for lang, n in (("en", 40), ("de", 20), ("it", 3)) for _ in range(n)]
    texts += [("en", None)] * 20 + [("de", None)] * 3
    docs = [(k, prose(spoken[lang]), named) for k, (lang, named) in enumerate(texts)]
    junk = (999, " ".join(f"{w.upper()}{j}%%%" for j, w in enumerate(prose(new).split())), None)
    made = {r["doc_id"]: r for r in rows(quality_rules.quality_rules(spark.createDataFrame([*docs, junk], "doc_id int, text string, lang string")))}
    assert all(made[k]["kept"] for k, _, _ in docs)
    # Without any lang there is no reference of one language: the base rules decide.
    assert made[999]["kept"] == (not given) and (made[999]["char_distance"] is None) == (not given)


def jaccard_components(pairs, shingle=3, percent=90):
    sets, root = defaultdict(list), {}
    for i, text in pairs:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i].append({tuple(words[k : k + shingle]) for k in range(max(len(words) - shingle, 0) + 1)} if words else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(own[0]), find(i)) for i, own in sets.items()}


def test_words_are_hashed_at_once(monkeypatch):
    """Only words of more than LONG bytes are hashed one by one; equal words alone have equal hashes."""
    import pyarrow as pa
    import xxhash

    one_by_one, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: one_by_one.append(w) or real(w))
    rng = np.random.default_rng(6)
    words = ["", "a", "a\0", "\0a", "\0", "\0\0", *("x" * n for n in range(60, 70)), *(f"{k:x}" for k in range(3000))]
    words += ["".join(rng.choice(list("abé€"), n)) for n in rng.integers(1, 40, 3000)] * 2
    found = jaccard_join.word_hashes(pa.array(words, pa.large_string()))
    assert len(set(zip(words, found.tolist(), strict=True))) == len(set(words)) == len(set(found.tolist()))
    assert {len(w) > jaccard_join.LONG for w in one_by_one} == {True}
    assert np.array_equal(jaccard_join.word_hashes(pa.array(["no", *words], pa.large_string()).slice(1)), found)
    assert len(jaccard_join.word_hashes(pa.array([], pa.large_string()))) == 0


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, shingle, percent):
    made = rows(jaccard_join.jaccard_join(docs, shingle=shingle, percent=percent))
    want = jaccard_components(((r["doc_id"], r["text"]) for r in rows(docs) if r["doc_id"] is not None), shingle, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made if r["doc_id"] is not None} == want
    assert len(made) == docs.count() and all(r["component_id"] is None for r in made if r["doc_id"] is None)


def near_copies(seed, n, length, changes):
    """n texts, each a copy of an earlier one with some words changed."""
    import random

    rng = random.Random(seed)
    texts = [[f"w{k}" for k in range(length)]]
    while len(texts) < n:
        words = list(rng.choice(texts[-12:]))
        for _ in range(rng.choice(changes)):
            words[rng.randrange(length)] = f"x{rng.randrange(9999)}"
        texts.append(words)
    return [(k, " ".join(x)) for k, x in enumerate(texts)]


@pytest.mark.parametrize("sets, pivots, percent", [(1, 16, 90), (20, 8, 80)])
def test_jaccard_large_regions(spark, monkeypatch, sets, pivots, percent):
    """Regions too large for a task are parted by Spark jobs, as are those that pivots part badly."""
    texts = near_copies(5, 120, 120, [1, 2, 3, 6]) + [(1000 + k, x) for k, x in near_copies(6, 60, 40, [0, 1])]
    texts += [(2000, texts[0][1] + " and more"), (3, texts[150][1])]
    monkeypatch.setattr(jaccard_join, "REGION_SETS", sets)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    made = defaultdict(set)
    for r in rows(jaccard_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"), percent=percent)):
        made[r["doc_id"]].add(r["component_id"])
    assert made == {i: {c} for i, (_, c) in jaccard_components(texts, 3, percent).items()}


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_region_recursion(monkeypatch, percent):
    """Voronoi cells within a task: chains of near copies, and families of them."""
    rng, split = np.random.default_rng(2), []
    seen = jaccard_join.voronoi
    monkeypatch.setattr(jaccard_join, "voronoi", lambda d, r: split.append(d.shape) or seen(d, r))
    held = []
    for k in range(150):
        own = held[-6].copy() if k >= 6 else rng.integers(0, 1 << 40, 100, dtype=np.uint64)
        own[rng.integers(0, len(own), rng.integers(0, 14))] = rng.integers(0, 1 << 40, 1, dtype=np.uint64)
        held.append(np.unique(own))
    found = jaccard_join._Union(len(held))
    jaccard_join.join_region(jaccard_join._Sets(held), np.arange(len(held)), found, percent)
    want = jaccard_join._Union(len(held))
    for i in range(len(held)):
        for j in range(i):
            common = len(np.intersect1d(held[i], held[j]))
            if 100 * common >= percent * (len(held[i]) + len(held[j]) - common):
                want.join(i, j)
    assert [found.root(k) for k in range(150)] == [want.root(k) for k in range(150)] and len(split) > 3


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_share_a_cell(percent):
    """Also when all, or nearly all, of their shingles are hot, and when they are tiny."""
    rng = np.random.default_rng(percent)
    hot = rng.random(1 << jaccard_join.SLOT_BITS) < 0.5
    for n in [*range(1, 30), 60, 200, 700]:
        for share in (0.0, 0.5, 0.95, 1.0):
            pool = rng.integers(0, 1 << 63, 6 * n + 60, dtype=np.uint64)
            is_hot = hot[jaccard_join.slots(pool)]
            k = min(round(share * n), is_hot.sum())
            a = np.unique(np.concatenate([pool[is_hot][:k], pool[~is_hot][: n - k]]))
            keep = a[rng.permutation(len(a))[: -(-percent * len(a) // 100)]]
            for b in (np.sort(keep), np.sort(np.concatenate([keep, pool[-(100 * len(keep) // percent - len(a)) or len(pool) :]]))):
                b = np.unique(b)
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
                entry, cell = jaccard_join.cells_of(np.concatenate([a, b]), np.array([len(a), len(b)]), hot, percent)
                assert np.intersect1d(cell[entry == 0], cell[entry == 1]).size, (n, share, len(b))


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(101, 100), (103, 101), (102, 103), (5, 5), (200, 201)]
    made = {r["node"]: r["root"] for r in rows(jaccard_join.components(spark.createDataFrame(edges, "a long, b long")))}
    want = dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102, 103), 100) | dict.fromkeys((200, 201), 200)
    assert made == want


def test_mixing(docs):
    made = rows(mixing.mix_sources(docs))
    sizes = defaultdict(int)
    for r in rows(docs):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    assert len(made) == docs.count()
    assert sorted({round(r["target"], 6) for r in made}) == sorted({round(x, 6) for x in target.values()})
    by_target = defaultdict(int)
    for r in made:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        by_target[r["target"]] += r["taken"]
    largest = max(r["size"] for r in made)
    for t, taken in by_target.items():
        assert abs(taken - t) <= largest / 2, (t, taken)
    again = sorted(str(r) for r in rows(mixing.mix_sources(docs)))
    assert again == sorted(map(str, made))


def test_mix_of_many_sizes_meets_its_targets(spark):
    made = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sources = rows(made.groupBy("source_size", "target").agg({"taken": "sum"}))
    assert len(sources) > 10 and all(abs(r["sum(taken)"] - r["target"]) <= 0.002 * r["target"] for r in sources), sources


def test_bpe_round_trip(docs):
    path = tokenizer_file("word_bpe_49k.json")
    tok = bpe.tokenizer(path)
    odd = docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    for table in (docs, odd):
        texts = Counter(r["text"] for r in rows(table))
        made = rows(bpe.bpe_round_trip(table, path))
        want = Counter()
        for text, n in texts.items():
            ids = tok.encode(text or "", add_special_tokens=False).ids
            decoded = tok.decode(ids, skip_special_tokens=False)
            want[(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += n
        assert Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in made) == want
    full = {r["n_tokens"]: r for r in rows(bpe.bpe_round_trip(odd, path, digests=False))}
    assert all(len(r["ids"]) == n for n, r in full.items())


ODD = [
    "it's 'sting don't 12ab34 a1b2 x_y-z", "é ́a  b c \x1cd \x85e", "  lead  and trail  ", "\n\n a \n b\t\tc ", "日本語テキスト 中文", "İstanbul ΣΑΣ ſt",
    "<|startoftext|>x <|endoftext|> y<|endoftext|>", "👩‍👩‍👧 emoji!!! ...", "a b 　 c", "x    y", "tail ", " ", " ", "''' 's's", "﻿bom \x00nul \x1f",
]


def test_token_files(docs):
    path = tokenizer_file("byte_bpe_50k.json")
    tok = token_files.tokenizer(path)
    odd = docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    for table in (docs, odd):
        source = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in rows(table)))
        made = sorted(((r["doc_id"] is not None, r["start"], r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows(token_files.token_files(table, path))))
        ids = defaultdict(list)
        for _, i, text in source:
            ids[i].append(np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4"))
        at = 0
        assert [r[2] for r in made] == [r[1] for r in source]
        for _, start, i, n, crc in made:
            assert start == at and (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in ids[i]}
            at += n


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(4)
    for n in (0, 1, 255, 256, 257, 16_384, 50_001):
        tokens = np.minimum(rng.geometric(0.01, n), 5000).astype(np.int64)
        coder = token_files.Coder(token_files.frequencies(np.bincount(tokens, minlength=5001)))
        data = coder.encode(tokens)
        assert np.array_equal(coder.decode(data), tokens)
        if n > 16:
            broken = bytearray(data)
            broken[-1] ^= 1
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))


def _counted(text, lines, path, rule):
    """Tokens by line, byte by byte."""
    found = token_counts.encoding(path)[0]
    line_of, counts, at = [k for k, line in enumerate(lines) for _ in line.encode()], [0] * len(lines), 0
    for token in found.encode(text, disallowed_special=()):
        met = line_of[at : at + len(found.decode_single_token_bytes(token))]
        at += len(met)
        counts[{"first": met[0], "last": met[-1], "most": max(sorted(set(met)), key=met.count)}[rule]] += 1
    assert at == len(line_of)
    return counts


def test_section_tokens(docs, spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    for rule in token_counts.RULES:
        made = defaultdict(list)
        one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        for r in rows(token_counts.section_tokens(one, path, rule=rule)):
            made[r["doc_id"]].append((r["section"], r["start_char"], r["end_char"], r["n_tokens"]))
        for r in rows(one):
            text = r["text"] or ""
            found, lines = sorted(made[r["doc_id"]]), text.splitlines(keepends=True) if "\x0b" not in text else [text]
            assert [text[a:b] for _, a, b, _ in found] == (lines or [""])
            assert [x[3] for x in found] == _counted(text, lines or [""], path, rule)
    two = spark.createDataFrame([(1, "ab", "cd"), (2, None, "é x"), (3, "", None)], "doc_id int, p string, q string")
    found = sorted((r["doc_id"], r["section"], r["n_tokens"], r["end_char"]) for r in rows(token_counts.section_tokens(two, path, ["p", "q"])))
    assert [(a, b, d) for a, b, _, d in found] == [(1, 0, 2), (1, 1, 4), (2, 0, 0), (2, 1, 3), (3, 0, 0), (3, 1, 0)]


def test_boundary_rules():
    ends, bounds = np.array([2, 7, 9]), np.array([3, 9])
    assert [token_counts.allotted(ends, bounds, r).tolist() for r in token_counts.RULES] == [[0, 0, 1], [0, 1, 1], [0, 1, 1]]


def test_language_id(docs, spark):
    made = rows(language_id.language_id(docs))
    assert len(made) == docs.count()
    for r in made:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("und", "en", "de", "xx")
    words = {"en": "the and with that house which", "fr": "les une dans pour avec maison", "de": "der und nicht haus einen sich"}
    import random

    rng = random.Random(1)
    text = [(k, " ".join(rng.choices(words[x].split(), k=30)), x) for k, x in enumerate(sorted(words) * 40)]
    found = rows(language_id.language_id(spark.createDataFrame(text, "doc_id long, text string, lang string")))
    assert all(r["lang_pred"] == sorted(words)[r["doc_id"] % 3] for r in found if r["held_out"])


def test_language_predictions_by_hand(docs, spark):
    """Prototypes as sums over the learned rows and cosines, word for word, for documents of mixed languages and odd ones."""
    import random

    rng, words = random.Random(9), {"en": "the and with that house which", "fr": "les une dans pour avec maison", "de": "der und nicht haus einen sich"}
    mixed = [(500 + k, " ".join(rng.choices((words[a] + " " + words[b]).split(), k=25)), rng.choice([a, a, a, None]), "x") for k, (a, b) in enumerate([(a, b) for a in words for b in words] * 5)]
    given = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string"))
    known = rows(given)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    letters = lambda t: bool(t) and any(c.isalpha() for c in t)
    model = defaultdict(lambda: [0] * 1024)
    for r in known:
        if fold(r["doc_id"]) and r["lang"] is not None and letters(r["text"]):
            model[r["lang"]] = [a + int(b) for a, b in zip(model[r["lang"]], language_id.bundle(r["text"]), strict=True)]
    want = Counter()
    for r in known:
        best = ("und", 0.0)
        if letters(r["text"]):
            v = [int(x) for x in language_id.bundle(r["text"])]
            norm = math.sqrt(sum(x * x for x in v))
            cosine = {x: sum(a * b for a, b in zip(v, m, strict=True)) / (norm * math.sqrt(sum(a * a for a in m))) for x, m in model.items()}
            best = min(cosine.items(), key=lambda c: (-round(c[1], 5), c[0]))
        want[r["doc_id"], not fold(r["doc_id"]), best[0], round(max(best[1], 0), 3)] += 1
    made = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in rows(language_id.language_id(given)))
    assert made == want


def test_bundle_is_sum_of_bound_vectors():
    letters = " ab \U00010428 а х "
    v = language_id.letter_vectors(np.array([0 if c == " " else ord(c) for c in letters])).astype(int)
    want = sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:], strict=False))
    assert np.array_equal(language_id.bundle("ab--\U00010428, А  х"), want)
    # Unlike letters, of any script, have nearly orthogonal vectors.
    some = language_id.letter_vectors(np.array([0x61, 0x430, 0x445, 0x10428, 0x65E5])).astype(int)
    assert np.abs(some @ some.T - 1024 * np.eye(5)).max() < 180


def test_remembered_grams_start_anew(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    want = language_id.bundle(text)
    monkeypatch.setattr(language_id, "REMEMBERED", 5)
    monkeypatch.setattr(language_id, "BLOCK", 4)
    assert np.array_equal(language_id.bundle(text), want) and np.array_equal(language_id.bundle(text), want)


def test_language_id_on_documents(spark):
    """Accuracy on the held-out fold of the given documents, and of scripts that differ in letters alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert made.count() > 150 and made.where("lang_pred = lang").count() >= 0.98 * made.count()
    import random

    rng = random.Random(5)
    letters = {"aa": "абвгде", "bb": "абвгжз", "cc": "".join(map(chr, range(0x10428, 0x1042E)))}
    text = [(k, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(40)), x) for k, x in enumerate(sorted(letters) * 60)]
    found = rows(language_id.language_id(spark.createDataFrame(text, "doc_id long, text string, lang string")))
    assert all(r["lang_pred"] == sorted(letters)[r["doc_id"] % 3] for r in found if r["held_out"])


def test_license_scan(spark):
    mit = next(t for t in license_scan.KNOWN["MIT"] if len(t) > 500)
    texts = [
        mit, "Copyright (c) 2020 A B\n\n" + mit.upper().replace("SUBLICENSE", "sublicence"), "prose\nReleased under the MIT licence!\nmore\nreleased under the mit license",
        None, "", "Copyright 2020 only", "nothing here",
    ]
    made = {r["doc_id"]: (r["text_license"], r["line_licenses"], r["n_license_lines"]) for r in rows(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))}
    assert made == {0: ("MIT", [], 0), 1: ("MIT", [], 0), 2: (None, ["MIT"], 2), 3: (None, [], 0), 4: (None, [], 0), 5: (None, [], 0), 6: (None, [], 0)}


def test_licenses_within_documents(spark):
    """Entire texts between prose, re-wrapped, with other years, spelling and case; cut ones aren't found. Nulls, repeated
    rows and clashing columns."""
    import textwrap

    cases = []
    for name, texts in license_scan.KNOWN.items():
        for text in (x for x in texts if len(x) > 500):
            for width in (64, 90, 10_000):
                body = "\n".join(textwrap.wrap(" ".join(text.split()).upper(), width)).replace("LICENSE", "LICENCE")
                cases.append((f"Some prose first.\n\nCopyright (c) {1990 + width % 30} A B\n\n{body}\n\nand prose after it.", name))
            cases.append(("Prose.\n" + text[: len(text) // 2] + "\nmore", None))
    two = next(t for t in license_scan.KNOWN["MIT"] if len(t) > 500)
    cases.append((f"a\n{two}\nb\n{two}\nc", "MIT"))
    data = [(k, t, "x", 1) for k, (t, _) in enumerate(cases)] + [(None, cases[0][0], "x", 1), (0, cases[0][0], "x", 1), (5000, None, None, None)]
    made = rows(license_scan.license_scan(spark.createDataFrame(data, "doc_id int, text string, kind string, row int")))
    assert len(made) == len(data)
    found = {r["doc_id"]: r["part_licenses"] for r in made}
    assert all((name in found[k]) if name else not found[k] for k, (_, name) in enumerate(cases)), [(c[1], found[k]) for k, c in enumerate(cases)]
    assert found[5000] == [] and cases[0][1] in found[None] and all(r["text_license"] is None for r in made)


def test_license_texts_in_their_usual_forms(spark):
    """Each entire text wrapped anew, behind comment marks and below a title, and copyright notices."""
    import textwrap

    titles = {"MIT": "MIT License", "ISC": "ISC License (ISC)", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License', "Unlicense": "The Unlicense"}
    cases = []
    for name, texts in license_scan.KNOWN.items():
        for text in (x for x in texts if len(x) > 500):
            flat = " ".join(text.split())
            forms = [text, flat, flat.replace("https:", "http:"), *("\n".join(textwrap.wrap(flat, n)) for n in (60, 66, 72, 78, 100))]
            forms += ["Copyright (c) 2020 A B\n" + text, "© 2021-2022 A B <a@b.c>\nCopyright Ada Byron\n(C) Copyright 2019 by C\nAll rights reserved.\n\n" + flat]
            noted = ["Copyright (c) 2020 A B. All rights reserved.", *textwrap.wrap(flat, 70)]
            forms += ["\n".join(f"{mark} {x}" for x in noted) for mark in ("#", "//", " *")]
            if name in titles:
                forms += [f"{titles[name]}\n\nCopyright (c) 2020 A B\n\n{text}", f"{titles[name]} {flat}"]
            cases += [(len(cases) + k, x, name) for k, x in enumerate(forms)]
    assert {"MIT", "ISC", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense"} == {name for *_, name in cases}
    made = {r["doc_id"]: r["text_license"] for r in rows(license_scan.license_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id int, text string")))}
    assert [(name, x[:90]) for k, x, name in cases if made[k] != name] == []


PAGE = """<html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First <b>bold</b>&nbsp;text<br>goes
 on here with many words to read.<p>Short.<ul><li>one<li>two</ul><aside>See also</aside><div class="ad">Buy</div>
<section id="comments"><article class="comment"><p>A reader says a lot of words here, more than the article does itself.</p></article></section></article>
<form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "A & B\n\nFirst bold text goes on here with many words to read.\n\nShort.\n\none\n\ntwo"
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>un<b>closed"), (5, "u", "<!-- only -->"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "plain &lt;text&gt;"), (8, "u", PAGE), (None, "u", "<p>" + "long " * 50_000)]
    made = rows(html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")))
    got = {r["page_id"]: r["text"] for r in made}
    assert got[1] == got[8] == want
    assert (got[2], got[3], got[4], got[5], got[6], got[7]) == ("", "", "unclosed", "", "deep", "plain <text>")
    assert got[None] == ("long " * 50_000).strip() and all(r["n_chars"] == len(r["text"]) for r in made)


#: Pages whose markup misleads, and their articles as read by eye.
LONG = "A paragraph of the article that is long enough to be told from menus, with some words more to spare. "
ODD_PAGES = [
    (f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="search-algorithms">Search</h2><p id="share">{LONG}</p></article>', ["Related work", LONG, "Search", LONG]),
    (f'<body><article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article></body>', ["Title", LONG]),
    (f'<body><nav><a href=1>One</a><a href=2>Two</a><div class=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>', ["Head", LONG, LONG]),
    (f"<body><main><article><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article></main></body>", [LONG, "Two", LONG]),
    (f'<article><p>{LONG}</p><div class="notice">Old page.</div><div class="related"><a href=1>More</a></div><p>End.</p></article>', [LONG, "End."]),
    (f'<article><p>Short.</p><div class="alert"><p>{LONG * 6}</p></div><p>{LONG}</p></article>', ["Short.", LONG * 6, LONG]),
    (f'<body><header><p>{LONG}</p></header><div><p>{LONG * 2}</p><p>{LONG}</p></div><aside><p>{LONG}</p></aside></body>', [LONG * 2, LONG]),
    (f'<article><p>{LONG}</p></article><section class="comments"><article class="comment"><p>{LONG * 9}</p></article></section>', [LONG]),
]


ODD_PAGES += [
    # Boilerplate goes however long it is, beside and within the article.
    (f"<article><p>Short one.</p><aside><p>{LONG * 4}</p></aside><div class=sidebar>{LONG * 4}</div><p>Short two.</p></article>", ["Short one.", "Short two."]),
    (f'<body><div class=content><p>{LONG}</p><p>{LONG}</p></div><div class="advert">{LONG * 9}</div></body>', [LONG, LONG]),
    (f"<main><div class=menu><a href=1>One</a><a href=2>Two</a></div><p>{LONG}</p></main>", [LONG]),
    (f"<main><header>Site name banner</header><p>{LONG}</p></main>", [LONG]),
    (f"<main><header><h1>Title</h1><p>Lead.</p></header><p>{LONG}</p></main>", ["Title", "Lead.", LONG]),
    (f"<article><h1>T</h1><div class=toolbar>Print Mail</div><p>{LONG}</p></article>", ["T", LONG]),
    # An id names the subject as often as the box.
    (f'<article><section id="comments-on-method"><p>{LONG}</p></section><div id="navigation-systems"><p>{LONG}</p></div><div id="newsletter-history">{LONG}</div></article>', [LONG] * 3),
    (f'<body><div class="post has-sidebar no-ads"><p>{LONG}</p></div><div id="leftSidebar"><p>{LONG}</p></div><div id="comments-list"><p>{LONG}</p></div></body>', [LONG]),
    (f"<body><button>Menu<article><p>{LONG}</p><button><p>Send</p></article></body>", [LONG, "Send"]),
    (f"<article><p>{LONG}</p><button><p>Send</p></button></article>", [LONG]),
    # Of nested containers with equal votes the innermost one counts; side by side both do.
    (f"<body><div><div><p>{LONG}</p></div></div><table><tr><td>x</td></tr></table></body>", [LONG]),
    (f"<body><div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>", [LONG, LONG]),
]


@pytest.mark.parametrize("page, want", ODD_PAGES)
def test_main_text_of_odd_pages(page, want):
    assert html_text.main_text(page) == "\n\n".join(x.strip() for x in want)


def test_ratios_decide(monkeypatch):
    """The threshold takes part in the result, within articles too, and smoothing is the plain weighted mean."""
    page = ODD_PAGES[4][0]
    usual = html_text.main_text(page)
    monkeypatch.setattr(html_text, "THRESHOLD", 0.0)
    assert "Old page." in html_text.main_text(page) and "Old page." not in usual
    monkeypatch.setattr(html_text, "THRESHOLD", 9.0)
    assert LONG * 6 not in html_text.main_text(ODD_PAGES[5][0])
    ratios = np.array([3.0, 90.0, 0.0, 7.0, 41.0, 5.0])
    for k, found in enumerate(html_text.smoothed(ratios)):
        near = {j: math.exp(-0.5 * (j - k) ** 2) for j in range(max(0, k - 2), min(5, k + 2) + 1)}
        assert found == pytest.approx(sum(w * ratios[j] for j, w in near.items()) / sum(near.values()))


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "x", 5), (1, None, PAGE, "x", 5), (None, "u", None, None, None)], "page_id int, url string, html string, text string, n_chars long")
    made = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in rows(html_text.extract_text(pages)))
    assert made[0] == (0, "u", 0) and made[1] == made[2] and made[1][2] > 50


def test_main_text_without_article():
    page = "<body><div id=page><div class=content><h2>Head</h2><div><p>Long paragraph of text that is the content of it all.<p>Short.</div></div><div><a href=1>link</a> <a href=2>link two</a></div></div>"
    assert html_text.main_text(page) == "Head\n\nLong paragraph of text that is the content of it all.\n\nShort."


def test_empty_tables(empty, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [
        html_text.extract_text(pages), exact_dedup.exact_dedup(empty), quality_rules.quality_rules(empty), license_scan.license_scan(empty),
        token_counts.section_tokens(empty, tokenizer_file("byte_bpe_50k.tiktoken")), token_files.token_files(empty, tokenizer_file("byte_bpe_50k.json")),
        jaccard_join.jaccard_join(empty), language_id.language_id(empty), mixing.mix_sources(empty), bpe.bpe_round_trip(empty, tokenizer_file("word_bpe_49k.json")),
    ]
    assert [df.count() for df in made] == [0] * 10
    assert math.isfinite(sum(len(df.columns) for df in made))
