"""The pipeline against a plain version of its first stages, and what holds for the others."""

import hashlib
from collections import Counter

import corpus_pipeline
from trackweave.llm import bpe
from trackweave.llm.common import written
from trackweave.llm.mixing import mix_sources
from trackweave.llm.queries import tokenizer_file

from .test_operators import SPACE, WORD, jaccard_components, rows


def test_stages(docs):
    spark = docs.sparkSession
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, made = kept.get("docs", docs), written(stage(spark, kept.get("docs", docs), ""), "stage")
        assert made.columns == docs.columns
        texts = [(r["doc_id"], r["text"] or "") for r in rows(made)]
        given = [(r["doc_id"], r["text"] or "") for r in rows(before)]
        assert {i for i, _ in texts} <= {i for i, _ in given}
        if name == "quality rules":
            assert all(len(WORD.findall(t)) >= 50 for _, t in texts) and len(texts) > 5
        if name == "exact dedup":
            groups = {}
            for i, t in given:
                t = SPACE.sub(" ", t)
                groups[t] = i if groups.get(t) is None or i is not None and i < groups[t] else groups[t]
            assert sorted(map(str, groups.values())) == sorted(str(i) for i, _ in texts)
        if name == "Jaccard join":
            roots = jaccard_components([x for x in given if x[0] is not None], 5, 80)
            assert {i for i, _ in texts if i is not None} == {i for i, (_, r) in roots.items() if i == r}
        if name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in rows(mix_sources(before)) if r["doc_id"] is not None}
            found = Counter(i for i, _ in texts if i is not None)
            assert all(found[i] == n for i, n in want.items())
        kept["docs"] = made
    last = rows(corpus_pipeline.STAGES[-1][1](spark, kept["docs"], ""))
    tok = bpe.tokenizer(tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for r in rows(kept["docs"]):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in last) == want


def test_stages_carry_any_column(spark):
    """Columns with the names that stages use, and a map, come through; repeated rows count as they do without them."""
    text = lambda k, n=120: " ".join(w if j % 2 else f"{w}{k}v{j}" for j, w in enumerate("house the river of stone and".split() * (n // 6)))
    given = [(k, text(k), "en", "ab"[k % 2]) for k in range(12)] + [(3, text(3), "en", "b"), (30, text(4), "en", "a"), (None, text(99), None, None), (31, None, "en", "a")]
    names = "dotted.name ref_lang _text kept n_words text_sha256 _copies _copy caller id digest copies count component_id _refs ref_char row lang2"
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names.split()) + ", m map<string,int>"
    docs = spark.createDataFrame([(*r, *(f"{c} {k}" for c in names.split()), {"k": k}) for k, r in enumerate(given)], schema)
    plain = docs.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = (written(stage(spark, x, ""), "stage") for x in (docs, plain))
        assert Counter(docs.select(plain.columns).collect()) == Counter(plain.collect()) and plain.count()
        for r in docs.collect():
            assert {r[c] for c in names.split()} == {f"{c} {r['m']['k']}" for c in names.split()} and given[r["m"]["k"]][:2] == (r["doc_id"], r["text"])
    assert docs.columns == [x.split()[0].strip("`") for x in schema.split(", ")]


def test_run_on_an_empty_table(empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(empty.sparkSession, str(tmp_path)).count() == 0


def corpus():
    """(doc_id, text, lang, source, n_chars): prose, copies and near copies, one id on two texts, rows repeated, junk."""
    import random

    rng, common = random.Random(8), "the of and to in is that for it was with as on be at by".split()
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9))) for _ in range(n)]
    made, sources = [], ["a", "b", None]
    for k in range(30):
        made.append((k + 1, " ".join(prose(60 + 7 * k)), sources[k % 3]))
    for k in range(6):
        words = made[k][1].split()
        made.append((40 + k, "\n ".join(words), "b"))
        for j in rng.sample(range(len(words)), 1 if k % 2 else 30):
            words[j] = "new"
        made.append((50 + k, " ".join(words), "a"))
    made += [(7, " ".join(prose(90)), "b"), (60, made[6][1], "a"), (61, "", "a"), (62, None, "b"), (63, "short " * 9, None)]
    made += [(64, " ".join(f"{w.upper()}{j}%%%" for j, w in enumerate(prose(80))), "a"), (65, " ".join(prose(9_000)), "a")]
    return [(i, t, "en", s, None) for i, t, s in made] + [(2, made[1][1], "en", "b", None)] * 2


def test_run(spark, tmp_path):
    import duckdb

    from trackweave.llm.queries import quality_sql

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    given = corpus()
    spark.createDataFrame(given, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    # Numbers in place of ids, as an id may stand on two texts.
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, r[1], r[2]) for k, r in enumerate(given)])
    judged = dict(db.sql(f"SELECT doc_id, kept FROM ({quality_sql()})").fetchall())
    left = [r for k, r in enumerate(given) if judged[k]]
    assert {64, 61, 62, 63}.isdisjoint(r[0] for r in left) and 65 in {r[0] for r in left} and len(left) > 35
    groups = {}
    for r in sorted(left, key=lambda r: (r[0], r[3] is not None, r[3] or "")):
        groups.setdefault(SPACE.sub(" ", r[1]), r)
    left = list(groups.values())
    assert 7 in (r[0] for r in left) and len(left) == len({r[1] for r in left})
    roots = jaccard_components([(r[0], r[1]) for r in left], 5, 80)
    left = [r for r in left if roots[r[0]][1] == r[0]]
    assert {51, 53, 55}.isdisjoint(r[0] for r in left) and {50, 52, 54} & {r[0] for r in left}
    copies = {}
    for r in rows(mix_sources(spark.createDataFrame(left, schema))):
        copies[r["doc_id"]] = max(r["copies"], copies.get(r["doc_id"], 0))
    tok, want = bpe.tokenizer(tokenizer_file("word_bpe_49k.json")), Counter()
    for r in left:
        ids = tok.encode(r[1], add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
        want[(r[0], len(ids), *digests)] += copies[r[0]]
    made = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(corpus_pipeline.run(spark, str(tmp_path))))
    assert made == +want
