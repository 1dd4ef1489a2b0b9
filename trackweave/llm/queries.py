"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import cross_alignment
from .bpe import bpe_round_trip
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .language_id import language_id
from .license_scan import license_scan
from .mixing import mix_sources
from .quality_rules import quality_rules
from .sentence_pieces import sentencepiece_round_trip
from .spelling import spelling_variants
from .token_counts import section_tokens
from .token_files import token_files


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.withColumns({c: F.round(c, 4) for c in ("char_distance", "word_distance")})


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("line_licenses", "part_licenses")})


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OPERATORS = [
    op1_extract_text,
    op2_exact_dedup,
    op3_quality_rules,
    op4_license_scan,
    op5_section_tokens,
    op6_token_files,
    op7_jaccard_join,
    op8_language_id,
    op9_mix_sources,
    op10_bpe_round_trip,
    op11_align_tokenizers,
    op12_sentencepiece,
    op13_spelling_variants,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def quality_sql() -> str:
    """Operator 3 in SQL, from the same constants."""
    from . import quality_rules as q

    common = sorted(set().union(*q.COMMON_WORDS.values()))
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    slots = " ".join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in q.COMMON_WORDS.items())
    classes = [c.replace("\\u0080-\\uFFFF", r"\x{80}-\x{FFFF}") for c in q.CHAR_CLASSES]
    n_class = [f"length(o) - length(regexp_replace(o, '[{c}]+', '', 'g'))" for c in classes]
    chars = ", ".join([*n_class, f"length(o) - ({' + '.join(n_class)})", "word_chars - length(o)"])
    return rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    e AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '') AS j, length(array_to_string(w, '')) AS word_chars,
      regexp_replace(array_to_string(w, ''), '[a-z]+', '', 'g') AS o, CASE lang {slots} ELSE [{quoted(common)}] END AS slots,
      CASE WHEN lang IN ({quoted(q.COMMON_WORDS)}) THEN lang ELSE '' END AS ref_lang,
      list_filter(string_split(coalesce(t, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM e, unnest(range(1, len(w) - 1)) AS u(i)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
    f AS (SELECT e.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM e LEFT JOIN cov ON cov.doc_id = e.doc_id),
    counted AS (SELECT doc_id, n_words, word_chars, ref_lang, [{chars}] AS c, list_transform(slots, lambda s: len(list_filter(w, lambda x: x = s))) AS k FROM e),
    shares AS (SELECT doc_id, n_words, ref_lang, list_transform(c, lambda x: CAST(floor(x * {q.UNIT} / greatest(word_chars, 1)) AS BIGINT)) AS a,
      list_transform(list_append(k, n_words - list_sum(k)), lambda x: CAST(floor(x * {q.UNIT} / greatest(n_words, 1)) AS BIGINT)) AS b FROM counted WHERE n_words >= {q.MIN_WORDS_COMPARED}),
    cells AS (SELECT doc_id, n_words, ref_lang, 0 AS kind, i, a[i] AS share FROM shares, unnest(range(1, len(a) + 1)) AS u(i)
      UNION ALL SELECT doc_id, n_words, ref_lang, 1, i, b[i] FROM shares, unnest(range(1, len(b) + 1)) AS u(i)),
    refs AS (SELECT ref_lang, kind, i, sum(share) / count(*) / {q.UNIT} AS r FROM cells GROUP BY 1, 2, 3),
    terms AS (SELECT doc_id, kind, share / {q.UNIT} AS p, r, (share / {q.UNIT} + r) / 2 AS m FROM cells JOIN refs USING (ref_lang, kind, i)),
    js AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / m) ELSE 0 END) / 2, 0)) AS js FROM terms GROUP BY 1, 2),
    g AS (SELECT f.*, a.js AS cd, b.js AS wd, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
      LEFT JOIN js a ON a.doc_id = f.doc_id AND a.kind = 0 LEFT JOIN js b ON b.doc_id = f.doc_id AND b.kind = 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 4) AS char_distance, round(wd, 4) AS word_distance,
      NOT base_failed AND coalesce(cd <= {q.CHAR_LIMIT} + {q.CHAR_SLACK} / sqrt(greatest(n_words, 1)), TRUE) AND coalesce(wd <= {q.WORD_LIMIT} + {q.WORD_SLACK} / sqrt(greatest(n_words, 1)), TRUE) AS kept FROM g"""


ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op3_quality_rules": quality_sql(),
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        n AS MATERIALIZED (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
        sets AS (SELECT list_sort(s) AS s, n_shingles AS n, min(doc_id) AS id FROM n WHERE n_shingles > 0 GROUP BY ALL),
        e AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM sets),
        links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        turned AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT id, id AS near FROM sets UNION SELECT r.id, b.b FROM reach r JOIN turned b ON b.a = r.near),
        comp AS (SELECT id, min(near) AS component_id FROM reach GROUP BY 1),
        named AS (SELECT list_sort(s) AS s, component_id FROM sets JOIN comp USING (id))
        SELECT doc_id, n_shingles, coalesce(component_id, doc_id) AS component_id FROM n LEFT JOIN named ON list_sort(n.s) = named.s AND n.n_shingles > 0""",
    "op13_spelling_variants": r"""
        WITH RECURSIVE table_ AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
        r AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
        b AS (SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM r),
        h AS (SELECT run, k, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, table_),
        d AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
        s AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS s FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM s a JOIN s b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
          UNION SELECT s.word, w.word, w.n FROM s JOIN w ON s.s = w.word UNION SELECT w.word, s.word, s.n FROM s JOIN w ON s.s = w.word),
        best AS (SELECT word, count(*) AS n_near, max(other_n) AS m, arg_min(other, {'n': -other_n, 'w': encode(other)}) AS other FROM near GROUP BY 1),
        f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
        chain AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
        last AS (SELECT chain.word, root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
        SELECT f.word, form, coalesce(root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN last ON last.word = f.word""",
}
