"""Operator 3: quality rules, in DataFrame functions only.

A document is compared with a reference of its language by two histograms: classes of characters, and common words.
The references are the mean histograms over all documents of a language that are long enough, so they follow the
corpus; what differs from them by more than a Jensen-Shannon distance is rejected. A document whose language has no list
of common words, or isn't given, is held against the references of several languages, and the nearest counts. Documents
below a minimum length are never judged by histograms, as short samples stray far by chance. Rules on length and
repetition come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

#: Frequent function words of the languages that have a reference.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was with".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un une du que pour".split(),
    "es": "de la que el en y a los se del las un".split(),
}
#: Classes of characters, as the inside of a regular expression's bracket; what is in none of them, and
#: then a-z, are two more.
CHAR_CLASSES = ["A-Z", "0-9", ".,;:!?", "#*$%&|<>", "\\u0080-\\uFFFF"]

#: Where CHAR_CLASSES has the symbols of the contract.
SYMBOL_CLASS = 3
#: Repeated windows up to which their places are found by search.
SEARCHED = 64

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words below which histograms don't decide.
MIN_WORDS_COMPARED = 50
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected: a limit for long documents, and what is
#: added to it over the root of the number of words, as chance moves the histograms of short ones.
CHAR_LIMIT, CHAR_SLACK = 0.2, 0.4
WORD_LIMIT, WORD_SLACK = 0.18, 1.05
#: Histogram shares are held as whole millionths, so sums don't depend on the order of rows.
UNIT = 1_000_000


def _millionths(count: Column, total: Column) -> Column:
    return F.floor(count.cast("bigint") * F.lit(UNIT).cast("bigint") / F.greatest(total, F.lit(1))).cast("bigint")


def _listed(lang: Column) -> Column:
    return F.coalesce(lang.isin(list(COMMON_WORDS)), F.lit(False))


def _shares(counts: Column, n_words: Column) -> Column:
    """Counts of common words, and the other words, as millionths."""
    rest = n_words - F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    return F.transform(F.concat(counts, F.array(rest.cast("int"))), lambda c: _millionths(c, n_words))


def _n_chars(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def with_histograms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with _text, _words, _n_words, _word_chars, _others (the characters other than a-z), and the histograms
    _char_hist and _word_hist.

    Where a language has no list of common words, those of all languages count together.
    """
    common = sorted(set().union(*COMMON_WORDS.values()))
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_words", words(F.col("_text")))
    out = out.withColumns({"_n_words": F.size("_words").cast("bigint"), "_joined": F.array_join("_words", "")})
    out = out.withColumns(
        {
            "_word_chars": F.char_length("_joined").cast("bigint"),
            "_others": F.regexp_replace("_joined", "[a-z]+", ""),
            "_known": F.filter("_words", lambda w: w.isin(common)),
        }
    )
    slots = F.lit(None)
    for lang, listed in COMMON_WORDS.items():
        slots = F.when(F.col(lang_col) == lang, F.array(*map(F.lit, listed))).otherwise(slots)
    slots = F.coalesce(slots, F.array(*map(F.lit, common)))
    counts = F.transform(slots, lambda s: F.size(F.filter("_known", lambda w: w == s)))
    # The second use of _known keeps Spark from computing it anew for each slot.
    counts = F.when(F.size("_known") == 0, F.transform(slots, lambda _: F.lit(0))).otherwise(counts)
    out = out.withColumn("_word_counts", counts)
    chars = [_n_chars(F.col("_others"), f"[{c}]+").cast("bigint") for c in CHAR_CLASSES]
    chars.append(F.char_length("_others").cast("bigint") - reduce(lambda a, b: a + b, chars))
    chars.append(F.col("_word_chars") - F.char_length("_others"))
    out = out.withColumn("_char_counts", F.array(*chars))
    return out.withColumns(
        {"_word_hist": _shares(F.col("_word_counts"), F.col("_n_words")), "_char_hist": F.transform("_char_counts", lambda c: _millionths(c, F.col("_word_chars")))}
    )


def references(hists: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(ref_lang, ref_char, ref_word): mean histograms of each language that is given, listed or not; none of null."""
    long = hists.where((F.col("_n_words") >= MIN_WORDS_COMPARED) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("ref_lang"), F.posexplode(F.concat("_char_hist", "_word_hist")).alias("slot", "share")
    )
    sums = long.groupBy("ref_lang", "slot").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("docs"))
    mean = sums.select("ref_lang", "slot", (F.col("share") / F.col("docs") / UNIT).alias("share"))
    n = len(CHAR_CLASSES) + 2
    cells = F.transform(F.array_sort(F.collect_list(F.struct("slot", "share"))), lambda x: x["share"])
    return (
        mean.groupBy("ref_lang")
        .agg(cells.alias("cells"))
        .select("ref_lang", F.slice("cells", 1, n).alias("ref_char"), F.slice("cells", n + 1, 1000).alias("ref_word"))
    )


def _slots() -> Column:
    """Where the words of ref_lang's histogram stand among all common words."""
    common = sorted(set().union(*COMMON_WORDS.values()))
    at = F.array(*(F.lit(k) for k in range(len(common))))
    for lang, own in COMMON_WORDS.items():
        at = F.when(F.col("ref_lang") == lang, F.array(*(F.lit(common.index(w)) for w in own))).otherwise(at)
    return at


def _limit(limit: float, slack: float) -> Column:
    return limit + slack / F.sqrt(F.greatest(F.col("_n_words"), F.lit(1)))


def nearest(refs: Column) -> Column:
    """(excess, ref_lang, char_distance, word_distance) of the nearest of refs to a document without a listed language.

    Nearest is where the larger of the two distances, each over its limit, is smallest; null without any reference.
    """

    def held(ref: Column) -> Column:
        # The document's counts are of all common words; a listed reference has those of its language.
        counts = F.transform(ref["ref_at"], lambda k: F.get("_word_counts", k))
        char = js_distance(F.col("_char_hist"), ref["ref_char"])
        word = js_distance(_shares(counts, F.col("_n_words")), ref["ref_word"])
        return F.struct(char.alias("char_distance"), word.alias("word_distance"), ref["ref_lang"].alias("ref_lang"))

    def ranked(x: Column) -> Column:
        excess = F.greatest(x["char_distance"] / _limit(CHAR_LIMIT, CHAR_SLACK), x["word_distance"] / _limit(WORD_LIMIT, WORD_SLACK))
        return F.struct(excess.alias("excess"), *(x[c].alias(c) for c in ("ref_lang", "char_distance", "word_distance")))

    return F.array_min(F.transform(F.transform(refs, held), ranked))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram in millionths and one in shares, of one length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    term = lambda a, b: part(a / UNIT, (a / UNIT + b) / 2) + part(b, (a / UNIT + b) / 2)
    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def with_base_features(hists: DataFrame) -> DataFrame:
    """Adds n_symbols, n_dup_lines and n_repeat_words.

    n_repeat_words counts the words that lie in at least one 3-word window that the text holds twice or more. Windows
    are compared by 64-bit hashes within their document.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = hists.withColumn("_lines", lines)
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_hashes", F.slice(hashes, 1, F.greatest(F.size("_words") - 2, F.lit(0))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array("_hashes")))
    twice = F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get("_sorted", i + 1)))
    out = out.withColumn("_twice", F.when(F.size("_sorted") > 0, twice))
    out = out.withColumn("_again", F.when(F.size("_twice") > 0, _positions()))
    gaps = F.transform("_again", lambda p, i: F.least(F.coalesce(F.get("_again", i + 1) - p, F.lit(3)), F.lit(3)))
    repeated = F.aggregate(F.when(F.size("_again") > 0, gaps), F.lit(0), lambda a, b: a + b)
    return out.withColumns(
        {
            "n_symbols": F.get("_char_counts", F.lit(SYMBOL_CLASS)),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(repeated, F.lit(0)).cast("bigint"),
        }
    )


def _positions() -> Column:
    """In order, where the windows start whose hash is in _twice: by search where it is short, else by sorting."""
    searched = F.filter(
        F.transform("_hashes", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull()
    )
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = F.sort_array(
        F.transform(
            F.filter(
                F.zip_with(placed, "_sorted", lambda x, _: x),
                lambda x, k: (F.get("_sorted", k - 1) == x["h"]) | (F.get("_sorted", k + 1) == x["h"]),
            ),
            lambda x: x["i"],
        )
    )
    return F.when(F.size("_twice") <= SEARCHED, searched).otherwise(sorted_)


MADE = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed char_distance word_distance kept".split()


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """A struct caller of the columns carry of docs (all by default), whatever their names and types, and the columns MADE."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    own = [F.col(f"`{c.replace('`', '``')}`") for c in (docs.columns if carry is None else carry)]
    docs = docs.select(F.struct(*own).alias("caller"), F.col(text_col).alias("text"), lang.alias("lang"))
    features = with_base_features(with_histograms(docs))
    base = ["n_symbols", "n_dup_lines", "n_repeat_words", "_n_words", "_word_chars", "_char_hist", "_word_hist"]
    lang, long_enough = F.col("lang"), F.col("_n_words") >= MIN_WORDS_COMPARED
    counts = F.when(~_listed(lang) & long_enough, F.col("_word_counts")).alias("_word_counts")
    features = written(features.select("caller", "lang", *base, counts), "quality")
    refs = written(references(features).withColumn("ref_at", _slots()), "references")
    # A row for each listed language, whatever the input: a proven bound for the broadcast, and for their list.
    listed, ref = refs.where(_listed(F.col("ref_lang"))), F.struct("ref_lang", "ref_char", "ref_word", "ref_at")
    out = features.join(F.broadcast(listed.select(F.col("ref_lang").alias("_own_lang"), "ref_char", "ref_word")), lang == F.col("_own_lang"), "left")
    out = out.crossJoin(F.broadcast(listed.agg(F.collect_list(ref).alias("_refs"))))
    # Any other language has a reference of its own, and there may be any number of them.
    others = refs.where(~_listed(F.col("ref_lang"))).select(F.col("ref_lang").alias("_other_lang"), F.array(ref).alias("_other_ref"))
    if others.head(1):
        out = out.join(others, lang == F.col("_other_lang"), "left")
        out = out.withColumn("_refs", F.concat("_refs", F.coalesce("_other_ref", F.slice("_refs", 1, 0))))
    out = out.withColumn("_nearest", F.when(~_listed(lang) & long_enough, nearest(F.col("_refs"))))
    either = lambda hist, ref, c: F.when(_listed(lang), js_distance(F.col(hist), F.col(ref))).otherwise(F.col("_nearest")[c])
    out = out.withColumns(
        {
            "n_words": F.col("_n_words"),
            "word_chars": F.col("_word_chars"),
            "char_distance": F.when(long_enough, either("_char_hist", "ref_char", "char_distance")),
            "word_distance": F.when(long_enough, either("_word_hist", "ref_word", "word_distance")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = F.coalesce(F.col("char_distance") <= _limit(CHAR_LIMIT, CHAR_SLACK), F.lit(True)) & F.coalesce(
        F.col("word_distance") <= _limit(WORD_LIMIT, WORD_SLACK), F.lit(True)
    )
    return out.withColumns({"base_failed": failed, "kept": ~failed & near}).select("caller", *MADE)


def quality_rules(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns carry of docs (all by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance and kept.

    The texts are read once: the features are written to the shared folder, the references come from there. A null text
    is empty; it and the empty text have no words and fail the base rules; texts may have any length. A lang without a
    list of common words has a reference of its own, which its documents are held against beside those of the listed
    languages; those with a null lang are held against the listed ones; the nearest counts, see nearest(). Both distances
    are null where a document is below MIN_WORDS_COMPARED or there is no reference (no long document names its language, or
    a listed one), and then don't reject. Repeated rows are judged alike. Columns of docs may have any name; those that
    have the name of a result are left out. An empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    found = judged(docs, text_col, lang_col, carry)
    return found.select(*(F.col("caller").getField(c).alias(c) for c in carry), *MADE)
