"""Quality rules by distribution divergence.

Each document's histogram of character classes and of its language's common words is
compared with the whole corpus's histogram for that language by Jensen-Shannon
distance. Short texts are guarded: too few characters or words say nothing about a
distribution, so the test is skipped for them. Everything is Spark SQL expressions;
the texts are read once, the references come from the counts of all documents.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelar.plans.cut import broadcast_if_small, materialize

from ._common import fresh, text_of, words_of

#: Counted by the contract.
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 3
#: Up to so many repeated windows are looked up one by one; more are found by sorting. Both are exact.
FEW = 24

# Common function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans par",
    "es": "de la que el en y a los se del las un por con no una",
}


@dataclasses.dataclass(frozen=True)
class Rules:
    """Limits; distances are in [0, 1]."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.28
    max_word_distance: float = 0.29
    guard_chars: int = 200
    guard_words: int = 100
    #: A language needs so many words in the corpus before it can serve as a reference.
    reference_words: int = 2_000


def _removed(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, what, ""))).cast("long")


def _repeated_words(found: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``; a word counts once however many windows cover it."""
    w, g, r = F.col("words"), F.col("grams"), F.col("ranked")
    gram = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    found = found.withColumn("grams", F.slice(gram, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))
    found = found.withColumn("ordered", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(g)))
    found = found.withColumn(
        "twice", F.array_distinct(F.filter("ordered", lambda x, k: F.get("ordered", k - 1).eqNullSafe(x)))
    ).drop("ordered")
    found = found.withColumn(
        "ranked", F.when(F.size("twice") > FEW, F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    few = F.filter(F.transform(g, lambda h, i: F.when(F.array_contains("twice", h), i)), lambda i: i.isNotNull())
    many = F.filter(r, lambda x, k: F.get(r, k - 1)["h"].eqNullSafe(x["h"]) | F.get(r, k + 1)["h"].eqNullSafe(x["h"]))
    starts = (
        F.when(F.col("twice").isNull(), F.array().cast("array<int>"))
        .when(F.size("twice") <= FEW, few)
        .otherwise(F.sort_array(F.transform(many, lambda x: x["i"])))
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return found.withColumn("n_repeat_words", covered).drop("ranked", "twice", "grams")


def features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, str] | None = None
) -> DataFrame:
    """Counts of every text: contract counts, character classes and hits of the common words."""
    t, w = F.col("text"), F.col("words")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        text_of(text_col).alias("text"),
    )
    lists = F.create_map(*[F.lit(x) for k, v in (common or COMMON_WORDS).items() for x in (k, v)])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("words", words_of(t)).withColumn("lines", lines)
    rows = _repeated_words(
        rows.select(
            "doc_id",
            "lang",
            "words",
            F.split(F.try_element_at(lists, F.col("lang")), " ").alias("common"),
            F.size(w).cast("long").alias("n_words"),
            F.length(t).cast("long").alias("chars"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _removed(t, SYMBOLS).alias("n_symbols"),
            _removed(t, r"[a-zß-öø-ÿ]+").alias("lower"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        )
    )
    hits = F.transform("common", lambda x: F.size("words") - F.size(F.array_remove("words", x)))
    return rows.withColumn("hits", hits).drop("words", "common")


def language_references(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language with enough words: summed character classes and common-word hits."""
    k = max(len(v.split()) for v in COMMON_WORDS.values())
    sums = counts.groupBy("lang").agg(
        *[F.sum(c).alias(c) for c in ("n_words", "chars", "word_chars", "n_symbols", "lower")],
        F.array(*[F.sum(F.get("hits", i)) for i in range(k)]).alias("all_hits"),
    )
    sums = sums.where(F.col("n_words") >= rules.reference_words)
    hits = F.filter("all_hits", lambda x: x.isNotNull())
    return sums.select("lang", class_shares().alias("ref_classes"), word_shares(hits).alias("ref_words"))


def class_shares() -> Column:
    """Shares of lower-case letters, white space, symbols and all other characters."""
    space = F.col("chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("lower") - F.col("n_symbols")
    return F.array(*[c / F.col("chars") for c in (F.col("lower"), space, F.col("n_symbols"), rest)])


def word_shares(hits: Column) -> Column:
    """Shares of the common words and, last, of all other words."""
    shares = F.transform(hits, lambda n: n / F.col("n_words"))
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()
) -> DataFrame:
    """One row per input row with its counts, distances and verdict.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, kept``. A null text counts as empty and
    fails the base rules; a null language is a language of its own. A distance is null,
    and passes, where a guard applies, the language has too few words or (words only)
    no list of common words. Repeated rows each get a verdict. An empty table gives an
    empty result.
    """
    counts = materialize(features(docs, id_col, text_col, lang_col), "counts")
    refs = broadcast_if_small(materialize(language_references(counts, rules), "references"))
    joined, n_words = counts.join(refs, "lang", "left"), F.col("n_words")
    scored = joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((n_words < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n_words)).alias("base_failed"),
        F.when(F.col("chars") >= rules.guard_chars, js_distance(class_shares(), F.col("ref_classes"))).alias("char_distance"),
        F.when(n_words >= rules.guard_words, js_distance(word_shares(F.col("hits")), F.col("ref_words"))).alias("word_distance"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > rules.max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance
    )
    return scored.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()
) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged.

    A verdict joins back on a digest of id, language and text: rows that repeat an id
    keep their own verdicts, and many copies of a text are not one key.
    A null or empty text fails the base rules and goes, as does any text under the least
    number of words; a null language counts as a language of its own, a null id as empty.
    Columns of any name pass through. An empty table stays empty.
    """
    key = fresh(docs, "_key")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (id_col, lang_col)]
    whole = F.concat(*[x for p in parts for x in (p, F.lit("\n"))], text_of(text_col))
    marked = docs.withColumn(key, F.coalesce(F.sha2(whole.cast("binary"), 256), F.lit("")))
    good = quality_rules(marked, key, text_col, lang_col, rules).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return marked.join(good, key, "left_semi").drop(key)
