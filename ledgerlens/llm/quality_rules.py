"""Quality rules by distribution divergence (operator 4), with DataFrame functions only.

Base counts of a text's words, symbols, repeated lines and repeated 5-word windows come first. A text that passes the base rules is then
compared with its language: the histogram of its character classes and the histogram of its common words are each held
against the language's reference by Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1).

All that the comparison needs is learned from the documents themselves:

* The common words of a language are the ``TOP_WORDS`` that the most of its documents (of ten words or more) use at least twice.
* A reference has, for each class or word, the median of its share in the language's documents that pass the base rules and are long enough,
  documents with equal histograms counted once: so neither a long text nor a group of copies nor what is to be found moves it.
* The histogram of n draws from the reference is itself at a distance that falls with the root of n. So distances are multiplied by it,
  and a text is dropped whose product lies above the outer fence of its language, ``q75 * (q75 / q25) ** FENCE`` (Tukey's fence on the
  logarithms; ``q75 / q25`` counts as ``LEAST_SPREAD`` at least). The quartiles are those of the same documents, and up to a quarter of poor ones hardly
  move them. A lower quartile of 0 sets no fence.

Short texts have unsteady histograms: the classes count from ``least_chars`` characters in words on, the common words from
``least_words`` words on. Languages with fewer than ``least_documents`` such documents, and texts whose lang is null, have
one reference of classes together and no common words.

The text is read twice, for the words and for the features, and never shuffled; the features are written once and the references, the fences
and the verdicts read them. What is broadcast has a row a language, and is joined plainly above ``MOST_BROADCAST`` of them.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged one by one; words found in equally
many documents are taken in their order; a text of any length is one row of its task; an empty table gives an empty table; a column of
the input that has the name of a new one is replaced. 5-word windows are compared by 64-bit hashes within their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

TOP_WORDS = 18
LEAST_CHARS, LEAST_WORDS, LEAST_DOCUMENTS = 200, 60, 20
FENCE, LEAST_SPREAD = 3, 1.2
MOST_BROADCAST = 100_000
#: Regular expressions of character classes; what no class takes, and is in a word, is a letter of lower case or without case.
CLASSES: tuple[str, ...] = (r"\p{Lu}", "[0-9]", "[#*$%&|<>]", r"[!\"'()+,\-./:;=?@\[\]\\^_`{}~]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where it is used inside another function's lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more."""
    n = F.size(words)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            hits = F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))))
            places = F.sort_array(F.transform(hits, lambda x: x["i"]))
            steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
            return F.aggregate(let(places, steps), F.lit(0), lambda a, x: a + x)

        numbered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(numbered, from_sorted))

    return let(windows, covered)


def common_words(docs: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """(_lang, common): per language its ``top`` words, the most common first."""

    def repeated(words: Column) -> Column:
        return F.array_distinct(F.filter(words, lambda x, i: F.coalesce(F.get(words, i + 1) == x, F.lit(False))))

    words = let(_words(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.when(F.size(w) >= 10, let(F.sort_array(w), repeated)))
    counts = docs.where(F.col("lang").isNotNull()).select(F.col("lang").alias("_lang"), F.explode(words).alias("word")).groupBy("_lang", "word").agg(F.count("*").alias("n"))
    # by parts of a language first, so that no task sorts all its words
    first = Window.partitionBy("_lang", F.pmod(F.hash("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    then = Window.partitionBy("_lang").orderBy(F.desc("n"), "word")
    best = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).withColumn("r", F.row_number().over(then)).where(F.col("r") <= top)
    return best.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("w")).select("_lang", F.col("w.word").alias("common"))


def _listed_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs; null without common words. One pattern finds the common words, so no lambda sees the others."""
    quoted = F.transform(common, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(" (?:"), F.array_join(quoted, "|"), F.lit(")(?= )"))
    text = F.concat(F.lit(" "), F.lower(F.array_join(words, " ")), F.lit(" "))
    hits = F.concat(F.array_join(F.regexp_extract_all(text, pattern, F.lit(0)), " "), F.lit(" "))
    among = lambda text: F.transform(common, lambda w: ((F.octet_length(text) - F.octet_length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long"))
    return F.when(common.isNotNull(), let(hits, among))


def _few(df: DataFrame) -> DataFrame:
    """``df``, which has a row a language, for a join: broadcast where it is small."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def with_features(docs: DataFrame, keep: list[str], common: DataFrame) -> DataFrame:
    """Base counts, the histogram of classes and that of ``common`` words (_lang, common), beside the columns ``keep`` and _lang."""
    keep = [c for c in keep if c not in (*BASE, "classes", "listed")]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            _listed_counts(words, F.col("common")).alias("listed"),
        )

    counts = [F.regexp_count(text, F.lit(c)).cast("long") for c in CLASSES]
    return docs.select(*dict.fromkeys([*keep, "text"]), F.col("lang").alias("_lang")).join(common, "_lang", "left").select(
        *keep,
        "_lang",
        let(_words(text), of).alias("_w"),
        F.array(*counts).alias("_c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        *keep,
        "_lang",
        F.col("_w.n_words").alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        F.get("_c", F.lit(2)).alias("n_symbols"),
        "n_dup_lines",
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.array(*(F.get("_c", F.lit(k)) for k in range(len(CLASSES))), F.col("_w.word_chars") - sum((F.get("_c", F.lit(k)) for k in range(len(CLASSES))), F.lit(0))).alias("classes"),
        F.concat("_w.listed", F.array(F.col("_w.n_words") - F.aggregate("_w.listed", F.lit(0).cast("long"), lambda a, x: a + x))).alias("listed"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, of counts or shares; 0 if one of them is missing or empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)

    def of(n: Column, m: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: (part(x / n, y / m) + part(y / m, x / n)) / 2)
        return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v))))

    return F.coalesce(let(total(p), lambda n: let(total(q), lambda m: of(n, m))), F.lit(0.0))


def _medians(histogram: str, total: str, size: int, wanted: Column) -> Column:
    """The median share of each entry, over the rows where ``wanted`` holds."""
    return F.array(*(F.percentile_approx(F.when(wanted, F.get(histogram, F.lit(k)) / F.col(total)), 0.5, 10_000) for k in range(size)))


def judged(
    docs: DataFrame, keep: list[str], least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, least_documents: int = LEAST_DOCUMENTS, top_words: int = TOP_WORDS, fence: float = FENCE
) -> DataFrame:
    """The base counts, base_failed, both distances (null where not compared) and kept for every row of ``docs`` (text, lang), beside the columns ``keep``."""
    keep = [c for c in keep if c not in (*BASE, "base_failed", "class_distance", "common_distance", "kept")]
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    common = _few(written(common_words(docs, top_words), "common"))
    found = written(with_features(docs, keep, common).withColumn("base_failed", base_failed), "features")

    by_class, by_word = F.col("word_chars") >= least_chars, F.col("n_words") >= least_words
    passed = found.where(~F.col("base_failed") & (by_class | by_word))
    large = passed.where("_lang is not null").groupBy("_lang").count().where(F.col("count") >= least_documents)
    large = _few(written(large.select("_lang", F.lit(True).alias("_large")), "large"))

    def grouped(df: DataFrame) -> DataFrame:
        df = df.join(large, "_lang", "left").withColumn("_group", F.when(F.col("_large"), F.concat(F.lit("="), "_lang")).otherwise("*"))
        return df.withColumn("listed", F.when(F.col("_large"), F.col("listed"))).drop("_large")

    kinds = written(grouped(passed).select("_group", "classes", "listed", "word_chars", "n_words").distinct(), "kinds")
    medians = [_medians("classes", "word_chars", len(CLASSES) + 1, by_class).alias("all_classes"), _medians("listed", "n_words", top_words + 1, by_word).alias("all_listed")]
    references = kinds.groupBy("_group").agg(*medians, F.max(F.size("listed")).alias("_n"))
    references = _few(written(references.withColumn("all_listed", F.when(F.col("_n") > 0, F.slice("all_listed", F.lit(1), F.col("_n")))).drop("_n"), "references"))

    shown = {
        "class_distance": F.when(by_class, distance(F.col("classes"), F.col("all_classes"))),
        "common_distance": F.when(by_word, distance(F.col("listed"), F.col("all_listed"))),
    }
    roots = {"class_distance": F.sqrt("word_chars"), "common_distance": F.sqrt("n_words")}
    scaled = kinds.join(references, "_group").select("_group", *((d * roots[c]).alias(c) for c, d in shown.items()))
    quartiles = scaled.groupBy("_group").agg(*(F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"_{c}") for c in shown))
    spread = lambda q: F.greatest(F.get(q, F.lit(1)) / F.get(q, F.lit(0)), F.lit(LEAST_SPREAD))
    fences = [F.when(F.get(f"_{c}", F.lit(0)) > 0, F.get(f"_{c}", F.lit(1)) * F.pow(spread(f"_{c}"), F.lit(fence))).alias(f"_{c}") for c in shown]
    fences = _few(written(quartiles.select("_group", *fences), "fences"))

    both = grouped(found).join(references, "_group", "left").join(fences, "_group", "left").withColumns(shown)
    within = F.lit(True)
    for c, root in roots.items():
        within = within & F.coalesce(F.col(c) * root <= F.col(f"_{c}"), F.lit(True))
    return both.select(*keep, *BASE, "base_failed", "class_distance", "common_distance", (~F.col("base_failed") & within).alias("kept"))
