"""Quality rules: exact text statistics, and divergence from the histograms of a text's language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenesift.llm.common import BLANK, stored, words_of

#: Words per language whose shares are compared; a feature of the method, not a cut of the texts.
COMMON_WORDS = 16
#: Shortest text, in words, that each histogram is judged on.
MIN_WORDS_CLASSES, MIN_WORDS_COMMON = 50, 100
#: Largest Jensen-Shannon distance of a kept text.
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.3, 0.4
#: Character classes, in the order of the histogram, the one that is not ASCII last; what is left over is one more class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", BLANK, "[.,;:!?'\"()-]+", r"[^\x00-\x7F]+")


def _ascii_count(text: Column, pattern: str) -> Column:
    """Characters of an ASCII class: bytes are characters there, and their number is known without reading the text."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


#: Hashes of all 3-word windows of ``_words``, in order.
WINDOWS = """element_at(transform(array(transform(_words, w -> xxhash64(w))), h ->
  transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))), 1)"""

#: Words in 3-word windows that occur twice or more, from ``_windows``. Texts without a repeat stop at the first
#: line; else windows are sorted by hash, those equal to a neighbour keep their start, and each start adds the words
#: up to the next one, three at most.
REPEAT_WORDS = """
  CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE
    element_at(transform(array(array_sort(transform(_windows, (h, i) -> struct(h, i)))), p ->
      element_at(transform(array(array_sort(transform(
          filter(p, (x, i) -> x.h = get(p, i - 1).h OR x.h = get(p, i + 1).h), x -> x.i))), s ->
        aggregate(zip_with(s, slice(s, 2, size(s)), (a, b) -> least(coalesce(b - a, 3), 3)), 0L, (t, v) -> t + v)), 1)), 1)
  END"""


def class_counts(text: Column) -> Column:
    """Characters of each class, as an array of doubles."""
    counts = [_ascii_count(text, c) for c in CLASSES[:-1]] + [F.length(text) - F.length(F.regexp_replace(text, CLASSES[-1], ""))]
    other = F.length(text) - reduce(lambda a, b: a + b, counts)
    return F.array(*[c.cast("double") for c in (*counts, other)])


def js_distance(p: str, q: str) -> str:
    """SQL text of the Jensen-Shannon distance (base 2, from 0 to 1) of two count arrays; null if one is all zero."""
    share = lambda a: f"transform({a}, v -> v / nullif(aggregate({a}, 0D, (s, x) -> s + x), 0D))"
    both = f"zip_with({share(p)}, {share(q)}, (x, y) -> IF(x > 0, x * log2(2 * x / (x + y)), 0D) + IF(y > 0, y * log2(2 * y / (x + y)), 0D))"
    return f"sqrt(abs(aggregate({both}, 0D, (s, v) -> s + v) / 2))"


def text_features(samples: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(_key, lang, the exact statistics, classes, words): everything that a text itself decides, in one pass over it.

    ``classes`` counts the characters of each class; ``words`` has all words, lower-cased, between double blanks.
    """
    rows = samples.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumns({
        "_words": words_of(F.col("text")),
        "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "classes": class_counts(F.col("text")),
    })
    rows = rows.withColumn("_windows", F.expr(WINDOWS))
    low = F.lower(F.array_join("_words", "  "))
    return rows.select(
        "_key", "lang", "classes", F.concat(F.lit(" "), low, F.lit(" ")).alias("words"),
        F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _ascii_count(F.col("text"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.expr(REPEAT_WORDS).cast("long").alias("n_repeat_words"),
    )


def language_references(features: DataFrame, n_common: int = COMMON_WORDS) -> DataFrame:
    """(lang, ref_classes, ref_words, ref_counts): histograms of every language, summed over all its texts.

    ``ref_words`` are the most frequent words of a language; ``ref_counts`` has their counts and, last, that of all
    other words.
    """
    n = len(CLASSES) + 1
    classes = features.groupBy("lang").agg(F.array(*[F.sum(F.col("classes")[k]) for k in range(n)]).alias("ref_classes"), F.sum("n_words").alias("n"))
    words = features.select("lang", F.explode(F.split(F.trim("words"), "  ")).alias("word")).filter("word != ''")
    tally = words.groupBy("lang", "word").count()
    first = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    top = tally.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n_common)
    common = top.groupBy(F.col("lang").alias("_l")).agg(F.sort_array(F.collect_list(F.struct("nth", "word", "count"))).alias("top"))
    joined = classes.join(common, F.col("lang").eqNullSafe(F.col("_l")), "left")
    counts = F.transform("top.count", lambda c: c.cast("double"))
    other = F.col("n") - F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return joined.select("lang", "ref_classes", F.col("top.word").alias("ref_words"), F.concat(counts, F.array(other)).alias("ref_counts"))


def judge_quality(samples: DataFrame, key: str = "sample_id", text: str = "text", lang: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """Exact statistics of every sample text and a verdict on it.

    ``samples`` has a sample id, its text and the language of the text. Two rules fail a text at once: fewer than 50
    words, or more than half of its words in repeated 3-word windows. The others are compared with the histograms
    of their language (``language_references`` over all texts unless given): the Jensen-Shannon distance of the
    character classes is judged from ``MIN_WORDS_CLASSES`` words on, that of the words from ``MIN_WORDS_COMMON``; a text
    is kept unless a judged distance exceeds its bound. The word histogram has the language's most frequent words, of
    any length, and one bin for all others; a text without any of the frequent words has the full distance of 1.

    Returns (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance), one row for each input row. Null and empty texts have no words and no distances and fail. A null
    language is a language of its own; a language that given references do not have is judged by neither distance.
    Ids may be null or repeat; other columns are not read. Empty input gives no rows.
    """
    features = stored(text_features(samples, key, text, lang))
    refs = stored(language_references(features)) if references is None else references
    rows = features.join(refs.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    rows = rows.withColumns({
        "_common": F.expr("transform(ref_words, w -> (octet_length(words) - octet_length(replace(words, ' ' || w || ' ', ''))) / CAST(octet_length(w) + 2 AS DOUBLE))"),
        "class_distance": F.round(F.expr(js_distance("classes", "ref_classes")), 6),
    })
    rows = rows.withColumn("_met", F.aggregate("_common", F.lit(0.0), lambda s, c: s + c))
    rows = rows.withColumn("_bins", F.concat("_common", F.array(F.col("n_words") - F.col("_met"))))
    apart = F.when((F.col("n_words") > 0) & (F.col("_met") == 0), 1.0).otherwise(F.expr(js_distance("_bins", "ref_counts")))
    rows = rows.withColumn("word_distance", F.round(apart, 6))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    odd = ((F.col("n_words") >= MIN_WORDS_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS_COMMON) & (F.col("word_distance") > MAX_COMMON_DISTANCE))
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return rows.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
