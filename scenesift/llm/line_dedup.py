"""Line dedup: prefix doubling over line-ID sequences finds repeated runs of lines; later copies are deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenesift.llm.common import BLANK, stored

#: Words that a repeated run of lines holds at least to be deleted.
MIN_WORDS = 10


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(_doc_row, _key, seq, pos, h, g, ahead, back) of every line with a word.

    ``seq`` counts the lines with words of a text from 1, ``pos`` all its lines from 0; (h, g) is the line's ID.
    ``ahead`` is how many lines from this one on hold ``min_words`` words, ``back`` the same up to this one; null when
    the text has too few. A line with words has one at least, so neither looks further than ``min_words`` lines.
    """
    lines = docs.select("_doc_row", "_doc_key", F.expr("transform(split(_doc_text, '\\n'), (x, i) -> struct(i AS pos, x AS line))").alias("every"))
    lines = lines.select("_doc_row", "_doc_key", F.filter("every", lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]")).alias("some")).filter(F.size("some") > 0)
    count = rf"size(filter(split(x.line, '{BLANK}'), w -> w != ''))".replace("\\", "\\\\")
    lines = lines.withColumn("words", F.expr(f"transform(some, x -> {count})"))
    # Words up to and including each line.
    before = Window.partitionBy("_doc_row").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("_doc_row", "_doc_key", F.posexplode(F.arrays_zip("some", "words"))).select(
        "_doc_row", "_doc_key", (F.col("pos") + 1).alias("seq"), F.col("col.some.pos").alias("pos"),
        F.xxhash64("col.some.line").alias("h"), F.xxhash64("col.some.line", F.lit(1)).alias("g"), F.col("col.words").alias("n"))
    rows = rows.withColumn("upto", F.sum("n").over(before))
    by_seq = Window.partitionBy("_doc_row").orderBy("seq")
    after = F.collect_list("upto").over(by_seq.rowsBetween(0, min_words - 1))
    prior = F.collect_list(F.col("upto") - F.col("n")).over(by_seq.rowsBetween(1 - min_words, 0))
    rows = rows.withColumns({"_after": after, "_prior": prior})
    ahead = F.size(F.filter("_after", lambda c: c < F.col("upto") - F.col("n") + min_words)) + 1
    back = F.size(F.filter("_prior", lambda c: F.col("upto") - c < min_words)) + 1
    return rows.select(
        "_doc_row", "_doc_key", "seq", "pos", "h", "g",
        F.when(ahead <= F.size("_after"), ahead).alias("ahead"), F.when(back <= F.size("_prior"), back).alias("back"))


def doubled_names(lines: DataFrame, longest: int) -> DataFrame:
    """Adds ``names``: names[k] is the ID of the run of 2^k lines from each line on, by prefix doubling.

    A run of twice the length is named by the names of its halves. Runs that leave the text, or hold a line that no
    other place has, are null. All levels look ahead in one ordering of each text's lines, so there is one shuffle.
    """
    levels = [F.struct("h", "g")]
    rows = lines.withColumn("_n0", levels[0])
    span, k = 1, 0
    while 2 * span <= longest:
        half = F.first(f"_n{k}").over(Window.partitionBy("_doc_row").orderBy("seq").rangeBetween(span, span))
        rows = rows.withColumn("_half", half)
        own = F.col(f"_n{k}")
        name = F.struct(F.xxhash64(own["h"], F.col("_half.h")).alias("h"), F.xxhash64(own["g"], F.col("_half.g")).alias("g"))
        k, span = k + 1, 2 * span
        rows = rows.withColumn(f"_n{k}", F.when(own.isNotNull() & F.col("_half").isNotNull(), name))
    return rows.withColumn("names", F.array(*[f"_n{n}" for n in range(k + 1)])).drop("_half", *[f"_n{n}" for n in range(k + 1)])


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(_doc_row, first, last): the line runs (positions in the text) that an earlier place holds too.

    Any repeated run with ``min_words`` words is the union of the shortest such runs from each of its lines on and up
    to each of its lines, so these two for each line are looked up. A run of n lines is named by the two runs of the
    largest power of two below n that cover it; runs with one name are an LCP interval of the suffix order, whose
    first place stays.
    """
    shared = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = stored(doubled_names(lines.join(shared, ["h", "g"]), min_words))
    ends = F.explode(F.array(
        F.struct(F.col("seq").alias("start"), F.col("ahead").alias("size")),
        F.struct((F.col("seq") - F.col("back") + 1).alias("start"), F.col("back").alias("size"))))
    runs = rows.select("_doc_row", "_doc_key", ends.alias("run")).select("_doc_row", "_doc_key", "run.*").filter(F.col("size").isNotNull()).distinct()
    level = F.floor(F.log2("size")).cast("int")
    runs = runs.withColumn("level", level).withColumn("rest", F.col("start") + F.col("size") - F.call_function("shiftleft", F.lit(1), F.col("level")))
    head = rows.select("_doc_row", F.col("seq").alias("start"), F.col("names").alias("head"), F.col("pos").alias("first"))
    tail = rows.select("_doc_row", F.col("seq").alias("rest"), F.col("names").alias("tail"))
    last = rows.select("_doc_row", F.col("seq").alias("stop"), F.col("pos").alias("last"))
    runs = runs.withColumn("stop", F.col("start") + F.col("size") - 1).join(head, ["_doc_row", "start"]).join(tail, ["_doc_row", "rest"]).join(last, ["_doc_row", "stop"])
    at = lambda names: F.get(names, F.col("level"))
    name = F.struct("size", at("head").alias("head"), at("tail").alias("tail"))
    place = F.struct(F.col("_doc_key").alias("k"), F.col("_doc_row").alias("i"), F.col("first").alias("p"))
    runs = stored(runs.select("_doc_row", "first", "last", name.alias("name"), place.alias("place")).filter(F.col("name.head").isNotNull() & F.col("name.tail").isNotNull()))
    firsts = runs.groupBy("name").agg(F.min("place").alias("origin"), F.count("*").alias("n")).filter("n > 1")
    return runs.join(firsts.drop("n"), "name").filter(F.col("place") > F.col("origin")).select("_doc_row", "first", "last")


def remove_repeated_lines(samples: DataFrame, key: str = "sample_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete from every sample text the runs of lines that stand earlier in the samples.

    ``samples`` has an ordered sample id and a text whose lines end at \\n (a grounding description, or an annotation
    document with a field a line). Lines are equal when their text is; lines without a word are left out of the
    sequences and stay. A run of lines is deleted when it holds ``min_words`` words and
    the same run also starts earlier: smaller id, or further ahead in the same text. Runs are judged on the input.

    Returns the columns of ``samples`` with ``n_lines``, ``n_removed`` and ``kept`` (the text left) added; columns of
    these names are replaced. Null and empty texts have no lines with words and stay as they are (null: null). A null
    id is before all others; rows with the same id are in an order fixed when the job first writes them. Empty input
    gives no rows.
    """
    own = [c for c in samples.columns if c not in ("n_lines", "n_removed", "kept")]
    # The columns of the samples travel in a struct, so that none can clash with the operator's own.
    docs = stored(samples.select(F.struct(*[c for c in own if c != text]).alias("_own"), F.monotonically_increasing_id().alias("_doc_row"), F.col(key).alias("_doc_key"), F.col(text).alias("_doc_text")))
    runs = repeated_runs(stored(line_table(docs, min_words)), min_words)
    gone = runs.groupBy("_doc_row").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    gone = gone.select("_doc_row", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))).alias("_gone"))
    lines = F.split("_doc_text", "\n")
    rows = docs.join(gone, "_doc_row", "left").withColumn("_lines", lines)
    # Positions are of whole runs; the lines without a word among them stay.
    rows = rows.withColumn("_gone", F.filter("_gone", lambda i: F.get("_lines", i).rlike(r"[^\x20\x09-\x0D]")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    n_of = lambda array: F.when(F.col(array).isNull(), F.lit(0)).otherwise(F.size(array)).cast("long")
    out = rows.select(
        *[F.col("_doc_text").alias(text) if c == text else F.col("_own").getField(c).alias(c) for c in own],
        n_of("_lines").alias("n_lines"), n_of("_gone").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_doc_text")).otherwise(kept).alias("kept"))
    return out
