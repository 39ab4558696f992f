"""From raw documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes all documents that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenesift.llm.catalog import table
from scenesift.llm.common import stored
from scenesift.llm.decontaminate import find_leaks
from scenesift.llm.line_dedup import remove_repeated_lines
from scenesift.llm.mixing import mix_sources
from scenesift.llm.near_dedup import near_duplicates
from scenesift.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from ``labels``."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), key="doc_id", columns=docs.columns)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that an earlier one has; those with no word left are whole copies and go."""
    out = remove_repeated_lines(docs, key="doc_id")
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("kept").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = out.filter(~emptied)
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept"), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = near_duplicates(rows, key="_row", shingle=5).select(F.col("_row").alias("_member"), "component_id")
    named = groups.join(rows.select("doc_id", "_row"), F.col("_member") == F.col("_row")).drop("_member")
    stay = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row")
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    out = mix_sources(docs, key="doc_id", source="source")
    return out.filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaked),
    ("mixing", mix),
]

#: No SQL text: learned scores, signatures and edit distances are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
