"""Incremental category counts over arriving sample documents.

The batch form is an incremental re-run; a file stream gives the same without keeping
a list of processed files, and its checkpoint makes each document count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenesift.functions.names import category_normalize
from scenesift.sources.samples import parse_documents


def category_counts_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Streaming sample count per category; write it in update or complete mode."""
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files).text(folder)
    documents = parse_documents(texts)
    rows = documents.select(F.explode("samples").alias("s"))
    return rows.groupBy(category_normalize(F.col("s.class_name")).alias("category")).agg(F.count(F.lit(1)).alias("sample_count"))
