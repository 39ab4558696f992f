"""Importance resampling of sample prompts towards the prompts of a target set, on hashed word runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import joined_bytes, stored, word_bounds
from scenesift.llm.crc_spans import crc32_spans

#: Bytes of text whose words are cut at a time; a longer single text is cut alone.
CHUNK_BYTES = 2 << 20
#: Rows of one piece of the final order.
PIECE_ROWS = 1_000_000

#: True for the bytes of words: digits, letters (already lower-cased) and everything that is not ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of up to ``size`` bytes, or one text."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def feature_buckets(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features text by text).

    Features are the runs of 1 to ``longest`` words, joined by one blank, repeats included; a bucket is the CRC-32 of
    the feature's bytes modulo ``buckets``.
    """
    data, bounds = joined_bytes([t.lower() for t in texts])
    inside = WORD_BYTE[data]
    starts, ends = word_bounds(inside)
    first_word = np.searchsorted(starts, bounds)
    n_words = np.diff(first_word)
    # All words in a row with one blank after each, so that a run of words is one span.
    inside[ends] = True
    line = np.where(inside, data, 0)
    line[ends] = 32
    line = line[inside]
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(texts)), n_words)
    found, owners = [], []
    for run in range(1, longest + 1):
        count = max(0, len(starts) - run + 1)
        whole = np.flatnonzero(owner[:count] == owner[run - 1 :][:count])
        last = whole + run - 1
        found.append(crc32_spans(line, at[whole], at[last] + size[last] - at[whole]) % np.uint32(buckets))
        owners.append(owner[whole])
    n_features = np.bincount(np.concatenate(owners), minlength=len(texts)).astype(np.int64)
    every = np.concatenate(found)
    if longest > 1:
        every = every[np.argsort(np.concatenate(owners), kind="stable")]
    return n_words, n_features, every


def _hashed(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, n_words, n_features, buckets) of (key, text); the buckets as packed 32-bit numbers."""
    schema = T.StructType([rows.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            # Whole texts of one chunk at a time are copied out of the batch.
            column = batch.column("text").cast(pa.large_binary())
            for texts in chunks([t or b"" for t in column.to_pylist()]):
                n_words, n_features, every = feature_buckets(texts, longest, buckets)
                packed = every.astype("<u4")
                ends = np.concatenate(([0], np.cumsum(n_features)))
                yield pa.record_batch([
                    batch.column("key").slice(done, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                    pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=schema.fieldNames())
                done += len(texts)

    return rows.mapInArrow(hash_batches, schema)


def _tally(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows: at most ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets").to_pylist():
                np.add.at(total, np.frombuffer(packed, "<u4"), 1)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in hashed.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the source."""
    buckets = len(source)
    up, down = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * up / (float(s + 1) * down))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(hashed: DataFrame, gains: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the weight is the sum of the gains of all features."""
    schema = T.StructType([*hashed.schema.fields[:3], T.StructField("weight", T.LongType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(packed, "<u4")].sum()) for packed in batch.column("buckets").to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(weights, pa.int64())], names=schema.fieldNames())

    return hashed.mapInArrow(weigh, schema)


def gumbel_thousandths(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and key; it repeats on every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    drawn = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(drawn))).cast("long")


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (key, score, ...) with rank 1, 2, 3... by score, ties to the smaller key; null beyond the drawn share.

    The order is cut into ranges that many tasks sort; a row's rank is its place in its range plus the rows of the
    ranges before it. ``_row`` keeps a crowd of equal rows divisible.
    """
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), "n_features", "_row"]
    pieces = max(1, -(-rows.count() // PIECE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written, because the bounds of the ranges come from a sample: a task run again must find the same ranges.
    dealt = stored(rows.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = dealt.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    placed = dealt.withColumn("_place", place).join(starts, F.col("_piece") == F.col("_p"))
    rank = F.col("_start") + F.col("_place")
    return placed.withColumn("rank", F.when(rank <= F.floor((F.col("_all") * F.lit(percent)) / 100), rank).cast("long"))


def resample_prompts(samples: DataFrame, target: DataFrame, key: str = "sample_id", prompt: str = "prompt", longest: int = 1, buckets: int = 10_000,
                     percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw the share of all samples whose prompts look most like those of ``target``, with Gumbel noise.

    ``samples`` has a sample id and a prompt, ``target`` a prompt. A-Z are lower-cased; words are runs of digits,
    letters and non-ASCII characters; features are the runs of 1 to ``longest`` words, hashed by CRC-32 into
    ``buckets``. A bucket's gain is floor(1000 ln) of its smoothed share in the target over that in the samples, counted
    over all rows of both; a sample's weight is the sum of the gains of its features, its score the weight plus Gumbel
    noise drawn from seed and id. Of the samples with at least ``min_words`` words, floor(``percent`` * their number / 100) with the
    highest scores are drawn, which is a draw without replacement in proportion to exp(weight / 1000).

    Texts are hashed once; the packed buckets are written to the shared folder and read for the counts and the
    weights. Only ``buckets`` counts pass the driver.

    Returns (key, n_words, n_features, weight, score, rank), one row for each input row; rank counts from 1, null for
    samples that are not drawn. Null and empty prompts have no features and weight 0. Ties go to the smaller id, a null
    id (drawn as if empty) comes last; repeated rows count as rows of their own. An empty target gives every bucket the
    same count there. Other columns are not read. Empty input gives no rows.
    """
    hashed = stored(_hashed(samples.select(F.col(key).alias("key"), F.col(prompt).alias("text")), longest, buckets))
    aims = _hashed(target.select(F.lit(0).alias("key"), F.col(prompt).alias("text")), longest, buckets)
    gains = bucket_gains(_tally(hashed, buckets), _tally(aims, buckets))
    scored = stored(_weighed(hashed, gains).withColumns({"score": F.col("weight") + gumbel_thousandths(F.col("key"), seed), "_row": F.monotonically_increasing_id()}))
    names = ["key", "n_words", "n_features", "weight", "score", "rank"]
    drawn = _ranked(scored.filter(F.col("n_words") >= min_words), percent).select(*names)
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(*names)
    return drawn.unionByName(short).withColumnRenamed("key", key)
