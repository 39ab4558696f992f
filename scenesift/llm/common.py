"""Helpers shared by the text operators: shared-folder tables, buckets of whole texts, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.session import ensure_checkpoint_dir

BLANK = r"[\x20\x09-\x0D]+"
#: Bytes of text that one bucket of texts should hold; a larger single text has a bucket's task for itself.
BUCKET_BYTES = 2 << 20
SEED = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0xBF58476D1CE4E5B9)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text split at ASCII blanks; no words for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, used to choose how many buckets there are."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def integer_ids(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.IntegralType)


def numbered_ids(df: DataFrame, key: str) -> DataFrame:
    """(_id, _number): the different ids of ``df`` in their order, numbered from 0; null has no number.

    The ids are cut into ranges and written, then numbered within their range; the counts of the ranges, one row for
    each, give the number of its first id.
    """
    ids = df.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull()).distinct().repartitionByRange("_id")
    ids = stored(ids.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    firsts = ranges.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_id"))
    return stored(ids.withColumn("_number", within).join(firsts, "_range").select("_id", (F.col("first") + F.col("_number") - 1).alias("_number")))


def by_number(df: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(_number, text): the texts of ``df`` under the numbers of their ids."""
    return df.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(ids, "_id", "left").select("_number", "text")


def bucketed(df: DataFrame, key: str, text: str, total: int, size: int = BUCKET_BYTES) -> DataFrame:
    """(bucket, key, text): whole texts dealt by a hash of key and text into even buckets of about ``size`` bytes.

    Equal rows share a bucket, other rows of one key do not, so no key can fill a bucket.
    """
    buckets = max(1, -(-total // size))
    return df.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(key).alias("key"), F.col(text).alias("text"),
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * PRIME
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with one newline after each, start of each text and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    h = np.full(len(starts), SEED) ^ (ends - starts).astype(np.uint64)
    at, left, live = starts.copy(), ends - starts, np.arange(len(starts))
    while len(live):
        chunk = wide[at].view("<u8").ravel()
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(keep == 64, ~np.uint64(0), (np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1))
        h[live] = mix((h[live] ^ (chunk & mask)) * SEED + np.uint64(1))
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    return h


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, word starts, word ends, word hashes, index of each text's first word and the end)."""
    data, text_starts = joined_bytes(texts)
    starts, ends = word_bounds(~is_blank(data))
    return data, starts, ends, hash_words(data, starts, ends), np.searchsorted(starts, text_starts)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; runs may cross texts, callers mask those."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + h[k : k + len(out)]) * SEED
            out ^= out >> np.uint64(29)
    return mix(out)


def window_ok(firsts: np.ndarray, n_windows: int, size: int) -> np.ndarray:
    """True where a window of ``size`` words stays within one text."""
    ok = np.ones(n_windows, bool)
    for end in firsts[1:-1]:
        ok[max(0, end - size + 1) : end] = False
    return ok


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Mask of the places covered by the given runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0


def ascii_lower(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.lower()
