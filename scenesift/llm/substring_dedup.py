"""Substring dedup: fixed reference blocks, probed with every rolling window, extended to maximal exact repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import BUCKET_BYTES, bucketed, by_number, covered, integer_ids, numbered_ids, text_bytes, tokens, window_hashes, window_ok
from scenesift.llm.packed import ANSWER, answers, bits, first_of_runs, gather, question_schema, replies, rows_of, slices, unbits

WINDOW = 20
#: Bytes of text for each part of the hash range.
PART_BYTES = 8 << 20
NO_KEY = np.iinfo(np.int64).min


class Bucket:
    """The texts of one bucket with the hashes that each step works out again."""

    def __init__(self, table: pa.Table, window: int, parts: int):
        self.keys, self.texts = rows_of(table)
        self.window, self.block, self.parts = window, (window + 1) // 2, parts
        _, _, _, self.h, self.firsts = tokens(self.texts)
        rolling = window_hashes(self.h, self.block)
        ok = window_ok(self.firsts, len(rolling), self.block)
        self.at = np.flatnonzero(ok)
        place = np.arange(len(self.h)) - np.repeat(self.firsts[:-1], np.diff(self.firsts))
        self.hashes, self.which, counts = np.unique(rolling[self.at], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.is_block = np.zeros(len(self.hashes), bool)
        self.is_block[self.which[place[self.at] % self.block == 0]] = True

    def probes(self, bucket: int) -> pa.Table:
        cut = slices(self.hashes, self.parts)
        low = (self.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({
            "part": pa.array([p for p, _, _ in cut], pa.int32()), "bucket": pa.array([bucket] * len(cut), pa.int32()),
            "hashes": pa.array([low[a:b].tobytes() for _, a, b in cut], pa.binary()), "twice": pa.array([bits(self.twice[a:b]) for _, a, b in cut], pa.binary()),
            "blocks": pa.array([bits(self.is_block[a:b]) for _, a, b in cut], pa.binary()),
        })

    def candidates(self, reply: pa.Table) -> None:
        """Windows that hold a hit: a rolling window equal to a reference block that stands elsewhere too."""
        hit = unbits([r for r, _ in replies(reply, 1)], [b - a for _, a, b in slices(self.hashes, self.parts)])
        n = max(0, len(self.h) - self.window + 1)
        step = np.zeros(len(self.h) + 1, np.int64)
        step[1:][self.at[hit[self.which]]] = 1
        hits = np.cumsum(step)
        start = np.arange(n)
        near = hits[start + self.window - self.block + 1] - hits[start] > 0
        self.start = np.flatnonzero(near & window_ok(self.firsts, n, self.window))
        self.found, self.first, self.back = np.unique(window_hashes(self.h, self.window)[self.start], return_index=True, return_inverse=True)
        self.cut = slices(self.found, self.parts)

    def windows(self, bucket: int) -> pa.Table:
        """Each different candidate window once, with the text that has it first."""
        text = np.searchsorted(self.firsts, self.start[self.first], side="right") - 1
        key = np.array([NO_KEY if k is None else k for k in self.keys], np.int64)
        rows = []
        for part, a, b in self.cut:
            some, index = np.unique(text[a:b], return_inverse=True)
            rows.append((part, self.found[a:b].tobytes(), key[some].tobytes(), index.astype(np.uint16 if len(some) <= 1 << 16 else np.uint32).tobytes()))
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table({
            "part": pa.array(columns[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
            **{n: pa.array(c, pa.binary()) for n, c in zip(("hashes", "keys", "index"), columns[1:])},
        })

    def removed(self, reply: pa.Table) -> np.ndarray:
        """Mask of the words that a window with an earlier copy covers."""
        earlier = unbits([r for r, _ in replies(reply, 2)], [b - a for _, a, b in self.cut])
        repeat = earlier[self.back]
        repeat[np.setdiff1d(np.arange(len(self.back)), self.first, assume_unique=True)] = True
        return covered(self.start[repeat], self.window, len(self.h))


def match_blocks(table: pa.Table) -> pa.Table:
    """For each asked hash: is it a reference block, and does it stand in two places or more?"""
    h, sizes = gather(table.column("hashes"), np.uint32)
    twice, block = (unbits(table.column(c).to_pylist(), sizes) for c in ("twice", "blocks"))
    order = np.argsort(h, kind="stable")
    group = np.cumsum(first_of_runs(h[order])) - 1
    hit = (np.bincount(group, 1 + twice[order]) >= 2) & (np.bincount(group, block[order]) > 0)
    found = np.zeros(len(h), bool)
    found[order] = hit[group]
    return answers(table.column("bucket").to_pylist(), table.column("part")[0].as_py(), 1, found, sizes, bits)


def find_earlier(table: pa.Table) -> pa.Table:
    """For each bucket's first copy of a window: does another bucket hold an earlier one?"""
    h, sizes = gather(table.column("hashes"), np.uint64)
    buckets = table.column("bucket").to_pylist()
    keys = []
    for k, x, n in zip(table.column("keys").to_pylist(), table.column("index").to_pylist(), sizes):
        keys.append(np.frombuffer(k, np.int64)[np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)])
    key, bucket = np.concatenate(keys), np.repeat(np.array(buckets, np.int64), sizes)
    order = np.lexsort((bucket, key, h))
    later = np.zeros(len(h), bool)
    later[order] = ~first_of_runs(h[order])
    return answers(buckets, table.column("part")[0].as_py(), 2, later, sizes, bits)


def remove_repeated_words(samples: DataFrame, key: str = "sample_id", text: str = "text", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Remove from every sample text the words of ``window``-word passages that stand earlier in the samples.

    ``samples`` has a sample id, an integer or a text in its order, and a text (a grounding description or a whole
    annotation document); words stand between ASCII blanks. A passage of ``window`` words holds at least one whole block of half as many words,
    whatever its alignment: the blocks of all texts are the index, every rolling window of that length probes it, and
    a hit counts when its hash stands in two places or more. Around hits the passages of full length are compared;
    one that also starts earlier (smaller id, or further ahead in the same text) is a repeat, and runs of repeats
    join to the maximal exact repeat. Passages are judged on the input, so a removed text still counts as a copy.

    Texts are dealt to buckets by a hash, each bucket asks about its different hashes only, and a hash is answered in
    one part of the hash range; no task holds more than a bucket, or a part and one entry for each bucket.

    Returns (key, n_words, n_removed, kept), one row for each input row; ``kept`` has the words left, joined by one
    blank. Null and blank texts have no words and an empty ``kept``. A null id is before all others; of equal rows the
    first one is kept, and equal ids with different texts are in the order of their buckets. Other columns are not
    read. Empty input gives no rows.
    """
    if not integer_ids(samples, key):
        ids = numbered_ids(samples, key)
        out = remove_repeated_words(by_number(samples, key, text, ids), "_number", "text", window, bucket_bytes, part_bytes)
        return out.join(ids, "_number", "left").select(F.col("_id").alias(key), "n_words", "n_removed", "kept")
    total = text_bytes(samples, text)
    parts = max(1, -(-total // part_bytes))
    rows = bucketed(samples, key, text, total, bucket_bytes)

    def ask(table: pa.Table) -> pa.Table:
        return Bucket(table, window, parts).probes(table.column("bucket")[0].as_py())

    def compare(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ("hashes", "keys", "index")}})
        bucket = Bucket(table, window, parts)
        bucket.candidates(reply)
        return bucket.windows(table.column("bucket")[0].as_py())

    def finish(table: pa.Table, reply: pa.Table) -> pa.Table:
        bucket = Bucket(table, window, parts)
        bucket.candidates(reply)
        gone = bucket.removed(reply)
        n_words, n_removed, kept = [], [], []
        for text_, a, b in zip(bucket.texts, bucket.firsts, bucket.firsts[1:]):
            words, out = text_.split(), gone[a:b]
            n_words.append(len(words))
            n_removed.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out.tolist()) if not x) if n_removed[-1] else b" ".join(words))
        return pa.table({"key": pa.array(bucket.keys, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    grouped = rows.groupBy("bucket")
    hits = grouped.applyInArrow(ask, question_schema("hashes", "twice", "blocks")).groupBy("part").applyInArrow(match_blocks, ANSWER)
    passages = grouped.cogroup(hits.groupBy("bucket")).applyInArrow(compare, question_schema("hashes", "keys", "index"))
    earlier = passages.groupBy("part").applyInArrow(find_earlier, ANSWER)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = grouped.cogroup(hits.unionByName(earlier).groupBy("bucket")).applyInArrow(finish, schema)
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept")
