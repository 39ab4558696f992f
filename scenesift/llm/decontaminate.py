"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import integer_ids, mix, tokens, window_hashes, window_ok

#: Words of an item in a hundred that may be inserted, deleted or replaced.
EDITS = 20
#: Random walks, tables for each, and embedded places that a table samples. The walk keeps most places of a window
#: with few edits; 24 x 8 tables of two places find nine in ten of those with the most edits allowed, and all exact ones.
WALKS, TABLES, SAMPLED = 24, 8, 2
#: Items that one pass holds; more items make more passes over the texts.
BLOCK_ITEMS = 5_000
CHUNK = 8 << 20
#: Windows that are embedded at a time.
WINDOWS = 2000
FILTER_BITS = np.uint64(20)

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.IntegerType())])


def allowed(n_words: int) -> int:
    return n_words * EDITS // 100


def drawn(n: int) -> np.ndarray:
    """Places (walk, table, sample) of an embedding of ``n`` words that the tables sample."""
    draw = mix(np.arange(WALKS * TABLES * SAMPLED, dtype=np.uint64) + np.uint64(n << 32))
    return (draw % np.uint64(3 * n)).astype(np.int64).reshape(WALKS, TABLES, SAMPLED)


def walk_odds(steps: int) -> np.ndarray:
    """(step, walk) odd multipliers: the top bit of multiplier times word hash says whether a walk moves on."""
    return mix(np.arange(1, steps * WALKS + 1, dtype=np.uint64)).reshape(steps, WALKS) | np.uint64(1)


def embed(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(step, walk, row) pointers of the CGK walks over rows of word hashes; an embedding is three times as long.

    Every step copies the word at the pointer, then moves on or stays: a random bit of (walk, step, word). Two texts
    that differ by an edit soon walk together again, so a small edit distance becomes a small Hamming distance.
    """
    m, n = words.shape
    at, row, steps = np.zeros((WALKS, m), np.int64), np.arange(m), 3 * (n - 1)
    trail, odds = np.zeros((steps, WALKS, m), np.int32), walk_odds(steps)
    for step in range(steps):
        trail[step] = at
        at += ((words[row, at] * odds[step][:, None]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, lengths, out=at)
    return trail


def table_keys(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(walk, table, row) keys of rows of word hashes, filled up with zeros: a hash of the sampled embedded words."""
    padded = np.concatenate((words, np.zeros((len(words), 1), np.uint64)), axis=1)
    trail = embed(padded, lengths)
    keys = np.zeros((WALKS, TABLES, len(words)), np.uint64)
    table = np.arange(WALKS * TABLES, dtype=np.uint64).reshape(WALKS, TABLES, 1)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        h = np.broadcast_to(mix(table + np.uint64(int(n) << 32)), (WALKS, TABLES, len(rows)))
        for sample in np.moveaxis(drawn(int(n)), 2, 0):
            at = trail[sample[:, :, None], np.arange(WALKS)[:, None, None], rows[None, None, :]]
            h = mix(h ^ padded[rows[None, None, :], at])
        keys[:, :, rows] = h
    return keys


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the stretch of the text that is nearest to the item; the first such end wins."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, word in enumerate(item, 1):
        stay = np.append(k, np.minimum(cost[1:] + 1, cost[:-1] + (text != word)))
        began = np.append(start[0], np.where(cost[:-1] + (text != word) <= cost[1:] + 1, start[:-1], start[1:]))
        # A word of the text left over costs one: the least of stay[j] + (here - j) up to here.
        least = np.minimum.accumulate(stay - steps)
        source = np.maximum.accumulate(np.where(stay - steps == least, steps, 0))
        cost, start = least + steps, began[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """A block of benchmark items: exact seeds, LSH tables for each length, and the words for verification."""

    def __init__(self, rows: list[tuple[int, str]]):
        _, _, _, h, firsts = tokens([(t or "").encode().lower() for _, t in rows])
        self.ids = [k for k, _ in rows]
        self.words = [h[a:b] for a, b in zip(firsts, firsts[1:])]
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for item, words in enumerate(self.words):
            n = len(words)
            if not n:
                continue
            # Pigeonhole: cut into one piece more than there may be edits, and one piece stands unchanged.
            size = n // (allowed(n) + 1)
            grams = window_hashes(words, size)
            seeds.setdefault(size, []).extend((int(grams[at]), item, at) for at in range(0, size * (allowed(n) + 1), size))
        self.seeds = {}
        for size, rows_ in seeds.items():
            rows_.sort()
            h = np.array([r[0] for r in rows_], np.uint64)
            sieve = np.zeros(1 << int(FILTER_BITS), bool)
            sieve[(h >> (np.uint64(64) - FILTER_BITS)).astype(np.int64)] = True
            # What a seed asks for is a window of the item's length with the seed at its place.
            self.seeds[size] = (sieve, h, np.array([[len(self.words[r[1]]), r[2]] for r in rows_], np.int64))
        some = [k for k, w in enumerate(self.words) if len(w)]
        lengths = np.array([len(self.words[k]) for k in some], np.int64)
        self.width = int(lengths.max()) if some else 1
        keys = table_keys(self._rows([self.words[k] for k in some]), lengths).reshape(WALKS * TABLES, -1)
        # One sorted array for all tables, whose number is part of each key.
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owners = keys.ravel()[order], np.tile(np.array(some, np.int64), WALKS * TABLES)[order]

    def _rows(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words), self.width), np.uint64)
        for k, w in enumerate(words):
            out[k, : len(w)] = w
        return out

    def windows(self, h: np.ndarray, firsts: np.ndarray) -> dict[int, np.ndarray]:
        """(text, start) of the windows of each item length that hold an exact seed at its place.

        A window may begin before its text or end after it.
        """
        found: dict[int, list[np.ndarray]] = {}
        for size, (sieve, seeds, wanted) in self.seeds.items():
            grams = window_hashes(h, size)
            at = np.flatnonzero(sieve[(grams >> (np.uint64(64) - FILTER_BITS)).astype(np.int64)])
            at = at[window_ok(firsts, len(grams), size)[at]]
            a, b = np.searchsorted(seeds, grams[at], "left"), np.searchsorted(seeds, grams[at], "right")
            while (a < b).any():
                some = a < b
                ask = wanted[a[some]]
                place = np.stack([np.searchsorted(firsts, at[some], side="right") - 1, at[some] - ask[:, 1]])
                for n in np.unique(ask[:, 0]):
                    found.setdefault(int(n), []).append(place[:, ask[:, 0] == n])
                a = a + 1
        return {n: np.unique(np.concatenate(x, axis=1), axis=1) for n, x in found.items()}

    def scan(self, texts: list[bytes]) -> list[list[dict]]:
        """Nearest place of every leaked item in each text."""
        _, _, _, h, firsts = tokens([t.lower() for t in texts])
        best: list[dict[int, tuple]] = [{} for _ in texts]
        found = self.windows(h, firsts)
        if found:
            text, start = (np.concatenate([w[k] for w in found.values()]) for k in (0, 1))
            n = np.repeat(np.fromiter(found, np.int64), [w.shape[1] for w in found.values()])
            for a in range(0, len(text), WINDOWS):
                self._judge(h, firsts, text[a : a + WINDOWS], start[a : a + WINDOWS], n[a : a + WINDOWS], best)
        return [[{"item_id": self.ids[k], "first_word": v[1], "n_words": v[2], "distance": v[0]} for k, v in sorted(b.items())] for b in best]

    def _judge(self, h, firsts, text, start, n, best):
        place = start[:, None] + np.arange(self.width)[None, :]
        lo, hi = firsts[text], firsts[text + 1]
        inside = (place >= lo[:, None]) & (place < hi[:, None]) & (np.arange(self.width)[None, :] < n[:, None])
        words = np.where(inside, h[np.clip(place, 0, len(h) - 1)], np.uint64(0))
        keys = table_keys(words, n).reshape(WALKS * TABLES, -1)
        a, b = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        pairs = set()
        while (a < b).any():
            some = np.nonzero(a < b)
            pairs.update(zip(some[1].tolist(), self.owners[a[some]].tolist()))
            a = a + 1
        for row, item in sorted(pairs):
            known, edits = best[text[row]], allowed(int(n[row]))
            if known.get(item, (1,))[0] == 0:
                continue
            x, y = max(int(lo[row]), int(start[row]) - edits), min(int(hi[row]), int(start[row] + n[row]) + edits)
            distance, began, ended = best_match(self.words[item], h[x:y])
            if distance <= edits and distance < known.get(item, (edits + 1,))[0]:
                known[item] = (distance, x - int(lo[row]) + began, ended - began)


def find_leaks(samples: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Benchmark items that stand, whole and with few edits, in the sample texts.

    ``samples`` has a text (a grounding description or a whole annotation document); ``items`` are the held-out
    benchmark: an id, integer or text, and the item's text. A-Z are lower-cased, words stand between ASCII blanks. An item leaks when
    some stretch of a text has an edit distance in words of at most a fifth of the item's words. One of its pieces,
    one more than the edits allowed, then stands unchanged: exact seeds place windows of the item's length, CGK walks
    embed them, repeated samples of places are the LSH keys that an item must share, and each candidate is verified by
    the exact distance of the item to the nearest stretch around the window.

    Items are a stated query set: each block of ``block_items`` is sent to the tasks and run against all texts, one
    block after the other, without a shuffle. Returns the columns of ``samples`` and ``leaks``, an array of (item_id,
    first_word, n_words, distance) by item; a column of that name is replaced. Null and empty texts, and items
    without words, leak nothing. Equal items are reported each. Empty tables give no rows or no leaks.
    """
    number = integer_ids(items, item)
    known = items.select(F.col(item).cast("long" if number else "string").alias("k"), F.col(item_text).alias("t"))
    leak = LEAK if number else T.StructType([T.StructField("item_id", T.StringType()), *LEAK.fields[1:]])
    blocks = max(1, -(-known.count() // block_items))
    own = [c for c in samples.columns if c != "leaks"]
    out = samples.select(*own, F.lit(None).cast(T.ArrayType(leak)).alias("leaks"))
    kind = pa.list_(pa.struct([("item_id", pa.int64() if number else pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())]))
    for block in range(blocks):
        chosen = known.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).orderBy("k", "t")
        # A block's index takes some 3 kB for each item.
        held = samples.sparkSession.sparkContext.broadcast(Items([(r["k"], r["t"]) for r in chosen.collect()]))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
                leaks, at, size = [], 0, 0
                for n, content in enumerate(texts):
                    size += len(content)
                    if size >= CHUNK or n == len(texts) - 1:
                        leaks += index.scan(texts[at : n + 1])
                        at, size = n + 1, 0
                before = batch.column("leaks").to_pylist()
                both = pa.array([(x or []) + y for x, y in zip(before, leaks)], kind)
                columns = [both if c == "leaks" else batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(scan, out.schema)
    return out
