"""Suffix-array dedup: bytes of texts that lie in strings repeated anywhere in the samples are removed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import BUCKET_BYTES, PRIME, SEED, bucketed, covered, joined_bytes, mix, text_bytes
from scenesift.llm.deep_shallow import sort_suffixes
from scenesift.llm.packed import ANSWER, answers, bits, first_of_runs, gather, question_schema, replies, rows_of, slices, unbits

LENGTH = 200
PART_BYTES = 8 << 20
#: Window starts that are hashed at a time, whatever the length of a text.
SEGMENT = 1 << 17
POSITION = np.uint64((1 << 24) - 1)
FULL, SEND, HOT = 1, 2, 4
#: Different contexts of one anchor that are sorted in one task; strings under the contexts of others are dealt by hash.
HOT_CONTEXTS = 2048
#: Contexts whose strings are hashed at a time.
CHUNK = 4096


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    base, inverse = int(SEED) | 1, pow(int(SEED) | 1, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every run of ``width`` keys: prefix and suffix minima of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    block = padded.reshape(-1, width)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Bucket:
    """The texts of one bucket with their anchors.

    Each string of ``length`` bytes has an anchor: the place in it whose gram of half its length has the smallest
    hash. Equal strings have equal anchors at equal offsets. Strings next to each other mostly share an anchor, and
    the bytes under all of an anchor's strings are its context.
    """

    def __init__(self, table: pa.Table, length: int, parts: int):
        self.keys, self.texts = rows_of(table)
        self.length, self.gram, self.parts = length, length // 2, parts
        self.data, self.starts = joined_bytes(self.texts)
        found = [self._segment(at) for at in range(0, max(1, len(self.data) - length + 1), SEGMENT)]
        self.place, self.low, self.high, anchor, context = (np.concatenate(x) for x in zip(*found))
        self.context, first, self.which, counts = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
        # An anchor's gram has the smallest of many hashes, so it is mixed again to spread over the parts.
        self.anchor, self.first, self.twice = mix(anchor[first]), first, counts > 1
        self.order = np.lexsort((self.context, self.anchor))
        self.cut = slices(self.anchor[self.order], parts)

    def _segment(self, at: int):
        """(place, first and last string start, gram hash, context hash) of the anchors of one stretch of starts."""
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        data = self.data[at : at + SEGMENT + self.length - 1]
        n = len(data) - self.length + 1
        if n <= 0:
            return none
        up, down = powers(SEGMENT + self.length)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        grams = mix((sums[self.gram :] - sums[: -self.gram]) * down[: len(data) - self.gram + 1])
        keys = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
        place = (least_places(keys, self.length - self.gram + 1) & POSITION).astype(np.int64)
        # Starts whose string ends within the same text.
        a, b = np.clip(self.starts[:-1] - at, 0, n), np.clip(self.starts[1:] - self.length - at, 0, n)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, a[a < b], 1)
        np.add.at(inside, b[a < b], -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(start):
            return none
        place = place[start]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        low, place = start[new], place[new]
        high = start[np.append(new[1:], True)]
        whole = (sums[high + self.length] - sums[low]) * down[low]
        context = mix(mix(whole ^ ((high - low).astype(np.uint64) * PRIME)) ^ (place - low).astype(np.uint64))
        return place + at, low + at, high + at, grams[place], context

    def questions(self, bucket: int) -> pa.Table:
        anchor, context, twice = self.anchor[self.order], self.context[self.order], self.twice[self.order]
        return pa.table({
            "part": pa.array([p for p, _, _ in self.cut], pa.int32()), "bucket": pa.array([bucket] * len(self.cut), pa.int32()),
            "anchors": pa.array([anchor[a:b].tobytes() for _, a, b in self.cut], pa.binary()), "contexts": pa.array([context[a:b].tobytes() for _, a, b in self.cut], pa.binary()),
            "twice": pa.array([bits(twice[a:b]) for _, a, b in self.cut], pa.binary()),
        })

    def codes(self, reply: pa.Table) -> np.ndarray:
        """What the parts said about each context, in the order of ``self.context``."""
        code = np.zeros(len(self.context), np.uint8)
        code[self.order] = np.concatenate([np.frombuffer(r, np.uint8) for r, _ in replies(reply, 1)] or [np.zeros(0, np.uint8)])
        return code

    def contexts(self, bucket: int, code: np.ndarray) -> pa.Table:
        """The bytes of the contexts that the parts want to sort, and the string hashes under those of hot anchors."""
        wanted = self.order[code[self.order] & (SEND | HOT) == SEND]
        rows = []
        for part, a, b in slices(self.anchor[wanted], self.parts):
            some = wanted[a:b]
            n = self.first[some]
            blob = b"".join(self.data[x : y + self.length].tobytes() for x, y in zip(self.low[n], self.high[n]))
            offsets = np.stack([self.place[n] - self.high[n], self.place[n] - self.low[n]]).astype(np.uint16)
            rows.append((part, self.context[some].tobytes(), offsets[0].tobytes(), offsets[1].tobytes(), bits(code[some] & FULL > 0), blob))
        _, string, _, twice, cut = self.strings(code)
        rows += [(part, string[a:b].tobytes(), None, None, bits(twice[a:b]), None) for part, a, b in cut]
        columns = list(zip(*rows)) or [[]] * 6
        return pa.table({
            "part": pa.array(columns[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
            **{n: pa.array(c, pa.binary()) for n, c in zip(("contexts", "least", "most", "full", "bytes"), columns[1:])},
        })

    def strings(self, code: np.ndarray):
        """Strings under the contexts of hot anchors: (starts, different hashes, hash of each start, seen twice, parts)."""
        some = np.flatnonzero(code & HOT)
        low, size = self.low[self.first[some]], self.high[self.first[some]] - self.low[self.first[some]] + 1
        reach = self.length - self.gram + 1
        up, down = powers(SEGMENT + self.length)
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.data, np.zeros(reach + self.length, np.uint8))), reach + self.length - 1)
        start, string = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(some), CHUNK):
            first = low[at : at + CHUNK, None]
            sums = np.zeros((len(first), reach + self.length), np.uint64)
            np.cumsum((wide[first[:, 0]].astype(np.uint64) + np.uint64(1)) * up[: reach + self.length - 1], axis=1, out=sums[:, 1:])
            found = mix((sums[:, self.length :] - sums[:, :reach]) * down[:reach])
            inside = np.arange(reach) < size[at : at + CHUNK, None]
            start.append((first + np.arange(reach))[inside])
            string.append(found[inside])
        start, string = np.concatenate(start), np.concatenate(string)
        string, which = np.unique(string, return_inverse=True)
        twice = np.bincount(which, np.repeat(1 + (code[some] & FULL > 0), size), len(string)) >= 2
        return start, string, which, twice, slices(string, self.parts)

    def removed(self, code: np.ndarray, masks: list[tuple[bytes, bytes | None]], hot: list[tuple[bytes, bytes | None]]) -> np.ndarray:
        """Mask of the bytes under a repeated string."""
        full = (code & FULL > 0)[self.which]
        step = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(step, self.low[full], 1)
        np.add.at(step, self.high[full] + 1, -1)
        repeat = np.cumsum(step[:-1]) > 0
        width = -(-(self.length - self.gram + 1) // 8)
        for ids, packed in masks:
            at = np.searchsorted(self.context, np.frombuffer(ids, np.uint64))
            # These contexts stand in one place only.
            row, offset = np.nonzero(np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, width), axis=1))
            repeat[self.place[self.first[at[row]]] - offset] = True
        start, _, which, _, cut = self.strings(code)
        repeat[start[unbits([r for r, _ in hot], [b - a for _, a, b in cut])[which]]] = True
        return covered(np.flatnonzero(repeat), self.length, len(self.data))


def judge_contexts(table: pa.Table, hot_contexts: int) -> pa.Table:
    """Which contexts stand in two places, which must be compared with others of their anchor, and is that one hot?"""
    anchor, sizes = gather(table.column("anchors"), np.uint64)
    context, _ = gather(table.column("contexts"), np.uint64)
    times = 1 + unbits(table.column("twice").to_pylist(), sizes)
    # By bucket too: whoever is asked to send must be the same one whenever this runs again.
    bucket = np.repeat(np.array(table.column("bucket").to_pylist(), np.int64), sizes)
    order = np.lexsort((bucket, context, anchor))
    a, c, times = anchor[order], context[order], times[order]
    new = first_of_runs(a, c)
    by_context, by_anchor = np.cumsum(new) - 1, np.cumsum(first_of_runs(a)) - 1
    full = np.bincount(by_context, times)[by_context] >= 2
    different = np.bincount(by_anchor, new)[by_anchor]
    code = np.zeros(len(anchor), np.uint8)
    code[order] = full * FULL + ((different >= 2) & new) * SEND + ((different > hot_contexts) & (different >= 2) & new) * HOT
    return answers(table.column("bucket").to_pylist(), table.column("part")[0].as_py(), 1, code, sizes, lambda x: x.tobytes())


def judge_strings(table: pa.Table) -> pa.Table:
    """Which strings under the contexts of hot anchors stand in two places?"""
    string, sizes = gather(table.column("contexts"), np.uint64)
    times = 1 + unbits(table.column("full").to_pylist(), sizes)
    _, group = np.unique(string, return_inverse=True)
    return answers(table.column("bucket").to_pylist(), table.column("part")[0].as_py(), 3, np.bincount(group, times)[group] >= 2, sizes, bits)


def compare_contexts(table: pa.Table, length: int) -> pa.Table:
    """Sorted contexts and dealt strings of one part."""
    dealt = pc.is_null(table.column("least"))
    out = [judge(rows) for judge, rows in ((lambda t: sort_contexts(t, length), table.filter(pc.invert(dealt))), (judge_strings, table.filter(dealt))) if len(rows)]
    return pa.concat_tables(out)


def sort_contexts(table: pa.Table, length: int) -> pa.Table:
    """For each context that stands once: at which offsets of its anchor is the string of ``length`` bytes repeated?

    The suffixes that begin at the anchors are sorted; neighbours' common prefixes tell which strings agree from the
    anchor on, and a hash tells which agree before it.
    """
    reach = length - length // 2
    context, sizes = gather(table.column("contexts"), np.uint64)
    least, most = (gather(table.column(c), np.uint16)[0].astype(np.int64) for c in ("least", "most"))
    full = unbits(table.column("full").to_pylist(), sizes)
    blob = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    ends = np.cumsum(most + length - least)
    place = ends - (length - least)
    blob = np.concatenate((np.zeros(reach, np.uint8), blob, np.zeros(length, np.uint8)))
    wide = np.lib.stride_tricks.sliding_window_view(blob, length)
    right = wide[place + reach].copy()
    right[np.arange(length)[None, :] >= (length - least)[:, None]] = 0
    left = np.lib.stride_tricks.sliding_window_view(blob, reach)[place][:, ::-1]
    order, prefix = sort_suffixes(right)
    before = np.zeros((len(place), reach + 1), np.uint64)
    np.cumsum((left.astype(np.uint64) + np.uint64(1)) * powers(SEGMENT + length)[0][:reach], axis=1, out=before[:, 1:])
    found = np.zeros((len(place), reach + 1), bool)
    rank = np.zeros(len(place), np.int64)
    for d in range(reach + 1):
        rank[order] = np.cumsum(prefix < length - d)
        some = np.flatnonzero((least <= d) & (d <= most))
        string = mix(before[some, d] ^ mix(rank[some].astype(np.uint64)))
        _, group = np.unique(string, return_inverse=True)
        found[some, d] = np.bincount(group, 1 + full[some])[group] >= 2
    bucket = np.repeat(np.array(table.column("bucket").to_pylist(), np.int64), sizes)
    useful = np.flatnonzero(~full & found.any(axis=1))
    useful = useful[np.argsort(bucket[useful], kind="stable")]
    cuts = np.flatnonzero(first_of_runs(bucket[useful])) if len(useful) else np.zeros(0, np.int64)
    rows = [useful[a:b] for a, b in zip(cuts, [*cuts[1:], len(useful)])]
    part, n = table.column("part")[0].as_py(), len(rows)
    return pa.table({
        "bucket": pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), "part": pa.array([part] * n, pa.int32()), "kind": pa.array([2] * n, pa.int32()),
        "reply": pa.array([context[r].tobytes() for r in rows], pa.binary()), "extra": pa.array([np.packbits(found[r], axis=1).tobytes() for r in rows], pa.binary()),
    })


def remove_repeated_bytes(samples: DataFrame, key: str = "sample_id", text: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Remove from every sample text each byte under a string of ``length`` bytes that also starts anywhere else.

    ``samples`` has a sample id of any type and a text (a grounding description or a whole annotation document), taken
    as UTF-8 bytes; strings stay within one text, may overlap, and are judged on the input. Every such string has an
    anchor chosen by its content, so the suffix array is needed at anchors only. Anchors whose whole context stands
    elsewhere too are settled by hash; for the others that share their gram with a different context the bytes are
    sent to a part of the hash range and the suffixes sorted: multikey quicksort to a shallow depth, blind tries for
    the groups still equal there. The common prefixes of sorted neighbours, with a hash of the bytes before the
    anchor, tell which strings are repeated.

    Texts are dealt to buckets by a hash, and long texts are hashed in stretches. A part holds the different contexts
    of its anchors, equal ones once. An anchor with more than ``hot_contexts`` different ones is not sorted in one
    task: its buckets ask for every string under them by hash, and the strings are dealt over all parts.

    Returns (key, n_bytes, n_removed, spans, kept), one row for each input row: ``spans`` are the maximal removed runs
    as byte offsets [start, end), ``kept`` the remaining bytes. Null texts count as empty, which removes nothing. Ids
    may be null or repeat (a repeated row is a copy, so both lose their strings). Other columns are not read. Empty
    input gives no rows.
    """
    total = text_bytes(samples, text)
    parts = max(1, -(-total // part_bytes))
    rows = bucketed(samples, key, text, total, bucket_bytes)

    def ask(table: pa.Table) -> pa.Table:
        return Bucket(table, length, parts).questions(table.column("bucket")[0].as_py())

    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        bucket = Bucket(table, length, parts)
        return bucket.contexts(table.column("bucket")[0].as_py(), bucket.codes(reply))

    def finish(table: pa.Table, reply: pa.Table) -> pa.Table:
        bucket = Bucket(table, length, parts)
        gone = bucket.removed(bucket.codes(reply), replies(reply, 2), replies(reply, 3))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).reshape(-1, 2)
        first = np.searchsorted(edge[:, 0], bucket.starts)
        out = {"key": bucket.keys, "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for n, content in enumerate(bucket.texts):
            spans = edge[first[n] : first[n + 1]] - bucket.starts[n]
            out["n_bytes"].append(len(content))
            out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in spans])
            inner = [0, *spans.ravel().tolist(), len(content)]
            out["kept"].append(b"".join(content[a:b] for a, b in zip(inner[::2], inner[1::2])) if len(spans) else content)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"key": table.schema.field("key").type, "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.binary()}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    grouped = rows.groupBy("bucket")
    judged = grouped.applyInArrow(ask, question_schema("anchors", "contexts", "twice")).groupBy("part").applyInArrow(lambda table: judge_contexts(table, hot_contexts), ANSWER)
    wanted = grouped.cogroup(judged.groupBy("bucket")).applyInArrow(send, question_schema("contexts", "least", "most", "full", "bytes"))
    masks = wanted.groupBy("part").applyInArrow(lambda table: compare_contexts(table, length), ANSWER)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["key"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    out = grouped.cogroup(judged.unionByName(masks).groupBy("bucket")).applyInArrow(finish, schema)
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "spans", "kept")
