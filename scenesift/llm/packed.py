"""Questions from buckets of texts to parts of a hash range, and the answers, as packed arrays.

A bucket asks about each of its different hashes once, sorted, so that a part's questions are one slice; a part
answers every slice in the order in which it was asked. Hot hashes therefore cost one entry for each bucket, and the
bucket, which can work its hashes out again from its texts, needs no ids back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

QUESTION = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
ANSWER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("reply", T.BinaryType()), T.StructField("extra", T.BinaryType())])


def question_schema(*names: str) -> T.StructType:
    return T.StructType([*QUESTION.fields, *[T.StructField(n, T.BinaryType()) for n in names]])


def slices(sorted_hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of each part's hashes; a part is an even range of the hashes' upper half."""
    part = ((sorted_hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] ^ np.uint64(1))) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def rows_of(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Keys and texts of a bucket in the order that every step uses: by key, null first, then by text."""
    keys, texts = table.column("key").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    texts = [t or b"" for t in texts]
    order = sorted(range(len(keys)), key=lambda n: (keys[n] is not None, keys[n] or 0, texts[n]))
    return [keys[n] for n in order], [texts[n] for n in order]


def gather(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, length of each row) of a column of packed arrays."""
    rows = [np.frombuffer(b, dtype) for b in column.to_pylist()]
    return (np.concatenate(rows) if rows else np.zeros(0, dtype)), np.array([len(r) for r in rows], np.int64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(packed: list[bytes], sizes) -> np.ndarray:
    """The flags of several packed rows, one after the other."""
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)).astype(bool) for b, n in zip(packed, sizes)] or [np.zeros(0, bool)])


def answers(buckets: list[int], part: int, kind: int, values: np.ndarray, sizes: np.ndarray, pack) -> pa.Table:
    """One answer for each asking row, cut from the values in the order of the rows."""
    ends = np.cumsum(sizes)
    reply = [pack(values[e - n : e]) for e, n in zip(ends, sizes)]
    n = len(buckets)
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "part": pa.array([part] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "reply": pa.array(reply, pa.binary()), "extra": pa.nulls(n, pa.binary())})


def replies(table: pa.Table, kind: int) -> list[tuple[bytes, bytes | None]]:
    """(reply, extra) of one kind, by part."""
    found = [(p, r, x) for p, k, r, x in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "reply", "extra"))) if k == kind]
    return [(r, x) for _, r, x in sorted(found, key=lambda f: f[0])]


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new
