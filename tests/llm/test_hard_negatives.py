"""Hard-negative mining against a full comparison, and the bounds against every score they stand for."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenesift.llm import hard_negatives as hn
from scenesift.llm.hard_negatives import angles_to, fit_directions, mine_hard_negatives, pack, score_bounds, unpack

SCHEMA = "sample_id long, class_name string, feature array<double>, row int, asked boolean"


def plain(rows, asks, positives=5, negatives=3):
    good = []
    for k, c, f in rows:
        if c is None or f is None or any(x is None or not math.isfinite(x) for x in f):
            continue
        v = [math.floor(256 * x) for x in f]
        if sum(x * x for x in v) <= 2**62:
            good.append((k, c, v))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (k, c, v) in enumerate(good):
        if not asks(k):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, d) for m, (j, d, w) in enumerate(good) if m != n]
        mine = sorted((x for x in scored if x[2] == c), key=order)[:positives]
        for p, j, _ in mine:
            hard = sorted((x for x in scored if x[2] != c and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:negatives]
            out += [(k, j, rank + 1, i, p, s) for rank, (s, i, _) in enumerate(hard)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)
    return sorted(map(tuple, mine_hard_negatives(frame, anchors=F.col("sample_id") % 5 == 0, **options).collect()), key=repr)


def asks(k):
    return k is not None and k % 5 == 0


def crowd(seed, n, dim=6, classes=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    rows = []
    for k in range(n):
        v = centres[r.integers(5)] * r.uniform(0.2, 3) + r.normal(size=dim) * r.choice([0.05, 1.0])
        rows.append((k, f"c{min(r.integers(classes), 3)}", [float(x) for x in v]))
    return rows


@pytest.mark.parametrize("part,block,chunk", [(32_768, 32_768, 64), (40, 7, 3)])
def test_against_all_pairs(spark, monkeypatch, part, block, chunk):
    for name, value in (("PART_ROWS", part), ("LEAST_PART_ROWS", part), ("BLOCK_ANCHORS", block), ("CHUNK_ANCHORS", chunk), ("RUN", 8)):
        monkeypatch.setattr(hn, name, value)
    rows = crowd(1, 300)
    rows += [(k, "c1", rows[10][2]) for k in range(1000, 1120)] + [(k, "c2", rows[10][2]) for k in range(1200, 1230)]  # copies: all tie
    assert mined(spark, rows) == plain(rows, asks)


def test_odd_rows(spark):
    rows = crowd(2, 60)
    rows += [(100, None, [1.0] * 6), (105, "c0", None), (110, "c0", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (115, "c0", [math.nan] * 6), (120, "c0", [math.inf] + [0.0] * 5)]
    rows += [(125, "c0", [0.0] * 6), (130, "c0", []), (135, "c1", [1.0, 2.0]), (140, "c1", [1e300] * 6), (145, "c1", [2e6] * 6), (150, "c2", [1.9e6] * 6), (155, "c1", [2e6] * 6)]
    rows += [(None, "c0", rows[0][2]), (0, "c0", rows[0][2]), (0, "c0", rows[0][2]), (160, "alone", [1.0] * 6)]
    assert mined(spark, rows) == plain(rows, asks)
    assert mined(spark, []) == [] and mined(spark, [(1, "a", [1.0]), (2, "b", [1.0])]) == []
    assert mined(spark, rows[:30], positives=2, negatives=1, directions=0) == plain(rows[:30], asks, 2, 1)


def test_bounds_hold_and_cut(spark):
    r = np.random.default_rng(3)
    vectors = np.floor(256 * np.concatenate([r.normal(size=5) * 3 + r.normal(size=(64, 5)) * 0.1 for _ in range(20)])).astype(np.int64)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    angles = angles_to(vectors, norms, fit_directions(vectors, 8))
    starts = np.arange(0, len(vectors), 64)
    lower, upper = score_bounds(
        angles, norms, np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts), np.minimum.reduceat(norms, starts), np.maximum.reduceat(norms, starts))
    exact = vectors @ vectors.T
    assert (np.minimum.reduceat(exact, starts, axis=1) >= lower).all() and (np.maximum.reduceat(exact, starts, axis=1) <= upper).all()
    best = np.sort(exact, axis=1)[:, -6]
    assert (upper < best[:, None]).mean() > 0.5  # on clustered features most runs are never scored


def test_packed_vectors():
    r = random.Random(4)
    vectors = [np.array([r.randint(-top, top) for _ in range(n)], np.int64) for top, n in ((5, 3), (40_000, 4), (1 << 40, 2), (1, 0))]
    out = unpack([pack(v) for v in vectors], 4)
    assert [x.tolist() for x in out] == [v.tolist() + [0] * (4 - len(v)) for v in vectors]
