"""Overlaps of turned boxes, and the size of the test that box suppression puts on a pair."""

import math
import random

from pyspark.sql import functions as F

from scenesift.functions import boxes as bx
from scenesift.operators import evaluation as ev
from tests.test_reports import overlap_of

NAMES = [f"{side}_{f}" for side in "ab" for f in bx.BOX_FIELDS]


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def paired(spark, rows):
    df = spark.createDataFrame([(n, *a, *b) for n, (a, b) in enumerate(rows)], "n int, " + ", ".join(c + " double" for c in NAMES))
    return df.select("n", *[bx.box(*[F.col(c) for c in NAMES[k : k + 7]]).alias(name) for k, name in ((0, "pred"), (7, "gt"))])


def test_turned_boxes_are_measured_by_batches(spark):
    r = random.Random(3)
    one = lambda: [r.uniform(-2, 2), r.uniform(-2, 2), 0.0, r.uniform(0.2, 4), r.uniform(0.2, 4), 1.0, r.choice([0.0, math.pi / 2, r.uniform(-7, 7)])]
    rows = [(one(), one()) for _ in range(400)]
    rows[:3] = [(rows[0][0], rows[0][0]), ([None, *rows[1][0][1:6], 0.7], rows[1][1]), (rows[2][0], [*rows[2][1][:2], 9.0, *rows[2][1][3:]])]
    df = paired(spark, rows).select("n", "pred", "gt", bx.iou3d(F.col("pred"), F.col("gt")).alias("iou"), bx.giou3d(F.col("pred"), F.col("gt")).alias("giou"))
    assert "transform(" not in plan_text(df) and "aggregate(" not in plan_text(df).lower().replace("aggregate [", "")
    turn = lambda b: [(b[0] + math.cos(b[6]) * x - math.sin(b[6]) * y, b[1] + math.sin(b[6]) * x + math.cos(b[6]) * y) for x in (-b[3] / 2, b[3] / 2) for y in (-b[4] / 2, b[4] / 2)]
    for x in df.collect():
        a, b = rows[x.n]
        if None in a:
            # A box without a place shares nothing, and the hull is that of the other numbers.
            assert x.iou == 0.0 and x.giou is not None
            continue
        near = max(0.0, min(a[2], b[2]) + 0.5 - max(a[2], b[2]) + 0.5)
        shared = overlap_of((a[0], a[1], a[3], a[4], a[6]), (b[0], b[1], b[3], b[4], b[6])) * near
        union = a[3] * a[4] + b[3] * b[4] - shared
        at = turn(a) + turn(b)
        hull = (max(p[0] for p in at) - min(p[0] for p in at)) * (max(p[1] for p in at) - min(p[1] for p in at)) * (abs(a[2] - b[2]) + 1)
        assert abs(x.iou - shared / union) < 1e-9 and abs(x.giou - (shared / union - (hull - union) / hull)) < 1e-9, (x, a, b)


def test_pairs_are_tested_by_a_short_formula(spark):
    """The choice of the better box was repeated for every number in the overlap of a pair."""
    boxes = paired(spark, [([0.0, 0.0, 0.0, 2.0, 2.0, 1.0, 0.1], [0.0] * 7), ([0.5, 0.0, 0.0, 2.0, 2.0, 1.0, 0.2], [0.0] * 7)])
    boxes = boxes.select(F.lit(1).alias("g"), "n", F.col("pred").alias("box"), F.struct((-F.col("n").cast("double")).alias("s"), "n").alias("rank_key"))
    for rotated, most in ((False, 10), (True, 90)):
        edges = ev.overlap_edges(boxes, ["g"], "n", 0.3, rotated)
        assert plan_text(edges).count("CASE WHEN") < most
        assert [tuple(x) for x in edges.collect()] == [(1, 1, 0)]
