"""Connected components against a plain union-find."""

import random

import pytest

from scenesift.llm.components import connected, extended


@pytest.mark.parametrize("task_edges", [0, 60, 500_000])
def test_components(spark, task_edges):
    r = random.Random(6)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5), (-3, 3), (-3, 3)]
    root = {k: k for p in pairs for k in p}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in connected(spark.createDataFrame(pairs, "lo long, hi long"), task_edges).collect()}
    assert got == {k: find(k) for p in pairs if p[0] != p[1] for k in p}
    assert connected(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_groups_extended_by_links(spark):
    r = random.Random(7)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(240)]
    frame = lambda rows: spark.createDataFrame(rows, "lo long, hi long")
    groups = extended(connected(frame(pairs[:120])), frame(pairs[120:]))
    assert {tuple(x) for x in groups.collect()} == {tuple(x) for x in connected(frame(pairs)).collect()}
    assert groups.count() == groups.select("node").distinct().count()
    assert extended(groups, frame([])).count() == groups.count()
