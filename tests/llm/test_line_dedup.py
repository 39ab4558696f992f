"""Line dedup against a plain version that compares all starts."""

import random

import pytest

from scenesift.llm.line_dedup import remove_repeated_lines

from . import brute


def documents(seed=5, n=80):
    """Annotation documents of short lines with shared runs, blank lines and copies."""
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["mug", "box", "on", "the", "table"]) + str(r.randint(0, 3)) for _ in range(r.randint(1, 4)))
    runs = [[line() for _ in range(r.randint(2, 9))] for _ in range(8)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(r.randint(0, 4)):
            lines += r.choice(runs) if r.random() < 0.5 else [line() for _ in range(r.randint(1, 5))]
            if r.random() < 0.3:
                lines.append(r.choice(["", "  ", "\t"]))
        if r.random() < 0.2 and len(lines) > 2:
            lines.insert(r.randrange(len(lines)), "")
        rows.append((k, "\n".join(lines)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, "\n".join(["same words here"] * 40)), (103, ""), (104, "\n\n \n")]
    return rows


@pytest.mark.parametrize("min_words", [1, 4, 10, 17])
def test_runs(spark, min_words):
    rows = documents()
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "sample_id long, text string, n_lines int, seq int").repartition(4)
    out = remove_repeated_lines(docs, min_words=min_words).collect()
    got = sorted((r.sample_id, r.n_lines, r.n_removed, r.kept) for r in out)
    assert got == sorted(brute.removed_lines(rows, min_words))
    assert any(r[2] for r in got) and all(r.seq == 2 for r in out)


def test_nulls_and_repeated_rows(spark):
    text = "one two three four five six\nseven eight nine ten eleven"
    rows = [(None, text), (3, text), (3, text), (4, None)]
    out = remove_repeated_lines(spark.createDataFrame(rows, "sample_id long, text string")).collect()
    assert sorted((r.sample_id or 0, r.n_removed, r.kept or "-") for r in out) == [(0, 0, text), (3, 2, "-"), (3, 2, "-"), (4, 0, "-")]
    assert remove_repeated_lines(spark.createDataFrame([], "sample_id long, text string")).count() == 0


def test_columns_of_the_samples_cannot_clash(spark):
    text = "one two three four five six\nseven eight nine ten eleven"
    names = ["_doc_row", "_doc_key", "_doc_text", "_own", "_lines", "_gone", "names"]
    rows = spark.createDataFrame([(k, text, *range(7)) for k in (1, 2)], "sample_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = {r.sample_id: r for r in remove_repeated_lines(rows).collect()}
    assert [out[1].n_removed, out[2].n_removed] == [0, 2]
    assert all([r[n] for n in names] == list(range(7)) for r in out.values())
