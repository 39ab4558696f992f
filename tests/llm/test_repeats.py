"""Repeated passages: suffix-array dedup and substring dedup against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scenesift.llm.deep_shallow import sort_suffixes
from scenesift.llm.substring_dedup import remove_repeated_words
from scenesift.llm.suffix_dedup import Bucket, judge_contexts, remove_repeated_bytes

from . import brute

SCHEMA = "sample_id long, text string, scene_id string, bucket int, key string"


def grounding_texts(seed=3, n=120):
    """Sample descriptions with shared passages, edited copies, repeats within a text, ties and odd rows."""
    r = random.Random(seed)
    vocabulary = ["mug", "red", "table", "left", "Über", "the", "of", "chair", "brown", "scene", "près", "box", "on", "upright", "ñandú"]
    say = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", "s", "1"]) for _ in range(k))
    passages = [say(r.randint(25, 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        text = "\n".join([say(r.randint(1, 30))] + [p for p in r.sample(passages, r.choice([0, 0, 1, 2]))] + [say(r.randint(0, 12))])
        if k % 9 == 0 and rows:
            words = rows[-1][1].split(" ") if rows[-1][1] else []
            if words:
                words[r.randrange(len(words))] = "edited"
            text = " ".join(words)
        rows.append((k, text))
    rows += [(200, ""), (201, None), (202, "ab " * 400), (203, "x" * 900), (204, rows[3][1]), (204, rows[3][1]), (205, " \n\t "), (206, passages[0] + " " + passages[0])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, t, "scene_1", 3, "x") for k, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("length", [60, 200])
def test_bytes(spark, length):
    rows = grounding_texts()
    out = remove_repeated_bytes(table(spark, rows), length=length, bucket_bytes=4000, part_bytes=9000).collect()
    got = sorted((r.sample_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out)
    assert got == sorted(brute.removed_bytes(rows, length))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [1, 3])
def test_bytes_under_hot_anchors(spark, hot):
    """Strings dealt by hash give what the suffix sort gives, also where contexts of one anchor stand twice."""
    rows = grounding_texts()
    passage = rows[3][1] + " " + rows[10][1] + " the brown mug on the left table, upright beside the red box " * 3
    rows += [(300 + k, f"object {k} {k * k} " + passage[: len(passage) - 7 * (k % 5)] + f" in view {k % 11}") for k in range(40)]
    out = remove_repeated_bytes(table(spark, rows), length=60, bucket_bytes=4000, part_bytes=9000, hot_contexts=hot).collect()
    got = sorted((r.sample_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out)
    assert got == sorted(brute.removed_bytes(rows, 60))


def test_anchors_spread_over_parts(spark):
    """An anchor is the least of many hashes; the parts must share the contexts all the same."""
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(40000)).encode()]
    bucket = Bucket(pa.table({"bucket": [0], "key": [1], "text": pa.array(texts, pa.binary())}), 200, 10)
    sizes = [b - a for _, a, b in bucket.cut]
    assert len(sizes) == 10 and max(sizes) < 2 * sum(sizes) / 10


def test_answers_do_not_depend_on_the_order_of_the_questions():
    texts = [(t or "").encode() for _, t in grounding_texts()]
    asked = [Bucket(pa.table({"key": list(range(20)), "text": pa.array(texts[k : k + 20], pa.binary())}), 60, 1).questions(k) for k in range(0, 120, 20)]
    found = [sorted(judge_contexts(pa.concat_tables(x), 1).to_pylist(), key=lambda r: r["bucket"]) for x in (asked, asked[::-1], asked[3:] + asked[:3])]
    assert found[0] == found[1] == found[2] and any(max(r["reply"]) >= 7 for r in found[0])


def test_bytes_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = remove_repeated_bytes(docs, key="doc_id", bucket_bytes=60000, part_bytes=90000).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out)
    assert got == sorted(brute.removed_bytes(rows, 200))


@pytest.mark.parametrize("window", [6, 20])
def test_words(spark, window):
    rows = grounding_texts()
    out = remove_repeated_words(table(spark, rows), window=window, bucket_bytes=4000, part_bytes=9000).collect()
    got = sorted((r.sample_id, r.n_words, r.n_removed, r.kept) for r in out)
    assert got == sorted(brute.removed_words(rows, window))
    assert any(r[2] for r in got)


def test_words_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    out = remove_repeated_words(docs, key="doc_id", bucket_bytes=60000, part_bytes=90000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute.removed_words(rows, 20)


def test_null_ids_and_empty_tables(spark):
    passage = " ".join(f"w{n}" for n in range(30))
    rows = [(None, passage), (5, passage + " tail"), (None, None)]
    out = {(r.sample_id, r.n_words): r.n_removed for r in remove_repeated_words(table(spark, rows)).collect()}
    assert out == {(None, 30): 0, (5, 31): 30, (None, 0): 0}
    assert remove_repeated_words(table(spark, rows).limit(0)).count() == 0
    assert remove_repeated_bytes(table(spark, rows).limit(0)).count() == 0
    lone = remove_repeated_bytes(table(spark, [(None, None), (1, "")])).collect()
    assert sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in lone) == [(0, 0, b""), (0, 0, b"")]


def test_deep_shallow_sort():
    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (300, 64)).astype(np.uint8)
    rows[:, :24] = 97
    rows[200:] = rows[:100]
    order, prefix = sort_suffixes(rows)
    strings = [rows[k].tobytes() for k in order]
    assert strings == sorted(x.tobytes() for x in rows)
    for a, b, n in zip(strings, strings[1:], prefix[1:]):
        assert a[:n] == b[:n] and (n == 64 or a[n] != b[n])


def test_words_under_text_ids(spark):
    rows = grounding_texts()
    name = lambda k: f"scene_frame_mug_p{k:05d}"
    docs = spark.createDataFrame([(name(k), t) for k, t in rows], "sample_id string, text string").repartition(3)
    numbers = {name(r.sample_id): r[1:] for r in remove_repeated_words(table(spark, rows)).collect()}
    got = remove_repeated_words(docs).collect()
    assert {r.sample_id: r[1:] for r in got} == numbers and any(r.n_removed for r in got)
    assert remove_repeated_words(docs.limit(0)).count() == 0
