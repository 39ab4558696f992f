"""CRC spans and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scenesift.llm.crc_spans import crc32_spans
from scenesift.llm.importance import chunks, feature_buckets, resample_prompts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def test_crc_of_spans():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(300_000), np.uint8)
    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 192, 1000, 4097, 90_000] + [r.randrange(12) for _ in range(500)]
    starts = [r.randrange(200_000) for _ in sizes]
    got = crc32_spans(data, starts, sizes)
    assert [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, sizes)] == got.tolist()
    assert len(crc32_spans(data, [], [])) == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_features_of_texts(longest):
    texts = ["", "One  two, TWO\n3x", "ÄÖ äö é_e", "x" * 500 + " y", " ", "no\x00end"]
    n_words, n_features, every = feature_buckets([t.encode() for t in texts], longest, 977)
    at = 0
    for t, words, n in zip(texts, n_words, n_features):
        w, features = plain_features(t, longest)
        assert words == len(w) and n == len(features)
        assert Counter(every[at : at + n].tolist()) == Counter(zlib.crc32(f.encode()) % 977 for f in features)
        at += n
    assert [len(c) for c in chunks([b"x" * 5, b"y" * 6, b"z" * 50, b"a"], 12)] == [2, 1, 1]


def plain_resample(rows, target, longest, buckets, percent, min_words, seed):
    told = [(k, *plain_features(t, longest)) for k, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, _, features in told:
        s.update(map(bucket, features))
    for text in target:
        t.update(map(bucket, plain_features(text, longest)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, words, features in told:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        out.append([k, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    for n, x in enumerate(fit[: len(fit) * percent // 100]):
        x[5] = n + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35)])
def test_resampling(spark, longest, percent):
    r = random.Random(longest)
    vocabulary = ["mug", "Table", "red", "near", "the", "ünder", "box7", "x" * 90]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for k in range(300)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (900, None), (901, ""), (902, "the mug " * 60_000)] + [(903, "red box7 " * 15)] * 40
    target = ["the red mug near the table", None, "", "the red box7 " * 9]
    samples = spark.createDataFrame([(*x, 1, "own") for x in rows], "sample_id long, prompt string, score int, _row string")
    aims = spark.createDataFrame([(t,) for t in target], "prompt string")
    out = resample_prompts(samples, aims, longest=longest, buckets=500, percent=percent, seed=7)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_resample(rows, target, longest, 500, percent, 20, 7)
    again = resample_prompts(samples.repartition(3), aims, longest=longest, buckets=500, percent=percent, seed=7)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "sample_id string, prompt string")
    some = spark.createDataFrame([("scene_1_a_p000", "the red mug")], "sample_id string, prompt string")
    assert resample_prompts(empty, some).collect() == []
    out = resample_prompts(some, empty, min_words=1, percent=100).collect()
    assert [(x.sample_id, x.n_features, x.rank) for x in out] == [("scene_1_a_p000", 3, 1)]
