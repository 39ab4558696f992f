"""Mixing, toxicity, license scan, quality rules and URL filters on small fixtures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenesift.llm import url_filter
from scenesift.llm.license_scan import ERROR_SHARE, NOTICES, scan_licenses
from scenesift.llm.mixing import mix_sources
from scenesift.llm.quality import judge_quality
from scenesift.llm.toxicity import fit_pu, score_toxicity, train
from scenesift.llm.url_filter import LANES, bloom_words, filter_urls, may_be_listed

from . import brute


# ---- mixing ----


def fill(sizes, share=1.5, cap=2.0, cycle=(3.0, 1.0, 2.0)):
    """Targets by handing the excess round until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: cycle[k % 3] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else per * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixed(spark, rows, **options):
    return mix_sources(spark.createDataFrame([(*r, 9) for r in rows], "sample_id long, text string, source_dir string, size int"), **options).collect()


@pytest.mark.parametrize("piece_rows", [4000, 7])
def test_mixing(spark, piece_rows):
    r = random.Random(1)
    rows = [(k, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 40))), r.choice(["out_0"] * 6 + ["out_1", "Out", "ü", None])) for k in range(600)]
    out = mixed(spark, rows, piece_rows=piece_rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want, taken, largest = fill(sizes), Counter(), Counter()
    for x in out:
        assert x.size == len(brute.words(rows[x.sample_id][1])) and x.source_size == sizes[x.source_dir] and 0 <= x.taken <= 2 * x.size
        assert math.isclose(x.target, want[x.source_dir], rel_tol=1e-9)
        taken[x.source_dir] += x.taken
        largest[x.source_dir] = max(largest[x.source_dir], x.size)
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    again = mixed(spark, rows[::-1], piece_rows=50)
    assert sorted((x.sample_id, x.taken) for x in again) == sorted((x.sample_id, x.taken) for x in out)


def test_mixing_odd_rows(spark):
    out = mixed(spark, [(None, None, None), (1, "", "a"), (1, "a b", "b"), (1, "a b", "b")])
    assert sorted((x.size, x.taken) for x in out) == [(0, 0), (0, 0), (2, 2), (2, 4)]
    assert mixed(spark, []) == []
    assert [x.taken for x in mixed(spark, [(1, None, "a")])] == [0]


# ---- toxicity ----


def test_risk_estimator_finds_the_positive_feature():
    r = np.random.default_rng(0)
    sparse = lambda toxic: [k for k in range(2, 20) if r.random() < 0.3] + ([0] if toxic else [])
    weights, bias = fit_pu([sparse(True) for _ in range(100)], [sparse(k % 10 == 0) for k in range(600)], 20, 0.1)
    assert weights[0] > 3 and np.abs(weights[2:]).max() < weights[0] / 3 and bias < -1


def test_toxicity(spark):
    r = random.Random(2)
    plain, bad = [f"word{k}" for k in range(200)], ["awfulmug", "nastybox", "vileful", "vilesome"]
    rows, labels = [], []
    for k in range(1200):
        toxic = r.random() < 0.15
        words = [r.choice(plain) for _ in range(r.randint(5, 60))] + (r.sample(bad, 2) if toxic else [])
        r.shuffle(words)
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    samples = spark.createDataFrame(rows + [(5000, None, "x"), (5001, "", "x"), (None, "vileful vilesome nastybox", "x")], "sample_id long, text string, score string")
    table = spark.createDataFrame(labels + [(1, None), (None, 1)], "sample_id long, toxic int")
    out = score_toxicity(samples, table, columns=("text",)).collect()
    truth = dict(labels)
    held = [x for x in out if x.held_out and x.sample_id in truth]
    assert len(held) > 200 and all((x.predicted == 1) == (truth[x.sample_id] == 1) for x in held)
    odd = {x.sample_id: x for x in out if x.sample_id not in truth}
    assert odd[5000].score == odd[5001].score < 0.3 and odd[None].predicted == 1 and all(0 <= x.score <= 1 for x in out)
    # Held-out labels have no effect: turn them round and fit again.
    import zlib

    turned = spark.createDataFrame([(k, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, t in labels], "sample_id long, toxic int")
    assert train(samples, turned).weights == train(samples, table).weights
    none = score_toxicity(samples, table.filter("toxic = 0")).collect()
    assert not any(x.predicted for x in none)
    assert score_toxicity(samples.limit(0), table).count() == 0 and score_toxicity(samples, table.limit(0)).count() == 1203


# ---- license scan ----


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "GNU General Public License, apache-license; MIT license mit LICENSE"), (3, "the mit licenses"), (4, None), (5, ""),
        (6, "x Relesed under the MIT Licence today"), (7, "Ökonomie CC BY 4.0"), (8, "CC-BYE"), (9, "nothing here " * 5000), (None, "Apache\nLicense"),
    ]
    out = {x.sample_id: x for x in scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "sample_id long, text string, labels string")).collect()}
    base = {k: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for k, x in out.items()}
    assert base[1] == (5, 1, 3, 3, "mit") and base[2] == (10, 4, 0, 8, "apache,gpl,mit") and base[3] == (3, 0, None, None, "")
    assert base[4] == base[5] == (0, 0, None, None, "") and base[7] == (5, 1, 1, 1, "cc-by") and base[8] == (2, 0, None, None, "")
    assert base[9][:2] == (10000, 0) and base[None] == (2, 1, 0, 0, "apache")
    assert out[1].labels == "mit,mit-notice" and out[1].score == 1.0 and out[1].spans[0].errors == 0
    assert out[6].labels == "mit-notice" and 0.9 < out[6].score < 1 and out[6].spans[0].errors > 0 and out[6].spans[0].first_word == 1
    assert out[9].score == 0 and out[9].labels == ""


# ---- quality ----


def plain_statistics(text):
    w = brute.words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    gone = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            gone.update(range(i, i + 3))
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(gone)


def test_license_scan_against_all_word_runs(spark):
    """Labels of near matches equal those of an edit distance over every run of words."""
    r = random.Random(5)
    rows = [(0, "small rights reservedly"), (1, "all rights reservedl y"), (2, "xall rights reserved"), (3, "a ll rights reserved")]
    for k in range(4, 120):
        words = list(r.choice(NOTICES)[0])
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = r.choice(["", "x", " ", "s"])
        pad = [r.choice(["mug", "released", "all", "the", "rights"]) for _ in range(6)]
        rows.append((k, " ".join(pad[:3]) + r.choice([" ", "", "."]) + "".join(words) + r.choice([" ", "", "!"]) + " ".join(pad[3:])))
    out = scan_licenses(spark.createDataFrame(rows, "sample_id long, text string"), phrases=()).collect()
    got = {x.sample_id: set(filter(None, x.labels.split(","))) for x in out}
    assert got == {k: brute.near_labels(t, NOTICES, ERROR_SHARE) for k, t in rows}
    assert not got[0] and any(got.values()) and sum(not v for v in got.values()) > 5


def test_license_places_in_a_long_text(spark):
    text = "word mit license and all rights reserved " * 4000
    (row,) = scan_licenses(spark.createDataFrame([("a", text)], "sample_id string, text string")).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (28000, 4000, 1, 27994)
    assert [x.first_word for x in row.spans] == list(range(4, 28000, 7))



def test_quality(spark):
    r = random.Random(3)
    vocabulary = ["the", "of", "a", "mug", "table", "Box", "Ünder", "on"]
    good = lambda n: "\n".join(" ".join(r.choice(vocabulary) + r.choice(["", str(r.randrange(900))]) for _ in range(10)) for _ in range(n))
    rows = [(k, good(r.randint(3, 40)), "en") for k in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "a b c " * 60, "en"), (203, "#$%& " * 200, "en"), (204, "x y\nx y\n \n\nx y", None), (205, "a", "de"), (206, "line one\n" * 30, "en")]
    out = {x.sample_id: x for x in judge_quality(spark.createDataFrame([(*x, 1) for x in rows], "sample_id long, text string, lang string, kept int")).collect()}
    for k, t, _ in rows:
        x = out[k]
        want = plain_statistics(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, k
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(x.kept == (not x.base_failed) for k, x in out.items() if k < 200)
    assert not any(out[k].kept for k in (200, 201, 202, 203, 204, 205, 206))
    noise = " ".join("".join(r.choice("0123456789{}[]=") for _ in range(6)) for _ in range(150))
    more = judge_quality(spark.createDataFrame(rows + [(300, noise, "en")], "sample_id long, text string, lang string")).collect()
    odd = next(x for x in more if x.sample_id == 300)
    assert not odd.base_failed and not odd.kept and odd.class_distance > 0.3
    assert judge_quality(spark.createDataFrame([], "sample_id long, text string, lang string")).count() == 0


def test_texts_of_other_words_are_judged(spark):
    r = random.Random(6)
    english = ["the", "of", "and", "to", "in", "between", "because", "mug", "table", "box"]
    german = ["der", "die", "und", "zwischen", "weil", "tasse", "tisch", "kasten", "rot", "neben"]
    rare = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 9)))
    text = lambda words, n: " ".join(r.choice(words) if r.random() < 0.5 else rare() for _ in range(n))
    rows = [(k, text(english, 200), "en") for k in range(80)] + [(100 + k, text(german, 200), "de") for k in range(80)]
    rows += [(300, " ".join(rare() for _ in range(500)), "en"), (301, text(german, 500), "en"), (302, "the mug " + " ".join(rare() for _ in range(2000)), "en")]
    rows += [(303, " ".join(rare() for _ in range(99)), "en"), (304, text(english, 300), None)]
    out = {x.sample_id: x for x in judge_quality(spark.createDataFrame(rows, "sample_id long, text string, lang string")).collect()}
    assert out[300].word_distance == 1.0 and 0.4 < out[301].word_distance and 0.4 < out[302].word_distance < 1
    assert not any(out[k].kept for k in (300, 301, 302)) and out[303].kept and out[303].word_distance == 1.0
    assert all(x.kept for k, x in out.items() if k < 200) and out[304].kept and out[304].word_distance < 0.2


# ---- URLs ----

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.encode().lower().decode()
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    r = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "x.net", "net", "com", "www.com", "ü.net", ""]
    urls = [f"{r.choice(['http', 'https', 'ftp'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/x', '/fr/?q=/en/', '?a=1', '#top', '/EN/', '/en/a#b?c'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://x.net/es/ #", "mailto:x@y.com"]
    frames = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)] + [(0, urls[0], "own"), (None, urls[1], "own")], "page_id long, image_url string, rule string")
    out = filter_urls(frames, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls) + 2
    for x in out:
        assert (x.host, x.path, x.rule, x.verdict) == plain_verdict(x.image_url, RULES), x
    many = [(f"h{k}.org", "/", "block") for k in range(500)]
    listed = spark.createDataFrame(many + many[:3], "host string, path string, verdict string")
    asked = spark.createDataFrame([(k, f"http://h{k}.org/a") for k in range(0, 1000, 7)], "page_id long, image_url string")
    assert all((x.verdict == "block") == (x.page_id < 500) for x in filter_urls(asked, listed).collect())
    assert {x.verdict for x in filter_urls(frames, listed.limit(0)).collect()} == {"allow"}
    assert filter_urls(frames.limit(0), listed).count() == 0


def test_bloom_words_are_tested_before_any_shuffle(spark):
    listed = spark.createDataFrame([(f"h{k}.org/",) for k in range(3000)], "key string")
    words = bloom_words(listed, 300)
    assert len(spark.range(1).select(words).first()[0]) == 300 * LANES
    asked = spark.range(20000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"), F.col("id"))
    passed = asked.filter(may_be_listed(F.col("key"), words, 300))
    assert "Exchange" not in passed._jdf.queryExecution().executedPlan().toString()
    assert passed.filter("id < 3000").count() == 3000
    assert passed.filter("id >= 3000").count() < 170


def test_a_full_filter_and_clashing_columns_change_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    listed = spark.createDataFrame([(f"h{k}.org", "/", "block") for k in range(400)], "host string, path string, verdict string")
    names = ["row", "frame", "passed", "key", "best", "found", "salt", "_row"]
    asked = spark.createDataFrame([(k, f"http://www.h{k}.org/a", *range(8)) for k in range(0, 800, 7)], "page_id long, image_url string, " + ", ".join(f"{n} int" for n in names))
    out = filter_urls(asked, listed).collect()
    assert len(out) == asked.count() and out[0].asDict().keys() == {"page_id", "image_url", *names, "host", "path", "rule", "verdict"}
    assert all((x.verdict == "block") == (x.page_id < 400) and [x[n] for n in names] == list(range(8)) for x in out)
