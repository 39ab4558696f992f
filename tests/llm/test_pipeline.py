"""Every stage of the corpus pipeline against plain versions, on the smallest documents and some planted ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenesift.llm.common import stored

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    first = docs.filter("length(text) > 2000").orderBy("doc_id").first()
    passage = " ".join(f"unique{n} passage" for n in range(30))
    planted = [
        (90001, f"before\n{passage}\nafter it", "en", "src0", 1), (90002, f"other\n{passage}\nend of it", "en", "src1", 1), (90003, "start " + item + " end", "en", "src1", 1),
        (90004, first.text + " tail", "en", None, 1), (90005, first.text, "en", "src3", 1), (90006, None, None, None, None), (90007, "", "en", "src2", 0), (None, "text without an id", "en", "src2", 18),
    ]
    docs = stored(docs.select(*COLUMNS).unionByName(spark.createDataFrame(planted, docs.select(*COLUMNS).schema)))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out, item, first


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_toxicity(spark, stages):
    out, _, _ = stages
    assert all(df.columns == COLUMNS for df in out[:-1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(out[0]), rows(out[1])
    gone = set(before) - set(after)
    assert all(labels.get(k) == 1 for k in gone if k in labels) and all(after[k] == before[k] for k in after)


def test_line_dedup(stages):
    out, _, _ = stages
    before, after = rows(out[1]), rows(out[2])
    order = sorted(before, key=lambda k: (k is not None, k or 0))
    for k, _, removed, kept in brute.removed_lines([(k, before[k].text) for k in order], 10):
        if removed and not brute.words(kept):
            assert k not in after
        else:
            assert (after[k].text or "") == kept and (after[k].n_chars == len(kept) if removed else after[k] == before[k])
    assert "unique3 passage" in after[90001].text and "unique3 passage" not in after[90002].text and 90005 not in after


def test_near_dedup(stages):
    out, _, _ = stages
    before, after = rows(out[2]), rows(out[3])
    groups = brute.near_components([(k, r.text) for k, r in before.items() if k is not None], n=5)
    assert {k for k in after if k is not None} == {k for k, (_, c) in groups.items() if k == c} and None in after
    assert all(after[k] == before[k] for k in after)


def test_decontamination(stages):
    out, item, _ = stages
    before, after = rows(out[3]), rows(out[4])
    assert 90003 in before and 90003 not in after
    assert all(item not in (r.text or "") for r in after.values()) and all(after[k] == before[k] for k in after)


def test_mixing_and_run(spark, stages):
    out, _, _ = stages
    docs, mixed = rows(out[4]), out[5].collect()
    assert all(0 < r.taken <= 2 * r.size == 2 * len(brute.words(docs[r.doc_id].text)) for r in mixed)
    total = sum(len(brute.words(r.text)) for r in docs.values())
    assert abs(sum(r.taken for r in mixed) - 1.5 * total) < 0.15 * total
    assert corpus_pipeline.run(spark, SF).filter(F.col("taken") > 0).count() > 0


def test_near_dedup_takes_five_words(spark):
    words = [f"w{n}" for n in range(200)]
    few, five = [w if n not in (50, 150) else "other" for n, w in enumerate(words)], [w if n not in (20, 60, 100, 140, 180) else "new" for n, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(few), 3: " ".join(five)}
    alike = lambda a, b, n: 100 * len(a & b) >= 80 * len(a | b) if (a := brute.shingles(a, n)) and (b := brute.shingles(b, n)) else False
    assert alike(texts[1], texts[3], 4) and not alike(texts[1], texts[3], 5) and not alike(texts[2], texts[3], 5) and alike(texts[1], texts[2], 5)
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(rows(corpus_pipeline.keep_one_of_each_group(spark, docs, SF))) == {1, 3}
