"""Toxicity by non-negative positive-unlabelled learning over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.llm.common import stored

#: Rows that the classifiers are fitted on at most: confirmed toxic ones, and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Features of the model at most.
MAX_FEATURES = 4096
#: Words shorter than this have no stem features; stems are the first letters of a word.
STEMS = (4, 5)
THRESHOLD = 0.3

WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Different words of a text in lower case, and the stems (``abcd-``) of the longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class PUClassifier:
    """Linear classifier on the features that a text holds."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, frozenset(weights)

    def score(self, text: str | None) -> float:
        margin = self.bias + sum(self.weights[f] for f in sorted(self.known & features(text)))
        return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def fit_pu(positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative PU risk with the logistic loss.

    The risk is prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]): the unlabelled texts stand for the mix of
    both classes, and what the positives hold of their negative risk is taken off by the class prior. When that
    corrected part falls below zero, the step goes back up its gradient instead of on.
    """

    def table(rows):
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.fromiter((k for r in rows for k in r), np.int64, sizes.sum()), np.repeat(np.arange(len(rows)), sizes), len(rows)

    p, u = table(positive), table(unlabelled)
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):

        def margins(t):
            return np.bincount(t[1], w[t[0]], t[2]) + w[-1]

        def gradient(t, slope):
            return np.append(np.bincount(t[0], slope[t[1]], n_features), slope.sum()) / t[2]

        sp, su = (1 / (1 + np.exp(-np.clip(margins(t), -30, 30))) for t in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        back = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + back if negative >= 0 else -back
        g = g + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(samples: DataFrame, labels: DataFrame, key: str = "sample_id", text: str = "text", label: str = "toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> PUClassifier:
    """Fit the classifier on a bounded sample of the labelled rows that are not held out.

    Positives are rows with label 1; the unlabelled set is drawn from all labelled rows with the label hidden, so it
    holds both classes in their natural mix, and the class prior is the share of label 1 in it. ``max_positive`` and
    ``max_unlabelled`` bound the sample, drawn in the order of a hash of the id; ``max_features`` bounds the model.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_key").isNotNull() & F.col("_label").isNotNull())
    known = known.filter(~held_out(F.col("_key"))).groupBy("_key").agg(F.max("_label").alias("_label"))
    n, n_positive = known.agg(F.count("*"), F.sum("_label")).first()
    if not n_positive or n_positive == n:
        return PUClassifier({}, -5.0 if not n_positive else 5.0)
    prior = n_positive / n
    order = [F.xxhash64("_key", F.lit(1)), "_key"]
    drawn = known.filter("_label = 1").orderBy(*order).limit(max_positive).select("_key", F.lit(1).alias("is_p"))
    drawn = drawn.unionByName(known.orderBy(*order).limit(max_unlabelled).select("_key", F.lit(0).alias("is_p")))
    # At most max_positive + max_unlabelled ids, so the broadcast is bounded and no text is shuffled to be dropped.
    ids = F.broadcast(drawn)
    texts = samples.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, "_key")
    found = F.udf(lambda t: sorted(features(t)), T.ArrayType(T.StringType()))
    rows = stored(texts.groupBy("_key", "is_p").agg(F.min("_text").alias("_text")).select("_key", "is_p", found("_text").alias("f")))
    n_u = max(1, rows.filter("is_p = 0").count())
    n_p = max(1, rows.filter("is_p = 1").count())
    tally = rows.select("is_p", F.explode("f").alias("f")).groupBy("f").agg(F.sum("is_p").alias("p"), F.sum(1 - F.col("is_p")).alias("u"))
    # Commoner among positives than in the mix beyond chance; ranked by how much of the positives they explain.
    lift = (F.col("p") / n_p) / ((F.col("u") + 0.5) / n_u)
    expected = n_p * (F.col("u") + 1) / n_u
    chosen = tally.filter((F.col("p") >= 4) & (lift > 2) & (F.col("p") - expected > 3 * F.sqrt(expected)))
    chosen = chosen.orderBy((F.col("p") * F.log(lift)).desc(), "f").limit(max_features)
    names = [r["f"] for r in chosen.select("f").collect()]
    if not names:
        return PUClassifier({}, float(np.log(prior / (1 - prior))))
    held = F.array(*[F.lit(x) for x in names])
    index = {x: k for k, x in enumerate(names)}
    picked = rows.select("is_p", "_key", F.array_intersect("f", held).alias("f")).orderBy("is_p", "_key").collect()
    as_rows = lambda side: [[index[x] for x in r["f"]] for r in picked if r["is_p"] == side]
    weights, bias = fit_pu(as_rows(1), as_rows(0), len(names), prior)
    return PUClassifier({x: float(weights[k]) for x, k in index.items() if weights[k]}, bias)


def score_toxicity(samples: DataFrame, labels: DataFrame, key: str = "sample_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD,
                       columns: tuple | list = (), model: PUClassifier | None = None) -> DataFrame:
    """Toxicity of every sample text.

    ``samples`` has a sample id and its text (a grounding description); ``labels`` has some of the ids with a 0/1
    label. The classifier (see ``train``; pass ``model`` to reuse one) sees only the words of a text. Rows whose
    crc32(id) mod 4 is 2 are held out of the fit.

    Returns (key, held_out, score, predicted) and the given ``columns`` of the samples, one row for each input row;
    ``predicted`` is 1 from ``threshold`` on.
    Null and empty texts get the score of a text without any known word. Null ids count as empty text for the hash.
    Ids may repeat. Without a positive label every score is near 0; without rows there are none.
    """
    model = train(samples, labels, key, text, label) if model is None else model

    carried = [c for c in columns if c not in (key, "held_out", "score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column("_text").to_pylist()], float)
            more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more, *[batch.column(k) for k in range(3, batch.num_columns)]], names=[key, "held_out", "score", "predicted", *carried])

    rows = samples.select(F.col(key).alias(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text"), *carried)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(score, T.StructType([*rows.schema.fields[:2], *added, *rows.schema.fields[3:]]))
