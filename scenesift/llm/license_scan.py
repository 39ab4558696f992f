"""License scan: exact phrases, and a bounded-error search for short notices."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases and the label each stands for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices as their words, with the label that a near match adds.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("released under the mit license", "mit-notice"),
    ("licensed under cc by 4 0", "cc-by-notice"),
    ("this work is licensed under a creative commons attribution license", "cc-by-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-notice"),
    ("all rights reserved", "proprietary-notice"),
)
#: Share of a notice's characters that may be inserted, deleted or replaced.
ERROR_SHARE = 0.1

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("text", T.StringType()), T.StructField("errors", T.IntegerType())]))),
])


class Notice:
    """A notice with its error bound, its exact seeds and its fuzzy pattern."""

    def __init__(self, text: str, label: str, share: float):
        self.text, self.label, self.errors = text, label, int(len(text) * share)
        # Pigeonhole: with at most e edits, one of e + 1 pieces of the notice stands unchanged.
        cut = [round(k * len(text) / (self.errors + 1)) for k in range(self.errors + 2)]
        self.seeds = [(text[a:b], a) for a, b in zip(cut, cut[1:])]
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={self.errors}}}")

    def whole_words(self, line: str, start: int, end: int, errors: int) -> tuple[int, int, int] | None:
        """(errors, start, end) of the best run of whole words near a match; None when none is within the bound."""
        if (start == 0 or line[start - 1] == " ") and (end == len(line) or line[end] == " "):
            return errors, start, end
        reach = 2 * self.errors + 1
        near = lambda at: range(max(0, at - reach), min(len(line), at + reach) + 1)
        firsts = [a for a in near(start) if a == 0 or line[a - 1] == " "]
        lasts = [b for b in near(end) if b == len(line) or line[b] == " "]
        runs = [(a, b) for a in firsts for b in lasts if abs(b - a - len(self.text)) <= self.errors]
        fits = ((self.pattern.fullmatch(line, a, b), a, b) for a, b in runs)
        return min(((sum(m.fuzzy_counts), a, b) for m, a, b in fits if m), default=None)


def near_notices(text: str, notices: list[Notice], hits: dict[str, list[int]]) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, errors, similarity) of every near match in a text of words joined by single blanks."""
    found = []
    for notice in notices:
        regions = sorted((max(0, at - before - notice.errors), at - before + len(notice.text) + notice.errors) for seed, before in notice.seeds for at in hits.get(seed, ()))
        end = -1
        merged: list[list[int]] = []
        for a, b in regions:
            if a <= end:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
            end = merged[-1][1]
        for a, b in merged:
            for m in notice.pattern.finditer(text, a, min(b, len(text))):
                whole = notice.whole_words(text, m.start(), m.end(), sum(m.fuzzy_counts))
                if whole:
                    errors, start, end = whole
                    found.append((notice.label, start, end, errors, 1 - errors / len(notice.text)))
    return found


def scan_text(text: str | None, phrases, notices: list[Notice], seeds: ahocorasick.Automaton) -> tuple:
    # Bytes lower-case A-Z only, whatever the language.
    words = WORD.findall((text or "").encode().lower().decode())
    line = " ".join(words)
    first = list(accumulate((len(w) + 1 for w in words), initial=0))
    framed, places, base = f" {line} ", [], set()
    for phrase, label in phrases:
        at = framed.find(f" {phrase} ")
        while at >= 0:
            places.append(bisect_right(first, at) - 1)
            base.add(label)
            at = framed.find(f" {phrase} ", at + 1)
    hits: dict[str, list[int]] = {}
    for end, seed in seeds.iter(line):
        hits.setdefault(seed, []).append(end + 1 - len(seed))
    near = near_notices(line, notices, hits) if hits else []
    labels = base | {x[0] for x in near}
    score = 1.0 if base else max((x[4] for x in near), default=0.0)
    spans = [(label, bisect_right(first, a) - 1, line[a:b], errors) for label, a, b, errors, _ in sorted(near, key=lambda x: (x[1], x[0]))]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan_licenses(samples: DataFrame, key: str = "sample_id", text: str = "text", phrases=PHRASES, notices=NOTICES, error_share: float = ERROR_SHARE) -> DataFrame:
    """License phrases and near matches of short notices in every sample text.

    ``samples`` has a sample id and a text (a grounding description or a whole annotation document). A-Z are
    lower-cased, and the words are runs of letters, digits and non-ASCII characters. ``phrases`` are found exactly,
    word by word. ``notices`` may differ by up to ``error_share`` of their characters: each is cut into one piece
    more than it may have errors, so one piece of every near match stands unchanged; one Aho-Corasick pass finds
    the pieces, and the fuzzy pattern of the notice verifies the surroundings of each and reports the span; a
    match counts as the whole words around it, still within the bound.

    Returns (key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row for each input
    row: base places and labels from the phrases, labels also from the notices, score 1 with a phrase, else the
    similarity of the best near match, else 0. Null and empty texts have no words, null places, empty labels and
    score 0. Ids may be null or repeat; other columns are not read. Empty input gives no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Notice(t, label, error_share) for t, label in notices]
        seeds = ahocorasick.Automaton()
        for notice in known:
            for seed, _ in notice.seeds:
                seeds.add_word(seed, seed)
        seeds.make_automaton()
        names = [key, *SCHEMA.fieldNames()]
        for batch in batches:
            rows = [(k, *scan_text(t, phrases, known, seeds)) for k, t in zip(batch["_key"].array, batch["_text"])]
            out = pd.DataFrame(rows, columns=names)
            for name in ("first_word", "last_word", key):
                out[name] = out[name].astype("object")
            yield out

    rows = samples.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField(key, samples.schema[key].dataType), *SCHEMA.fields])
    return rows.mapInPandas(scan, schema)
