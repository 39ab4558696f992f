"""Near-duplicate groups and benchmark leaks against plain versions."""

import random

from scenesift.llm import near_dedup
from scenesift.llm.decontaminate import Items, find_leaks
from scenesift.llm.near_dedup import near_duplicates

from . import brute


def edited(words, k, r):
    words = list(words)
    for _ in range(k):
        at = r.randrange(len(words))
        kind = r.random()
        words[at : at + 1] = [f"new{r.randrange(10**6)}"] if kind < 0.5 else [] if kind < 0.75 else [words[at], f"more{r.randrange(10**6)}"]
    return words


def grounding_texts(seed=2):
    """Descriptions in families of exact and edited copies, one family large, and odd rows."""
    r = random.Random(seed)
    say = lambda n: [f"{r.choice(['mug', 'box', 'left', 'Table'])}{r.randrange(300)}" for _ in range(n)]
    rows = []
    for _ in range(25):
        base = say(r.randint(5, 120))
        rows += [base] + [edited(base, r.choice([0, 0, 1, 1, 2, 3, 4]), r) for _ in range(r.randint(0, 5))]
    base = say(150)
    rows += [base] + [edited(base, r.choice([0, 1, 2, 3, 4, 5, 6]), r) for _ in range(90)]
    texts = [" ".join(w) for w in rows] + ["", None, " \n ", "two words", "Two  WORDS", "one"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(k, texts[n]) for k, n in enumerate(order)]


def test_groups(spark):
    rows = grounding_texts()
    out = near_duplicates(spark.createDataFrame([(k, t, 1) for k, t in rows], "sample_id long, text string, node int").repartition(3)).collect()
    want = brute.near_components(rows)
    assert {r.sample_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.sample_id == r.component_id) for r in out)


def test_groups_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, key="doc_id").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_components([tuple(r) for r in docs.collect()])


def test_deep_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 5)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 3)
    rows = grounding_texts(7)
    out = near_duplicates(spark.createDataFrame(rows, "sample_id long, text string")).collect()
    assert {r.sample_id: (r.n_shingles, r.component_id) for r in out} == brute.near_components(rows)


def test_no_link_rests_on_sorted_neighbours(spark, monkeypatch):
    """Excerpts and edits of one text and variants of one form, which meet no other in a large region."""
    monkeypatch.setattr(near_dedup, "REACH", 0)
    r = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    rows = [edited(base, r.randint(0, 1), r) for _ in range(30)] + [base[a : a + 140] for a in range(0, 60, 3)]
    # Sub-groups of one form: 20 variants each, whose added paragraphs are the same.
    for group in range(2):
        form = base[:140] + [f"p{group}x{k}" for k in range(60)]
        for _ in range(20):
            own = [f"v{r.randrange(10**6)}" for _ in range(22)]
            rows += [form + own, edited(form + own, 1, r)]
    texts = [" ".join(w) for w in rows]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    out = near_duplicates(spark.createDataFrame(rows, "sample_id long, text string")).collect()
    assert {x.sample_id: (x.n_shingles, x.component_id) for x in out} == brute.near_components(rows)


def test_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    out = near_duplicates(spark.createDataFrame([(None, text), (5, text), (None, "a b c d e"), (None, None)], "sample_id long, text string")).collect()
    assert sorted((r.sample_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (0, 2, 0, True), (0, 4, 5, False), (5, 4, 5, True)]
    assert near_duplicates(spark.createDataFrame([], "sample_id long, text string")).count() == 0


def test_null_ids_take_part_in_links(spark):
    words = [f"w{k}" for k in range(120)]
    far = words[:100] + ["y"] * 8
    rows = [(7, words[10:]), (None, words), (None, words), (3, words[:98]), (None, far), (None, far[:-1])]
    out = near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z a")], "sample_id long, text string")).collect()
    plain = brute.near_components([(n, " ".join(w)) for n, (_, w) in enumerate(rows)])
    assert len({c for _, c in plain.values()}) == 1
    assert sorted((x.sample_id or 0, x.component_id or 0, x.kept) for x in out) == [(0, 0, True)] * 2 + [(0, 3, False)] * 4 + [(3, 3, True), (7, 3, False)]


def test_leaks(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 60)))) for k in range(60)]
    rows, want, clean = [], {}, []
    for k in range(300):
        filler = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        text = filler
        if k % 3 == 0:
            item, content = r.choice(items)
            words = content.split()
            limit = len(words) // 5
            at = r.randrange(len(filler) + 1)
            edits = 0 if k % 2 else r.randint(0, limit)
            text = filler[:at] + edited(words, edits, r) + filler[at:]
            want[k] = (item, edits)
        else:
            clean.append(k)
        rows.append((k, " ".join(text).upper() if k % 5 == 0 else " ".join(text)))
    rows += [(900, None), (901, ""), (902, "short")]
    samples = spark.createDataFrame([(k, t, "x") for k, t in rows], "sample_id long, text string, leaks string").repartition(3)
    table = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    out = {x.sample_id: x.leaks for x in find_leaks(samples, table).collect()}
    found = {k: {(x.item_id, x.distance) for x in v} for k, v in out.items()}
    exact = [k for k, (_, e) in want.items() if e == 0]
    assert all((want[k][0], 0) in found[k] for k in exact)
    hit = sum(any(i == item for i, _ in found[k]) for k, (item, _) in want.items())
    assert hit >= 0.97 * len(want)
    assert all(any(d <= e for i, d in found[k] if i == item) for k, (item, e) in want.items() if any(i == item for i, _ in found[k]))
    assert not any(found[k] for k in clean) and found[900] == found[901] == set()
    blocks = {x.sample_id: x.leaks for x in find_leaks(samples, table, block_items=20).collect()}
    assert {k: sorted(v) for k, v in blocks.items()} == {k: sorted(v) for k, v in out.items()}
    assert find_leaks(samples.limit(0), table).count() == 0 and not any(x.leaks for x in find_leaks(samples, table.limit(0)).collect())


def test_places_of_leaks():
    index = Items([(7, "the red mug stands left of the box on it")])
    assert index.scan([b"so: The red mug stands left of the box on it ok", b"x"]) == [[{"item_id": 7, "first_word": 1, "n_words": 10, "distance": 0}], []]


def test_text_ids(spark):
    """Sample ids as the annotations have them: the same groups and leaks as under numbers in the order of the ids."""
    rows = grounding_texts()
    name = lambda k: f"scene_{k // 50:02d}_obj_{'é' if k > 120 else 'a'}_p{k:03d}"
    assert [name(k) for k, _ in sorted(rows)] == sorted(name(k) for k, _ in rows)
    docs = spark.createDataFrame([(name(k), t) for k, t in rows] + [(None, rows[0][1])], "sample_id string, text string").repartition(3)
    out = [r for r in near_duplicates(docs).collect() if r.sample_id is not None]
    want = brute.near_components(rows)
    assert {r.sample_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {name(k): (n, name(c), k == c) for k, (n, c) in want.items()}
    items = spark.createDataFrame([("mmlu/7", "The red mug stands left of the tall box on the table"), ("é", None)], "item_id string, text string")
    leaks = find_leaks(spark.createDataFrame([("a", "so the red mug stands left of the tall box on the table it is")], "sample_id string, text string"), items).first().leaks
    assert [(x.item_id, x.first_word, x.distance) for x in leaks] == [("mmlu/7", 1, 0)]
