import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scenesift.operators import batch_state as bs
from scenesift.operators import evaluation as ev
from scenesift.operators import stats as st
from scenesift.functions import boxes as bx
from scenesift.sources import samples as src
from scenesift.sources import sinks


def write_samples(folder, scene, frame, names):
    folder.mkdir(parents=True, exist_ok=True)
    records = [{"scene_id": scene, "frame_id": frame, "object_id": o, "class_name": c} for o, c in names]
    (folder / f"{scene}_{frame}.json").write_text(json.dumps({"schema_version": "placement_samples/v1", "scene_id": scene, "frame_id": frame, "unit": "cm", "samples": records}))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stats")
    write_samples(root / "a" / "samples", "scene01", "0000", [("obj_1", "cup"), ("obj_1", " cup "), ("obj_2", "bottle")])
    write_samples(root / "b" / "samples", "scene02", "0000", [("obj_1", "cup")])
    (root / "b" / "samples" / "broken.json").write_text("{not json")
    docs = src.scan_samples(spark, [str(root / "a"), str(root / "b" / "samples"), str(root / "none")])
    return root, src.infer_frame_keys(docs)


def test_two_roots(spark, documents, tmp_path):
    root, docs = documents
    rows = src.sample_rows(docs)
    over = st.stats_overview(src.file_counts(docs), rows).first()
    assert (over.total_scenes, over.total_categories, over.total_samples, over.source_file_count, over.avg_samples_per_scene) == (2, 2, 4, 2, 2.0)
    stats = st.category_stats(rows)
    cup = stats.filter("category = 'cup'").first()
    assert (cup.sample_count, cup.object_count, cup.scene_count) == (3, 2, 2)
    assert src.corrupt_samples(spark, [str(root / "b")]).count() == 1
    with pytest.raises(FileNotFoundError):
        src.sample_folders(spark, [str(root / "none")], strict=True)
    sinks.sink_stats(st.stats_overview(src.file_counts(docs), rows), stats, st.scene_distribution(rows), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/category_counts"), header=True).count() == 2
    assert spark.read.text(str(tmp_path / "r/summary_text")).count() == 8


def test_fields_of_other_types_lose_nothing(spark, tmp_path):
    folder = tmp_path / "root" / "samples"
    write_samples(folder, "scene01", "0000", [("obj_1", "cup")])
    odd = {"scene_id": 7, "frame_id": None, "samples": [
        {"class_name": "cup", "object_id": 5, "free_space_score": 3.0, "rank": "first", "center_world": "none"},
        {"class_name": None, "free_space_score": None}, {"object_id": "obj_2", "class_name": " cup ", "center_world": [1, 2.5, 3]}]}
    (folder / "scene_7_0005.json").write_text(json.dumps(odd))
    (folder / "scene_8_0005.json").write_text('{"samples": [')
    (folder / "scene_9_0005.json").write_text('["no object"]')
    (folder / "scene_9_0010.json").write_text('{"unit": "cm"}')
    docs = src.infer_frame_keys(src.scan_samples(spark, [str(tmp_path / "root")]))
    assert docs.count() == 3
    got = {(r.scene_id, r.frame_id, r.object_id, r.category) for r in src.sample_rows(docs).collect()}
    assert got == {("scene01", "0000", "obj_1", "cup"), ("7", "0005", "5", "cup"), ("7", "0005", "unknown_object", "unknown"), ("7", "0005", "obj_2", "cup")}
    flat = {r.object_id: r for r in src.flatten_samples(docs).collect()}
    assert flat["5"].free_space_score == 3 and flat["5"].rank is None and flat["5"].center_world is None and flat["obj_2"].center_world == [1.0, 2.5, 3.0]
    texts = src.sample_texts(spark, [str(tmp_path / "root")])
    assert [tuple(r) for r in src.skipped_documents(texts).collect()] == [("root", 3, 2)]
    assert src.corrupt_samples(spark, [str(tmp_path / "root")]).count() == 2


def test_summary_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k % 3}", "f", f"o{k % 4}", "cup" if k % 5 else "can", "p", k) for k in range(20)], "scene_id string, frame_id string, object_id string, category string, path string, pos int")
    files = spark.createDataFrame([("p", f"s{k}") for k in range(4)], "path string, scene_id string")
    stats = st.category_stats(rows)
    sinks.sink_stats(st.stats_overview(files, rows), stats, st.scene_distribution(rows), str(tmp_path / "r"))
    back = [(r.category, r.sample_count, r.object_count, r.scene_count, r.ratio) for r in src.load_summary(spark, str(tmp_path / "r/summary")).collect()]
    assert back == [tuple(r) for r in st.ordered_categories(stats).select("category", "sample_count", "object_count", "scene_count", "ratio").collect()]


def test_empty_reports(spark):
    stats = spark.createDataFrame([], "category string, sample_count long, object_count long, scene_count long, first_seen string, ratio double")
    assert [tuple(r) for r in st.category_topk_others(stats, 3).collect()] == [("empty", 1)]
    empty = spark.createDataFrame([], "scene_id string, sample_count long")
    assert [tuple(r) for r in st.scene_hist(empty).collect()] == [(0, -0.5, 0.5, 1)]


def test_default_category_rules(spark):
    from scenesift.sources.category_map import default_category_map

    rules = {r.category: r.merged for r in default_category_map(spark).collect()}
    assert len(rules) == 47 and rules["cup-stanford"] == "cup" and rules["tube-signal"] == "tube-signal"


LOG = "scene_id string, frame_id string, state string, reason string, output_slot int, ts timestamp, event_id long"


def log(spark, *rows):
    data = [(s, f, state, why, slot, n) for n, (s, f, state, why, slot) in enumerate(rows)]
    df = spark.createDataFrame(data, "scene_id string, frame_id string, state string, reason string, output_slot int, event_id long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("event_id"))).select("event_id", "ts", "scene_id", "frame_id", "state", "reason", "output_slot")


def outputs(scene, frame, slots=range(6)):
    return [(scene, frame, "output", None, n) for n in slots]


def test_completeness_and_stale_recovery(spark):
    entries = log(spark, *outputs("a", "0", [0]), ("a", "0", "running", None, None), *outputs("b", "0"), ("b", "0", "running", None, None))
    done = {r.scene_id: r.is_complete for r in bs.frame_complete(entries).collect()}
    assert done == {"a": False, "b": True}
    fixes = {r.scene_id: (r.state, r.reason) for r in bs.recover_stale(entries).collect()}
    assert fixes == {"a": ("failed", "Process killed (OOM or interrupted)"), "b": ("cleared", None)}
    settled = bs.append_marks(entries, bs.recover_stale(entries), "2030-01-01", 1000)
    assert {r.scene_id: r.is_failed for r in bs.frame_flags(settled).collect()} == {"a": True, "b": False}


def test_precedence_summary_and_clear(spark):
    entries = log(spark, *outputs("a", "0"), ("a", "0", "failed", "x", None), ("b", "0", "failed", "y", None))
    plain = {r.scene_id: r.should_process for r in bs.should_process(entries).collect()}
    retry = {r.scene_id: r.should_process for r in bs.should_process(entries, retry_failed=True).collect()}
    assert plain == {"a": False, "b": False} and retry == {"a": False, "b": True}
    assert all(r.should_process for r in bs.should_process(entries, force=True).collect())
    assert tuple(bs.status_summary(entries).first()) == (0, 1, 2)
    assert bs.clear_failed(entries, scene_id="b").count() == 1
    cleared = bs.append_marks(entries, bs.clear_failed(entries), "2030-01-01", 1000)
    assert tuple(bs.status_summary(cleared).first()) == (0, 1, 0)


def test_nms_against_greedy(spark):
    import random

    random.seed(5)
    rows = [(random.randrange(3), n, random.random(), random.uniform(0, 30), random.uniform(0, 30), random.uniform(3, 9), random.uniform(3, 9)) for n in range(150)]
    df = spark.createDataFrame(rows, "g int, id int, score double, x double, y double, l double, w double")
    boxes = df.select("g", "id", "score", bx.box(F.col("x"), F.col("y"), F.lit(0.0), F.col("l"), F.col("w"), F.lit(1.0)).alias("box"))
    got = {r.id for r in ev.nms3d(boxes, ["g"], "id", "score", 0.2, False).collect()}

    def iou(a, b):
        ox = max(0, min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2))
        oy = max(0, min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2))
        return ox * oy / (a[5] * a[6] + b[5] * b[6] - ox * oy)

    kept = []
    for r in sorted(rows, key=lambda r: -r[2]):
        if all(k[0] != r[0] or iou(k, r) <= 0.2 for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}


def overlap_of(a, b):
    """Shared area of two turned rectangles (x, y, l, w, yaw): corners of one cut by the sides of the other."""
    turn = lambda r, px, py: (r[0] + math.cos(r[4]) * px - math.sin(r[4]) * py, r[1] + math.sin(r[4]) * px + math.cos(r[4]) * py)
    shape = [turn(a, a[2] / 2 * sx, a[3] / 2 * sy) for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
    for k, half in enumerate((b[2], b[3], b[2], b[3])):
        nx, ny = math.cos(b[4] + k * math.pi / 2), math.sin(b[4] + k * math.pi / 2)
        depth = lambda p: nx * (p[0] - b[0]) + ny * (p[1] - b[1]) - half / 2  # noqa: E731, B023
        out = []
        for p, q in zip(shape, shape[1:] + shape[:1]):
            s, t = depth(p), depth(q)
            out += [p] if s <= 0 else []
            out += [tuple(u + s / (s - t) * (v - u) for u, v in zip(p, q))] if s * t < 0 else []
        shape = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(shape, shape[1:] + shape[:1]))) / 2


def test_nms_of_turned_boxes_of_all_sizes(spark):
    """Sizes from a hundredth to 1,000 times the usual one, some of them alike, one of them around everything."""
    r = random.Random(8)
    rows = []
    for n in range(260):
        scale = r.choice([0.01, 1, 1, 1, 7, 90])
        rows.append((r.randrange(2), n, float(r.randrange(9)), r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(3, 9) * scale, r.uniform(3, 9) * scale, r.choice([0.0, r.uniform(-4, 4)])))
    rows += [(0, 900, 99.0, 1.0, 2.0, 9000.0, 8000.0, 0.3), (0, 901, 98.0, 3.0, 2.0, 8900.0, 8100.0, 0.31), (1, 902, 50.0, -20.0, 5.0, 0.0, 0.0, 0.0), (1, 903, 51.0, -16.0, 16.0, 16.0, 16.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, id int, score double, x double, y double, l double, w double, yaw double")
    boxes = df.select("g", "id", "score", bx.box(F.col("x"), F.col("y"), F.lit(0.0), F.col("l"), F.col("w"), F.lit(1.0), F.col("yaw")).alias("box"))
    got = {x.id for x in ev.nms3d(boxes, ["g"], "id", "score", 0.3).collect()}

    def iou(a, b):
        shared = overlap_of(a[3:], b[3:])
        return shared / (a[5] * a[6] + b[5] * b[6] - shared)

    kept = []
    for x in sorted(rows, key=lambda x: (-x[2], x[1])):
        if all(k[0] != x[0] or iou(k, x) <= 0.3 for k in kept):
            kept.append(x)
    assert got == {x[1] for x in kept} and 900 in got and 901 not in got
    assert len(got) < len(rows) - 20


def boxes_of_all_kinds(spark, seed=2):
    """Groups of one box to many, ties, numbers and groups that are missing, ids that come twice."""
    r = random.Random(seed)
    rows = []
    for n in range(400):
        g = r.choice([None, 0, 0, 0, 1, 1, 2, 3 + n])
        x, w, yaw = r.uniform(0, 30), r.choice([None, 0.0, 4.0, 5.0, 90.0, r.uniform(3, 9)]), r.choice([0.0, 0.0, None, r.uniform(-4, 4)])
        rows.append((g, f"b{n - n % 40 // 39}", r.choice([None, 1.0, 2.0, r.random()]), x, r.uniform(0, 30), r.uniform(3, 9), w, yaw))
    df = spark.createDataFrame(rows, "g int, id string, score double, x double, y double, l double, w double, yaw double").repartition(3)
    return df.select("g", "id", "score", bx.box(F.col("x"), F.col("y"), F.lit(0.0), F.col("l"), F.col("w"), F.lit(1.0), F.col("yaw")).alias("box"))


@pytest.mark.parametrize("rotated", [False, True])
def test_groups_settle_as_rounds_do(spark, monkeypatch, rotated):
    boxes = boxes_of_all_kinds(spark)
    args = ["g"], "id", "score", 0.3, rotated
    listed = lambda df: sorted(((x.g, x.id, x.score, tuple(x.box)) for x in df.collect()), key=repr)
    want = listed(ev.settled_rounds(boxes, *args))
    assert 50 < len(want) < 380
    assert listed(ev.nms3d(boxes, *args)) == want
    monkeypatch.setattr(ev, "PAIRS_AT_ONCE", 7)
    assert listed(ev.settled_groups(boxes, *args)) == want
    monkeypatch.setattr(ev, "GROUP_BOXES", 30)  # now some groups are settled where they lie and some in rounds
    assert listed(ev.nms3d(boxes, *args)) == want


def test_groups_may_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        boxes = boxes_of_all_kinds(spark, 4)
        got, want = (sorted((x.g or -1, x.id, x.score or 0.0) for x in f(boxes, ["g"], "id", "score", 0.3, False).collect()) for f in (ev.settled_groups, ev.settled_rounds))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boxes_of_small_groups_cross_one_shuffle(spark, monkeypatch):
    """No box is dealt to the cells of a grid, which wrote every box once for each level of sizes."""
    monkeypatch.setattr(ev, "overlap_edges", None)
    kept = ev.nms3d(boxes_of_all_kinds(spark), ["g"], "id", "score", 0.3, False)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    physical = kept._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_category_stream(spark, documents, tmp_path):
    from scenesift.streaming.samples import category_counts_stream

    root, _ = documents
    stream = category_counts_stream(spark, str(root / "a" / "samples"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("cats").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.category: r.sample_count for r in spark.table("cats").collect()} == {"cup": 2, "bottle": 1}
