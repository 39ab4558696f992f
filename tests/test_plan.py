"""Invariants of the full plan with fitted planes on the smallest data set."""

import pytest
from pyspark.sql import functions as F

from catalog.scene import CONFIG, Scene
from scenesift.operators.occupancy import OBJ
from scenesift.plans.placement import displacement_stats, placed_summary, plan_placements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    scene = Scene(spark, SF)
    return scene, plan_placements(scene.depth, scene.camera, scene.objects, CONFIG)


def test_funnel_narrows(tables):
    scene, plan = tables
    rows = plan.funnel.collect()
    assert len(rows) == scene.objects.count()
    for r in rows:
        assert r.num_raw_candidates >= r.num_after_stability >= r.num_after_visibility >= r.num_after_occlusion >= 0
        assert r.skip_reason is None or r.num_raw_candidates == 0
    assert any(r.num_after_occlusion for r in rows)


def test_cluster_sizes_sum_to_candidates(tables):
    _, plan = tables
    sizes = plan.clusters.groupBy(*OBJ).agg(F.sum("size").alias("n"))
    joined = plan.funnel.join(sizes, OBJ, "left").collect()
    assert all((r.n or 0) == r.num_after_occlusion for r in joined)


def test_placements_are_ranked_and_in_image(tables):
    scene, plan = tables
    rows = plan.placements.collect()
    assert rows
    for r in rows:
        assert r.sample_id == f"{r.scene_id}_{r.frame_id}_{r.object_id}_p{r['rank']:03d}"
        assert r.aabb_world[2] < r.aabb_world[5]
    from scenesift.operators.overlay import sample_overlay

    edges = sample_overlay(plan.placements, scene.camera).filter("kind = 'placement'")
    outside = edges.filter("u0 < 0 or u0 >= 640 or v0 < 0 or v0 >= 480 or u1 < 0 or u1 >= 640 or v1 < 0 or v1 >= 480").count()
    assert edges.count() == 12 * len(rows) and outside == 0


def test_documents_round_trip(spark, tables, tmp_path):
    from scenesift.sources import samples as src
    from scenesift.sources import sinks

    scene, plan = tables
    root = str(tmp_path / "out_a")
    sinks.sink_sample_documents(plan.placements, root + "/samples")
    sinks.sink_placements(plan.placements, root + "/placements")
    sinks.sink_samples(plan.placements, root + "/table")
    n = plan.placements.count()
    documents = src.infer_frame_keys(src.scan_samples(spark, [root, str(tmp_path / "missing")], lines=True))
    assert src.sample_rows(documents).count() == n
    assert spark.read.parquet(root + "/table").count() == n
    back = src.load_placements_back(spark, root + "/placements/*/*.json", lines=True)
    assert back.select(F.explode("objects").alias("o")).select(F.explode("o.placements")).count() == n
    first = back.select(F.explode("objects").alias("o")).select(F.explode("o.placements").alias("p")).first().p
    assert len(first.transform_world) == 4 and first.transform_world[3] == [0.0, 0.0, 0.0, 1.0]
    assert placed_summary(scene.objects, plan.placements).agg(F.sum("objects_total")).first()[0] == scene.objects.count()
    assert displacement_stats(plan.placements).filter("min_distance > max_distance").count() == 0
