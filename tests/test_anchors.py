"""Packed anchor tests against plain loops over candidates."""

import random

from scenesift.functions.bits import WORD
from scenesift.operators import cluster, placement
from scenesift.operators.anchors import pack_candidates, unpack_candidates

POSE_TYPES = "scene_id string, frame_id string, obj_id string, yaw_idx int"
VIEW = (
    f"{POSE_TYPES}, fx double, fy double, cx double, cy double, img_w int, img_h int, w2c array<double>, voxel_size double, vi int, vj int, "
    "lift double, base array<struct<x:double,y:double,z:double>>"
)
TURN = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 100.0, 0.0, 0.0, 0.0, 1.0]


def pose(obj, yaw):
    return ("s", "f", obj, yaw)


def view(key, shift):
    corners = [(x + shift, y - shift, z) for z in (60.0, 70.0) for y in (-4.0, 6.0) for x in (-5.0, 5.5)]
    return (*key, 40.0, 40.0, 32.0, 24.0, 64, 48, TURN, 1.5, 20, 30, 2.0, corners)


def pixels(v, gx, gy):
    fx, fy, cx, cy, w, h, m, vs, vi, vj, lift, base = v[4:]
    step = ((gx - vi) * vs, (gy - vj) * vs, lift)
    for c in base:
        x, y, z = (c[r] + (m[4 * r] * step[0] + m[4 * r + 1] * step[1] + m[4 * r + 2] * step[2]) for r in range(3))
        yield x / z * fx + cx, y / z * fy + cy, z, w, h, vs


def scene(spark):
    rng = random.Random(3)
    keys = [pose(o, y) for o in ("a", "b") for y in (0, 1)]
    views = [view(k, n * 3.0) for n, k in enumerate(keys)]
    picks = sorted({(*rng.choice(keys), rng.randrange(0, 45), rng.randrange(0, 140)) for _ in range(900)})
    rows = spark.createDataFrame(picks, f"{POSE_TYPES}, gx int, gy int")
    # One pose is seen by two equal cameras: its hidden corners count twice.
    seen = spark.createDataFrame([*views, views[0]], VIEW)
    return picks, rows, {v[:4]: v for v in views}, seen, keys[0]


def collected(df, *extra):
    return sorted((r.scene_id, r.frame_id, r.obj_id, r.yaw_idx, r.gx, r.gy, *[r[c] for c in extra]) for r in df.collect())


def test_pack_and_unpack(spark):
    picks, rows, *_ = scene(spark)
    words = pack_candidates(rows)
    assert words.count() < len(picks) and pack_candidates(words) is words
    assert collected(unpack_candidates(words)) == picks


def test_image_test(spark):
    picks, rows, views, seen, _ = scene(spark)
    want = [p for p in picks if all(z > 0 and 0 <= u < w and 0 <= v < h for u, v, z, w, h, _ in pixels(views[p[:4]], *p[4:]))]
    assert 0 < len(want) < len(picks)
    assert collected(placement.filter_visible(rows, seen)) == want
    words = placement.visible_rows(pack_candidates(rows), seen, "bits")
    assert set(words.columns) >= {"gw", "bits", "visible"}
    # A pose without a view has no failing corner.
    assert collected(placement.filter_visible(rows, seen.filter("obj_id = 'none'"))) == picks


def test_occlusion(spark):
    picks, rows, views, seen, twice = scene(spark)
    rng = random.Random(5)
    depth = {(u, v): (rng.choice([50.0, 61.0, 68.0, 90.0]), rng.choice([[], ["a"], ["b"]])) for u in range(0, 64) for v in range(0, 48) if rng.random() < 0.5}
    layers = spark.createDataFrame(
        [("s", "f", u, v, [(z, own)]) for (u, v), (z, own) in depth.items()],
        "scene_id string, frame_id string, u int, v int, layers array<struct<z:double,owners:array<string>>>",
    )

    def hidden(p):
        n = 0
        for u, v, z, w, h, vs in pixels(views[p[:4]], *p[4:]):
            at = (int(max(0, min(w - 1, round(u)))), int(max(0, min(h - 1, round(v)))))
            n += at in depth and p[2] not in depth[at][1] and z > depth[at][0] + vs
        return n * (2 if p[:4] == twice else 1)

    want = [p for p in picks if hidden(p) / 8 <= 0.3]
    assert 0 < len(want) < len(picks)
    assert collected(placement.filter_occluded(rows, seen, layers, 0.3)) == want


def test_support_ratio(spark):
    rng = random.Random(8)
    picks, rows, *_ = scene(spark)
    cells = sorted({(rng.randrange(0, 50), rng.randrange(0, 150)) for _ in range(5000)})
    surface = spark.createDataFrame([("s", "f", o, i, j) for o in ("a", "b") for i, j in cells], "scene_id string, frame_id string, obj_id string, i int, j int")
    feet = [(di, dj) for di in range(2) for dj in range(3)]
    keys = sorted({p[:4] for p in picks})
    voxels = spark.createDataFrame([(*k, 7 + di, 9 + dj, 4 + up) for k in keys for di, dj in feet for up in range(2)], f"{POSE_TYPES}, i int, j int, k int")
    shapes = placement.yaw_shapes(voxels)
    have = set(cells)

    def held(p):
        mass = (round(p[4] + 0.5), round(p[5] + 1.0))
        return mass in have and sum((p[4] + di, p[5] + dj) in have for di, dj in feet) / 6 >= 0.75

    want = [p for p in picks if held(p)]
    assert 0 < len(want) < len(picks)
    assert collected(placement.filter_stable(rows, voxels, shapes, surface, 0.75)) == want


def test_clusters_of_words(spark):
    picks, rows, *_ = scene(spark)
    radius = spark.createDataFrame([("s", "f", o, 2.5) for o in ("a", "b")], "scene_id string, frame_id string, obj_id string, reach double")
    words = pack_candidates(rows)
    packed = cluster.dbscan(words, radius, 1)
    plain = cluster.dbscan(rows, radius, 1)
    assert "gw" in packed.columns
    assert collected(unpack_candidates(packed), "cluster_id") == collected(plain, "cluster_id")
    best = {(r.obj_id, r.cluster_id): r for r in cluster.cluster_representative(packed).collect()}
    groups = {}
    for *key, gx, gy, cluster_id in collected(plain, "cluster_id"):
        groups.setdefault((key[2], cluster_id), []).append((key[3], gx, gy))
    assert set(best) == set(groups)
    for key, members in groups.items():
        pool = [m for m in members if m[0] == 0] or members
        mx, my = sum(m[1] for m in pool) / len(pool), sum(m[2] for m in pool) / len(pool)
        least = min((round((x - mx) ** 2 + (y - my) ** 2, 9), yaw, x, y) for yaw, x, y in pool)
        assert (best[key].size, best[key].yaw_idx, best[key].gx, best[key].gy) == (len(members), *least[1:])


def test_words_hold_62_columns(spark):
    rows = spark.createDataFrame([(*pose("a", 0), 3, gy) for gy in (0, WORD - 1, WORD, 2 * WORD)], f"{POSE_TYPES}, gx int, gy int")
    assert sorted(r.gw for r in pack_candidates(rows).collect()) == [0, 1, 2]


def test_words_are_not_unpacked(spark):
    """Image test, occlusion test, clusters and representatives take words: no row for a candidate, no join back to it."""
    _, rows, _, seen, _ = scene(spark)
    words = spark.createDataFrame(pack_candidates(rows).collect(), f"{POSE_TYPES}, gx int, gw int, bits long")
    radius = spark.createDataFrame([("s", "f", o, 2.5) for o in ("a", "b")], "scene_id string, frame_id string, obj_id string, reach double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(placement.visible_rows(words, seen, "bits"))
    packed = cluster.dbscan(words, radius, 1)
    assert "Generate" not in plan(packed) and "FlatMapGroupsInArrow" in plan(packed)
    held = cluster._nearest_in_words(packed.selectExpr("*", "7.5D AS cy"))
    assert packed.count() <= held.count() <= 2 * packed.count()
