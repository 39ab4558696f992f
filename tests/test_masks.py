"""Morphology, components and clustering against dense brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from scenesift.operators import cluster, components, morphology, placement

FK = "scene_id string, frame_id string"


def mask(gx, gy, seed, share):
    return np.random.default_rng(seed).random((gx, gy)) < share


def shift_all(m, combine):
    padded = np.pad(m, 1)
    return combine([padded[1 + a : 1 + a + m.shape[0], 1 + b : 1 + b + m.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)])


def erode(m):
    return shift_all(m, np.logical_and.reduce)


def dilate(m):
    return shift_all(m, np.logical_or.reduce)


def cells_of(spark, m, extra=()):
    rows = [("s", "f", *extra, int(i), int(j)) for i, j in np.argwhere(m)]
    return spark.createDataFrame(rows, FK + "".join(f", e{n} string" for n in range(len(extra))) + ", i int, j int")


def test_morphology_over_word_borders(spark):
    m = mask(30, 130, 1, 0.8)
    shape = spark.createDataFrame([("s", "f", 30, 130)], FK + ", gx int, gy int")
    cells = cells_of(spark, m)
    wanted = {"erode_2d": erode(m), "dilate_2d": dilate(m), "open_2d": dilate(erode(m)), "close_2d": erode(dilate(m))}
    for name, want in wanted.items():
        got = {(r.i, r.j) for r in getattr(morphology, name)(cells, shape, ["scene_id", "frame_id"]).collect()}
        assert got == {tuple(map(int, c)) for c in np.argwhere(want)}, name


def groups(points, linked):
    """Partition of points by a symmetric relation, as a set of frozensets."""
    left, out = set(points), set()
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            p = stack.pop()
            seen.add(p)
            near = {q for q in left if linked(p, q)}
            left -= near
            stack += near
        out.add(frozenset(seen))
    return out


def test_components_across_tiles(spark):
    m = np.zeros((120, 120), dtype=bool)
    m[10, 5:118] = m[10:100, 117] = m[99, 40:118] = True  # one winding path over several tiles
    m[50:70, 20:30] = True
    m[53:55, 60:70] = True
    key = ["scene_id", "frame_id"]
    rows = components.label_components(cells_of(spark, m), key).collect()
    points = [tuple(map(int, c)) for c in np.argwhere(m)]
    want = groups(points, lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1)
    got = {}
    for r in rows:
        got.setdefault(r.label, set()).add((r.i, r.j))
    assert {frozenset(g) for g in got.values()} == want
    areas = sorted({(r.comp_rank, r.area) for r in rows})
    assert [a for _, a in areas] == sorted((len(g) for g in want), reverse=True)
    assert all(label == min(g)[0] * components.LABEL_BASE + min(g)[1] for label, g in got.items())


def brute_dbscan(candidates, reach2, least):
    order = sorted(candidates, key=lambda c: (c[0], c[1], c[2]))
    near = {c: [d for d in order if (c[1] - d[1]) ** 2 + (c[2] - d[2]) ** 2 <= reach2] for c in order}
    core = [c for c in order if len(near[c]) >= least]
    linked = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= reach2
    parts = sorted(groups(core, linked), key=min)
    label = {c: n for n, part in enumerate(parts) for c in part}
    for c in order:
        if c not in label:
            hits = [label[d] for d in near[c] if d in core]
            if hits:
                label[c] = min(hits)
    return label


def test_dbscan_weights_noise_and_border(spark):
    random.seed(3)
    picks = sorted({(random.randrange(3), random.randrange(70), random.randrange(70)) for _ in range(260)})
    rows = [("s", "f", "o", y, i, j) for y, i, j in picks]
    cand = spark.createDataFrame(rows, FK + ", obj_id string, yaw_idx int, gx int, gy int")
    for reach, least in ((3.0, 1), (4.5, 4)):
        radius = spark.createDataFrame([("s", "f", "o", reach, reach)], FK + ", obj_id string, eps double, reach double")
        got = {(r.yaw_idx, r.gx, r.gy): r.cluster_id for r in cluster.dbscan(cand, radius, least).collect()}
        want = brute_dbscan(picks, reach * reach, least)
        assert got == want, (reach, least)


def test_packed_and_counted_support_agree(spark):
    """The bit form of full support against the counting form, with wide rows."""
    obj = ("s", "f", "o")
    surface = mask(40, 90, 5, 0.93)
    foot = [(i, j) for i, j in itertools.product(range(3), range(4)) if (i, j) != (2, 3)]
    vox = spark.createDataFrame([(*obj, 0, i, j, 7) for i, j in foot], FK + ", obj_id string, yaw_idx int, i int, j int, k int")
    shapes = placement.yaw_shapes(vox)
    grid = spark.createDataFrame([("s", "f", 40, 90, 12)], FK + ", gx int, gy int, gz int")
    cells = spark.createDataFrame([(*obj, 2, int(i), int(j)) for i, j in np.argwhere(surface)], FK + ", obj_id string, table_z int, i int, j int")
    region = placement.search_region(cells, grid)
    obstacles = spark.createDataFrame([("s", "f", 20, 64, 0, 1 << 3)], FK + ", i int, j int, w int, obs long")
    rows = placement.search_rows(vox, shapes, region, obstacles, cells)
    pick = lambda df: {(r.gx, r.gy) for r in df.collect()}
    raw, stable = pick(placement.row_candidates(rows, "raw")), pick(placement.row_candidates(rows, "stable"))
    counted = pick(placement.filter_stable(placement.row_candidates(rows, "raw"), vox, shapes, cells, 1.0))
    hits = {(20 - i, 64 - j) for i, j in foot}
    every = set(itertools.product(range(0, 38), range(0, 87)))
    assert raw == every - hits
    full = {(x, y) for x, y in raw if all(surface[x + i, y + j] for i, j in foot)}
    assert stable == counted and stable <= full
    mi, mj = np.mean([f[0] for f in foot]), np.mean([f[1] for f in foot])
    assert stable == {(x, y) for x, y in full if surface[int(np.round(x + mi)), int(np.round(y + mj))]}


def test_grown_obstacles_cross_tiles_once(spark):
    """Diamond growth by plain loops, over a tile border and the edges of the grid; a word is sent to two tiles at most."""
    random.seed(5)
    gx, gy, height = 70, 9, morphology.TILE_ROWS
    cells = {(i, j, w): 1 << random.randrange(62) for i, j, w in itertools.product((0, 1, height - 2, height, gx - 1), (0, 4, gy - 1), (0, 1))}
    rows = spark.createDataFrame([("s", "f", i, j, w, m) for (i, j, w), m in cells.items()], FK + ", i int, j int, w int, obs long")
    grid = spark.createDataFrame([("s", "f", gx, gy)], FK + ", gx int, gy int")
    for steps in (1, 3):
        want = {}
        for (i, j, w), m in cells.items():
            for a, b in itertools.product(range(-steps, steps + 1), repeat=2):
                at = i + a, j + b, w
                if abs(a) + abs(b) <= steps and 0 <= at[0] < gx and 0 <= at[1] < gy:
                    want[at] = want.get(at, 0) | m
        grown = morphology.dilate_xy(rows, grid, steps)
        assert {(r.i, r.j, r.w): r.obs for r in grown.collect()} == want
    assert "FlatMapGroupsInArrow" in grown._jdf.queryExecution().executedPlan().toString()


def test_search_sends_rows_not_anchors(spark):
    """What the groups of the search receive: a row per pose and a row per grid row, for any number of mask columns and anchors."""
    obj = ("s", "f", "o")
    vox = spark.createDataFrame([(*obj, y, i, j, 5) for y, i, j in itertools.product(range(4), range(6), range(5))], FK + ", obj_id string, yaw_idx int, i int, j int, k int")
    grid = spark.createDataFrame([("s", "f", 30, 20, 12)], FK + ", gx int, gy int, gz int")
    cells = spark.createDataFrame([(*obj, 2, i, j) for i, j in itertools.product(range(30), range(20))], FK + ", obj_id string, table_z int, i int, j int")
    obstacles = spark.createDataFrame([("s", "f", i, j, 0, 1 << 3) for i, j in itertools.product(range(10), range(20))], FK + ", i int, j int, w int, obs long")
    shapes, region = placement.yaw_shapes(vox), placement.search_region(cells, grid)
    poses, ground = placement._search_sides(vox, shapes, region, obstacles, cells)
    assert (poses.count(), ground.count()) == (4, 10 + 30)
    got = {(r.yaw_idx, r.gx, r.gy) for r in placement.row_candidates(placement.search_rows(vox, shapes, region, obstacles, cells), "stable").collect()}
    assert got == set(itertools.product(range(4), range(10, 25), range(16)))


def test_search_of_a_mask_that_comes_twice(spark):
    """Voxels that come twice block as before and are held nowhere, as before."""
    obj = ("s", "f", "o")
    vox = spark.createDataFrame([(*obj, 0, i, j, 5) for i, j in itertools.product(range(2), range(2))] * 2, FK + ", obj_id string, yaw_idx int, i int, j int, k int")
    grid = spark.createDataFrame([("s", "f", 8, 8, 12)], FK + ", gx int, gy int, gz int")
    cells = spark.createDataFrame([(*obj, 2, i, j) for i, j in itertools.product(range(8), range(8))], FK + ", obj_id string, table_z int, i int, j int")
    obstacles = spark.createDataFrame([("s", "f", 7, 7, 0, 1 << 3)], FK + ", i int, j int, w int, obs long")
    rows = placement.search_rows(vox, placement.yaw_shapes(vox), placement.search_region(cells, grid), obstacles, cells)
    assert placement.row_candidates(rows, "raw").count() == 7 * 7 - 1
    assert placement.row_candidates(rows, "stable").count() == 0


def test_clusters_of_any_reach(spark):
    """Sparse and dense pictures of several objects; reaches under one, between the lattice distances and beyond the picture."""
    r = random.Random(12)
    picks, radius = {}, []
    for o, (share, reach) in enumerate([(0.5, 0.9), (0.3, 1.0), (0.2, 1.5), (0.08, 2.3), (0.05, 3.7), (0.02, 12.0), (0.01, 90.0)]):
        name = f"o{o}"
        radius.append(("s", "f", name, reach))
        picks[name] = sorted({(r.randrange(3), i, j) for i in range(18) for j in range(55, 75) for _ in range(2) if r.random() < share / 2})
    rows = spark.createDataFrame([("s", "f", o, *p) for o, ps in picks.items() for p in ps], "scene_id string, frame_id string, obj_id string, yaw_idx int, gx int, gy int")
    reaches = spark.createDataFrame(radius, "scene_id string, frame_id string, obj_id string, reach double")
    for least in (1, 3):
        got = {}
        for x in cluster.dbscan(rows, reaches, least).collect():
            got.setdefault(x.obj_id, {})[x.yaw_idx, x.gx, x.gy] = x.cluster_id
        for _, _, o, reach in radius:
            assert got.get(o, {}) == brute_dbscan(picks[o], reach * reach, least), (o, least)


def test_search_takes_equal_masks_once(monkeypatch):
    """The poses of an object with the same mask are searched once, and a stretch of mask cells is one comparison."""
    import pyarrow as pa

    from scenesift.operators import anchors

    box = [(i, j, k) for i in range(3) for j in range(40) for k in range(2)]
    poses = 24
    numbers = {"vi": 5, "vj": 6, "vk": 7, "ext_i": 3, "ext_j": 40, "gz": 9, "landing_z": 2, "x0": 0, "x1": 30, "y0": 0, "y1": 80, "n_foot": 120}
    lists = {n: pa.array([[c[a] + s for c in random.Random(p).sample(box, len(box))] for p in range(poses)], pa.list_(pa.int32())) for a, (n, s) in enumerate(zip("ijk", (5, 6, 7)))}
    left = pa.table({"scene_id": ["s"] * poses, "frame_id": ["f"] * poses, "obj_id": ["o"] * poses, "yaw_idx": list(range(poses)), **{n: [v] * poses for n, v in numbers.items()},
                     "mean_i": [1.0] * poses, "mean_j": [19.5] * poses, **lists})
    words = pa.list_(pa.int64())
    right = pa.table({"of_obj_id": [None, *["o"] * 60], "w": pa.array([0, *[-1] * 60], pa.int32()), "i": pa.array([9, *sorted([*range(30)] * 2)], pa.int32()), "j": pa.array([[50], *[[0], [1]] * 30], pa.list_(pa.int32())),
                      "m": pa.array([[1 << 2], *[[(1 << anchors.WORD) - 1]] * 60], words)})
    compared = []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, *args, **names: compared.append(1) or unique(x, *args, **names))
    found = anchors.anchor_search(True)(left, right).to_pylist()
    monkeypatch.undo()
    assert len(compared) <= 4
    got = {(x["yaw_idx"], x["gx"], x["gw"] * anchors.WORD + b, kind) for x in found for kind in ("raw", "stable") for b in range(anchors.WORD) if x[kind] >> b & 1}
    free = {(gx, gy) for gx in range(28) for gy in range(41) if not (gx <= 9 < gx + 3 and gy <= 50 < gy + 40)}
    assert got == {(yaw, *at, kind) for yaw in range(poses) for at in free for kind in ("raw", "stable")}


def test_words_that_come_twice_are_linked_once(spark):
    """Many tiles in one batch, some rows of them twice and in parts: runs and areas are those of the picture."""
    m = mask(70, 120, 4, 0.6)
    words = [("s", f"f{n}", i, w, sum(1 << b for b in range(54) if w * 54 + b < 120 and m[i, w * 54 + b])) for n in range(3) for i in range(70) for w in range(3)]
    words += [("s", "f1", i, w, x & 0xFFFF) for _, f, i, w, x in words if f == "f1" and i % 3 == 0]
    rows = spark.createDataFrame(words, FK + ", i int, w int, m long").filter("m != 0")
    runs = components.label_words(rows, ["scene_id", "frame_id"])
    got = {}
    for r in runs.collect():
        for j in range(r.a, r.b + 1):
            assert (r.frame_id, r.i, j) not in got
            got[r.frame_id, r.i, j] = r.label
    want = groups([(int(i), int(j)) for i, j in np.argwhere(m)], lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1)
    for f in ("f0", "f1", "f2"):
        parts = {}
        for (g, i, j), label in got.items():
            if g == f:
                parts.setdefault(label, set()).add((i, j))
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))
