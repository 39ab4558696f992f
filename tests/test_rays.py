"""Rays as intervals against the sample-by-sample walk, and the layered depth buffer against every voxel."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenesift.operators import occupancy as occ
from scenesift.operators import rays as ry

FK = "scene_id string, frame_id string"
TURN = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def frame(spark, eye, ends, size, padding):
    pose = list(TURN)
    pose[3], pose[7], pose[11] = eye
    camera = spark.createDataFrame([("s", "f", pose)], FK + ", pose array<double>")
    points = spark.createDataFrame([("s", "f", *map(float, p)) for p in ends], FK + ", x double, y double, z double")
    return points, camera, occ.grid_bounds(points, camera, size, padding)


@pytest.mark.parametrize("size,eye,padding", [(5.0, (0.0, 0.0, 100.0), 10.0), (0.37, (3.1, -2.7, 1.9), 0.0), (1.0, (0.1, 0.2, 0.3), 2.0)])
def test_intervals_equal_the_walk(spark, size, eye, padding):
    r = random.Random(size)
    ends = [[e + r.uniform(-60, 60) * size for e in eye] for _ in range(120)]
    for axis in range(3):  # along an axis, and off it by next to nothing
        for shift in (0.0, 1e-13, -1e-9, size / 2):
            for way in (-1, 1):
                end = list(eye)
                end[axis] += way * 40.25 * size
                end[(axis + 1) % 3] += shift
                ends.append(end)
    ends += [list(eye), [eye[0] + size, eye[1] + size, eye[2]], [eye[0] - 7 * size, eye[1] + 7 * size, eye[2] - 7 * size]]
    points, camera, grid = frame(spark, eye, ends, size, padding)
    cast = ry.sampled_rays(points, camera, grid)
    voxels = lambda rows: {(x.i, x.j, k) for x in rows.collect() for k in range(min(x.z0, x.z1), max(x.z0, x.z1) + 1)}
    fast, plain = ry.ray_intervals(points, camera, grid), ry.walked_samples(cast)
    assert voxels(fast) == voxels(plain)
    assert fast.count() < 0.6 * plain.count()
    g = grid.first()
    step = 0.5 * size
    want = set()
    for end in ends:
        ray = np.array(end) - np.array(eye)
        length = math.sqrt(float(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2]))
        for s in range(int(length / step) + 2):
            if length > 0 and s * step < length:
                at = np.array(eye) + ray / length * (s * step)
                want.add(tuple(int(v) for v in np.floor((at - np.array([g.ox, g.oy, g.oz])) / size)))
    assert voxels(plain) == want
    inside = {v for v in want if all(0 <= c < n for c, n in zip(v, (g.gx, g.gy, g.gz)))}
    assert {(x.i, x.j, x.k) for x in occ.raycast_free(points, camera, grid).collect()} == inside


def test_depth_layers_of_overlapping_objects(spark):
    """Objects that share voxels, stand behind each other and fill whole pixels."""
    r = random.Random(5)
    voxels = [(i, j, k) for i in range(12) for j in range(12) for k in range(8) if r.random() < 0.3]
    owned = {f"o{n}": {v for v in voxels if a <= v[2] < b and v[0] % 3 != n} for n, (a, b) in enumerate([(5, 8), (4, 7), (6, 8), (0, 8)])}
    pose = list(TURN)
    pose[3], pose[7], pose[11] = 6.0, 6.0, 30.0
    camera = spark.createDataFrame([("s", "f", 40.0, 40.0, 16.0, 16.0, 33, 33, pose)], FK + ", fx double, fy double, cx double, cy double, img_w int, img_h int, pose array<double>")
    grid = spark.createDataFrame([("s", "f", 0.0, 0.0, 0.0, 1.0, 12, 12, 8)], FK + ", ox double, oy double, oz double, voxel_size double, gx int, gy int, gz int")
    cells = spark.createDataFrame([("s", "f", *v) for v in voxels], FK + ", i int, j int, k int")
    columns = occ._pack(cells, ["scene_id", "frame_id"], "occ").withColumn("free", F.lit(0).cast("long"))
    own = spark.createDataFrame([("s", "f", o, *v) for o, vs in owned.items() for v in vs], FK + ", obj_id string, i int, j int, k int")
    layers = occ.depth_layers(columns, grid, camera, own)
    seen = {(x.i, x.j, x.k): (x.u, x.v, x.z) for x in occ.project_occupied(columns, grid, camera).collect()}
    objects = spark.createDataFrame([("s", "f", o) for o in [*owned, "none"]], FK + ", obj_id string")
    got = {(x.obj_id, x.u, x.v): x.z for x in occ.zbuffer(layers, objects).collect()}
    want = {}
    for o in [*owned, "none"]:
        for v, (pu, pv, z) in seen.items():
            if v not in owned.get(o, ()):
                want[o, pu, pv] = min(z, want.get((o, pu, pv), math.inf))
    assert got == want
    deep = [x.n for x in layers.select(F.size("layers").alias("n")).collect()]
    assert max(deep) > 2 and sorted(deep)[len(deep) // 2] <= 2


def test_rays_are_spread_before_they_fan_out(spark):
    """Points are few bytes, so a merged partition would hold the rays of many frames; hits read the same shuffle."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    points, camera, grid = frame(spark, (0.0, 0.0, 100.0), [(float(n), 3.0, 0.0) for n in range(20)], 5.0, 10.0)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        columns = occ.occupancy_columns(points, camera, grid)
        plan = columns._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert plan.count("7), REPARTITION_BY_NUM") >= 2
    assert {(x.i, x.j, x.w) for x in columns.collect()}


def test_projection_is_short_enough_to_be_compiled(spark):
    """The JVM does not compile a method of more than 8,000 bytes."""
    pose = list(TURN)
    pose[11] = 30.0
    camera = spark.createDataFrame([("s", "f", 40.0, 40.0, 16.0, 16.0, 33, 33, pose)], FK + ", fx double, fy double, cx double, cy double, img_w int, img_h int, pose array<double>")
    grid = spark.createDataFrame([("s", "f", 0.0, 0.0, 0.0, 1.0, 12, 12, 8)], FK + ", ox double, oy double, oz double, voxel_size double, gx int, gy int, gz int")
    columns = spark.createDataFrame([("s", "f", 1, 2, 0, 5)], FK + ", i int, j int, w int, occ long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = occ.project_occupied(columns, grid, camera)._jdf.queryExecution()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", parts)]
    assert sizes and max(sizes) < 8000
