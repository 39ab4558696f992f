import math

import pytest
from pyspark.sql import functions as F

from scenesift.functions import boxes as bx
from scenesift.functions import geometry as geo


def aabb(*size):
    return [-s / 2 for s in size] + [s / 2 for s in size]


def pose(rotation):
    flat = []
    for row in rotation:
        flat += [float(v) for v in row] + [0.0]
    return flat + [0.0, 0.0, 0.0, 1.0]


# Measured rotations with known classes.
REMOTE = [[-0.3736369689557053, 0.6121312233971954, 0.6969151890810263], [0.36354947409558036, -0.594577755994652, 0.7171534507768815], [0.8533622884299574, 0.5213181921040281, -0.000383753785208301]]
BOTTLE = [[0.012359447067249974, 0.6779096292103588, 0.7350413448861643], [0.01462940798799423, -0.7351414059370607, 0.677755924871779], [0.9998165954264353, 0.002376531244415877, -0.019003357838330986]]
CUP = [[-0.36858265550763186, -0.01955667608560278, 0.9293892416417485], [0.9291522909979096, 0.02310052084795846, 0.36897477701041403], [-0.028685295750162727, 0.9995418462260788, 0.00965667907149146]]


def orientation(spark, matrix, box, degrees):
    df = spark.createDataFrame([(matrix, box)], "pose array<double>, aabb array<double>")
    return df.select(geo.pose_orientation(F.col("pose"), F.col("aabb"), degrees, degrees).alias("o")).select("o.*").first()


@pytest.mark.parametrize("angles,size,flat,upright", [((2, -3, 45), (12, 8, 2), True, False), ((90, 2, 30), (2, 12, 2), False, True)])
def test_orientation_from_angles(spark, angles, size, flat, upright):
    turned = spark.range(1).select(geo.euler_to_matrix(*[F.lit(math.radians(a)) for a in angles]).alias("m")).first()["m"]
    got = orientation(spark, turned, aabb(*size), 5.0)
    assert (got.is_flat, got.is_upright, got.is_reasonable) == (flat, upright, True)


def test_orientation_of_measured_poses(spark):
    got = orientation(spark, pose(REMOTE), aabb(22, 3, 5), 5.0)
    assert not got.is_flat and not got.is_upright and not got.is_reasonable
    got = orientation(spark, pose(BOTTLE), aabb(3.5045, 17.4296, 8.1445), 15.0)
    assert (got.flat_axis_index, got.vertical_axis_index) == (0, 0) and got.is_axis_aligned and got.is_flat and not got.is_upright
    got = orientation(spark, pose(CUP), aabb(11.0143, 8.9232, 8.0969), 5.0)
    assert (got.vertical_axis_index, got.flat_axis_index, got.upright_axis_index) == (1, 2, 0)
    assert got.is_reasonable and not got.is_flat and not got.is_upright


def test_kept_orientation_in_yaw_poses(spark):
    from scenesift.operators.placement import yaw_poses

    placed = pose(CUP)
    placed[3], placed[7], placed[11] = 18.266, -6.007, 0.2267
    row = spark.createDataFrame([("s", "f", "o", aabb(11.0143, 8.9232, 8.0969), placed)], "scene_id string, frame_id string, obj_id string, aabb array<double>, pose array<double>")
    got = yaw_poses(row, 1, True, 5.0).first()
    assert got.keeps_orientation and abs(got.pose[9]) > 0.99
    assert got.pose[:3] != pytest.approx([1.0, 0.0, 0.0], abs=1e-3)


def test_euler_round_trip_and_singular(spark):
    df = spark.createDataFrame([(0.3, -0.4, 1.2), (1.0, math.pi / 2, 0.0)], "r double, p double, y double")
    got = df.select("r", "p", "y", geo.euler_to_matrix(F.col("r"), F.col("p"), F.col("y")).alias("m")).select("r", "p", "y", geo.matrix_to_euler(F.col("m")).alias("e")).collect()
    assert list(got[0].e) == pytest.approx([0.3, -0.4, 1.2])
    assert got[1].e.yaw == 0.0 and got[1].e.pitch == pytest.approx(math.pi / 2)


def test_rigid_inverse_undoes_pose(spark):
    df = spark.range(1).select(geo.translate(geo.euler_to_matrix(F.lit(0.2), F.lit(0.5), F.lit(-1.0)), tuple(F.lit(float(v)) for v in (1, 2, 3))).alias("m"))
    got = df.select(geo.matrix_product(F.col("m"), geo.rigid_inverse(F.col("m"))).alias("i")).first()["i"]
    assert got == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], abs=1e-12)


def test_rotated_boxes(spark):
    import itertools

    import numpy as np

    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0, 0.0, 0.0, 0.0, 4.0, 2.0, math.pi / 2), (0.0, 0.0, 2.0, 2.0, 0.0, 0.5, 0.2, 2.0, 3.0, 0.7)], "ax double, ay double, al double, aw double, at double, bx double, by double, bl double, bw double, bt double")
    one = F.lit(1.0)
    a = bx.box(F.col("ax"), F.col("ay"), F.lit(0.0), F.col("al"), F.col("aw"), one, F.col("at"))
    b = bx.box(F.col("bx"), F.col("by"), F.lit(0.0), F.col("bl"), F.col("bw"), one, F.col("bt"))
    got = [r.i for r in df.select(bx.iou3d(a, b).alias("i")).collect()]
    assert got[0] == pytest.approx(4 / 12)
    grid = np.linspace(-3, 3, 1201)
    x, y = np.meshgrid(grid, grid)

    def inside(cx, cy, l, w, t):
        dx, dy = x - cx, y - cy
        return (abs(np.cos(t) * dx + np.sin(t) * dy) <= l / 2) & (abs(np.cos(t) * dy - np.sin(t) * dx) <= w / 2)

    p, q = inside(0, 0, 2, 2, 0), inside(0.5, 0.2, 2, 3, 0.7)
    assert got[1] == pytest.approx((p & q).sum() / (p | q).sum(), abs=0.01)
    back = df.select(bx.corners_to_box(bx.box_to_corners(b)).alias("r")).collect()[1].r
    assert [back.cx, back.cy, back.l, back.w, back.yaw] == pytest.approx([0.5, 0.2, 2.0, 3.0, 0.7])
