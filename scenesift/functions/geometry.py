"""Geometry as Column expressions.

A 4x4 matrix is a row-major ``ARRAY<DOUBLE>`` of 16; an AABB is
``[min x, min y, min z, max x, max y, max z]``. No function here is a UDF, so
every use stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = tuple  # three Columns


def dlit(value: float) -> Column:
    return F.lit(float(value))


def at(array: Column, index: int) -> Column:
    """Array element without the out-of-range error path, which bloats generated code."""
    return F.get(array, F.lit(index))


def cell(matrix: Column, row: int, col: int) -> Column:
    return at(matrix, row * 4 + col)


def apply_matrix(matrix: Column, p: XYZ) -> XYZ:
    """Homogeneous 4x4 matrix times a point."""
    x, y, z = p
    return tuple(
        cell(matrix, r, 0) * x + cell(matrix, r, 1) * y + cell(matrix, r, 2) * z + cell(matrix, r, 3)
        for r in range(3)
    )


def apply_rotation(matrix: Column, p: XYZ) -> XYZ:
    x, y, z = p
    return tuple(
        cell(matrix, r, 0) * x + cell(matrix, r, 1) * y + cell(matrix, r, 2) * z for r in range(3)
    )


def apply_transposed_rotation(matrix: Column, p: XYZ) -> XYZ:
    x, y, z = p
    return tuple(
        cell(matrix, 0, c) * x + cell(matrix, 1, c) * y + cell(matrix, 2, c) * z for c in range(3)
    )


def make_matrix(rotation_rows, translation: XYZ) -> Column:
    """16-element array from a 3x3 nested sequence and a translation.

    Built from rows: a flattened array is computed once per row of data, while a flat
    ``array(...)`` would be re-expanded by the optimizer at each element access.
    """
    rows = [F.array(*row, t) for row, t in zip(rotation_rows, translation)]
    return F.flatten(F.array(*rows, F.array(dlit(0), dlit(0), dlit(0), dlit(1))))


def rigid_inverse(matrix: Column) -> Column:
    """Inverse of a rigid transform: transposed rotation, ``-R^T t``."""
    t = tuple(cell(matrix, r, 3) for r in range(3))
    moved = apply_transposed_rotation(matrix, t)
    rows = [[cell(matrix, c, r) for c in range(3)] for r in range(3)]
    return make_matrix(rows, tuple(-m for m in moved))


def matrix_product(a: Column, b: Column) -> Column:
    rows = [
        [sum((cell(a, r, k) * cell(b, k, c) for k in range(1, 3)), cell(a, r, 0) * cell(b, 0, c)) for c in range(3)]
        for r in range(3)
    ]
    shift = tuple(cell(b, k, 3) for k in range(3))
    return make_matrix(rows, apply_matrix(a, shift))


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Row-major 3x3 intrinsic matrix."""
    zero, one = dlit(0), dlit(1)
    return F.array(fx, zero, cx, zero, fy, cy, zero, zero, one)


def rotation_z(angle: Column) -> Column:
    c, s, zero, one = F.cos(angle), F.sin(angle), dlit(0), dlit(1)
    return make_matrix([[c, -s, zero], [s, c, zero], [zero, zero, one]], (zero, zero, zero))


def euler_to_matrix(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    zero = dlit(0)
    return make_matrix(
        [
            [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
            [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
            [-sp, cp * sr, cp * cr],
        ],
        (zero, zero, zero),
    )


# Below this length of the first rotation column's XY part the
# decomposition is singular and yaw is set to zero.
SINGULAR_BELOW = 1e-6


def matrix_to_euler(matrix: Column) -> Column:
    """struct(roll, pitch, yaw) of the ZYX decomposition."""
    r = lambda i, j: cell(matrix, i, j)
    reach = F.sqrt(r(0, 0) * r(0, 0) + r(1, 0) * r(1, 0))
    singular = reach < SINGULAR_BELOW
    return F.struct(
        F.when(singular, F.atan2(-r(1, 2), r(1, 1))).otherwise(F.atan2(r(2, 1), r(2, 2))).alias("roll"),
        F.atan2(-r(2, 0), reach).alias("pitch"),
        F.when(singular, dlit(0)).otherwise(F.atan2(r(1, 0), r(0, 0))).alias("yaw"),
    )


def _index_of(values, best: Column) -> Column:
    """0-based index of the first of three values that equals ``best``."""
    a, b, _ = values
    return F.when(a == best, 0).when(b == best, 1).otherwise(2)


def aabb_sizes(aabb: Column) -> XYZ:
    return tuple(at(aabb, i + 3) - at(aabb, i) for i in range(3))


def aabb_center(aabb: Column) -> XYZ:
    return tuple((at(aabb, i) + at(aabb, i + 3)) / 2.0 for i in range(3))


def pose_orientation(pose: Column, aabb: Column, flat_deg: float, upright_deg: float) -> Column:
    """Which local axis is vertical and whether the pose counts as stable."""
    sizes = aabb_sizes(aabb)
    lean = tuple(F.abs(cell(pose, 2, i)) for i in range(3))
    alignment = F.greatest(*lean)
    vertical = _index_of(lean, alignment)
    flat_axis = _index_of(sizes, F.least(*sizes))
    upright_axis = _index_of(sizes, F.greatest(*sizes))
    flat_limit, upright_limit = math.cos(math.radians(flat_deg)), math.cos(math.radians(upright_deg))
    aligned = alignment >= min(flat_limit, upright_limit)
    return F.struct(
        vertical.alias("vertical_axis_index"),
        alignment.alias("vertical_axis_alignment"),
        flat_axis.alias("flat_axis_index"),
        upright_axis.alias("upright_axis_index"),
        aligned.alias("is_axis_aligned"),
        ((vertical == flat_axis) & (alignment >= flat_limit)).alias("is_flat"),
        ((vertical == upright_axis) & (alignment >= upright_limit)).alias("is_upright"),
        aligned.alias("is_reasonable"),
    )


def transform_about_center(rotation: Column, aabb: Column, center: XYZ) -> Column:
    """Rotation with the translation that brings the AABB centre to ``center``."""
    turned = apply_rotation(rotation, aabb_center(aabb))
    rows = [[cell(rotation, r, c) for c in range(3)] for r in range(3)]
    return make_matrix(rows, tuple(c - t for c, t in zip(center, turned)))


def translate(matrix: Column, delta: XYZ) -> Column:
    rows = [[cell(matrix, r, c) for c in range(3)] for r in range(3)]
    return make_matrix(rows, tuple(cell(matrix, r, 3) + d for r, d in zip(range(3), delta)))


def corner(aabb: Column, index: Column) -> XYZ:
    """Corner ``index = 4 z + 2 y + x`` (0 = min side, 1 = max side) of an index column."""
    return tuple(
        F.when(index.bitwiseAND(F.lit(1 << axis)) == 0, at(aabb, axis)).otherwise(at(aabb, axis + 3)) for axis in range(3)
    )


def corner_array(aabb: Column, pose: Column) -> Column:
    """Array of eight structs (x, y, z) of the posed corners; ``pose`` should be a plain column."""

    def posed(index):
        x, y, z = apply_matrix(pose, corner(aabb, index))
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    return F.transform(F.sequence(F.lit(0), F.lit(7)), posed)


def world_aabb(aabb: Column, pose: Column) -> Column:
    """AABB of the posed box: its centre, plus and minus the absolute rotation times the half sizes."""
    centre = apply_matrix(pose, aabb_center(aabb))
    half = tuple(s / 2.0 for s in aabb_sizes(aabb))
    reach = tuple(
        F.abs(cell(pose, r, 0)) * half[0] + F.abs(cell(pose, r, 1)) * half[1] + F.abs(cell(pose, r, 2)) * half[2]
        for r in range(3)
    )
    lows, highs = [c - e for c, e in zip(centre, reach)], [c + e for c, e in zip(centre, reach)]
    return F.concat(F.array(*lows), F.array(*highs))


# A camera depth nearer to zero than this is replaced by it before dividing.
DEPTH_FLOOR = 1e-8


def project_camera_point(p: XYZ, fx: Column, fy: Column, cx: Column, cy: Column):
    """(u, v, z) of a camera-space point: intrinsics first, then the guarded division."""
    x, y, z = p
    safe = F.when(F.abs(z) < DEPTH_FLOOR, dlit(DEPTH_FLOOR)).otherwise(z)
    return (fx * x + cx * z) / safe, (fy * y + cy * z) / safe, z


def pixel_index(value: Column, size: Column) -> Column:
    """Half-to-even rounding, clipped into the image."""
    return F.greatest(dlit(0), F.least((size - 1).cast("double"), F.rint(value))).cast("int")


# Corner quadrilateral of the box face that points down, by
# (dominant local axis, sign of the down direction on it).
CONTACT_FACES = (
    (0, 1, (1, 3, 7, 5)),
    (0, -1, (0, 2, 6, 4)),
    (1, 1, (2, 3, 7, 6)),
    (1, -1, (0, 1, 5, 4)),
    (2, 1, (4, 5, 7, 6)),
    (2, -1, (0, 1, 3, 2)),
)


def contact_face(pose: Column) -> Column:
    """Corner indices of the face resting on a horizontal surface (+Z is up)."""
    down = tuple(-cell(pose, 2, i) for i in range(3))
    strongest = F.greatest(*[F.abs(d) for d in down])
    axis = _index_of(tuple(F.abs(d) for d in down), strongest)
    sign = F.signum(F.when(axis == 0, down[0]).when(axis == 1, down[1]).otherwise(down[2]))
    chain = None
    for a, s, corners in CONTACT_FACES:
        hit, value = (axis == a) & (sign == float(s)), F.array(*[F.lit(c) for c in corners])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


# The twelve box edges as corner index pairs.
BOX_EDGES = (
    (0, 1), (2, 3), (4, 5), (6, 7),
    (0, 2), (1, 3), (4, 6), (5, 7),
    (0, 4), (1, 5), (2, 6), (3, 7),
)


def edge_structs() -> Column:
    """Array of structs (edge, a, b) of the twelve box edges."""
    return F.array(
        *[F.struct(F.lit(n).alias("edge"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(BOX_EDGES)]
    )


def voxel_index(value: Column, origin: Column, voxel_size) -> Column:
    return F.floor((value - origin) / voxel_size).cast("int")


def voxel_center(index: Column, origin: Column, voxel_size) -> Column:
    return origin + (index + 0.5) * voxel_size
