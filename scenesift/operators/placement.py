"""Pose search on a surface: yaw poses, collision search and candidate filters.

A candidate is an anchor cell and a yaw. All anchors of one grid row are kept as
bits of a word. Collision, fit and full support are decided for all anchors of a pose
at a time, mask column by mask column. Only anchors that survive become rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenesift.functions.bits import bit_in_word, explode_bits, word_of
from scenesift.functions.geometry import (
    aabb_center,
    apply_matrix,
    cell,
    corner_array,
    euler_to_matrix,
    matrix_product,
    matrix_to_euler,
    pose_orientation,
    rigid_inverse,
    rotation_z,
    transform_about_center,
    translate,
    world_aabb,
)
from scenesift.operators.anchors import POSE, ROW, anchor_search, bundle_of, bundled_frames, held_words, inside_words, pack_candidates, unhidden_words, unpack_candidates
from scenesift.operators.morphology import dilate_xy, erode_2d, obstacle_columns
from scenesift.operators.occupancy import OBJ, voxelize_boxes
from scenesift.operators.points import FK
from scenesift.session import spread

CANDIDATE = POSE + ["gx", "gy"]

# Fixed value: cells around the surface box that the search still covers.
ROI_PAD = 5


def yaw_grid(objects: DataFrame, yaw_steps: int) -> DataFrame:
    """One row per object and yaw, evenly spaced over the full turn."""
    step = 2.0 * math.pi / yaw_steps
    rows = objects.withColumn("yaw_idx", F.explode(F.sequence(F.lit(0), F.lit(yaw_steps - 1))))
    return rows.withColumn("yaw", F.col("yaw_idx") * F.lit(step))


def yaw_poses(objects: DataFrame, yaw_steps: int, preserve_orientation: bool, threshold_deg: float) -> DataFrame:
    """Object poses turned about the object's own centre.

    A stable pose keeps its roll and pitch; any other one is laid flat.
    """
    kept = pose_orientation(F.col("pose"), F.col("aabb"), threshold_deg, threshold_deg)["is_reasonable"]
    keep = kept if preserve_orientation else F.lit(False)
    angles = matrix_to_euler(F.col("pose"))
    based = objects.select(
        *OBJ, "aabb", keep.alias("keeps_orientation"), angles.alias("angles"),
        F.array(*apply_matrix(F.col("pose"), aabb_center(F.col("aabb")))).alias("center"),
    )
    turned = spread(yaw_grid(based, yaw_steps), POSE)
    rotation = F.when(
        F.col("keeps_orientation"), euler_to_matrix(F.col("angles.roll"), F.col("angles.pitch"), F.col("yaw"))
    ).otherwise(rotation_z(F.col("yaw")))
    turned = turned.withColumn("rotation", rotation)
    center = tuple(F.col("center")[n] for n in range(3))
    return turned.select(
        *POSE, "aabb", "yaw", "keeps_orientation", transform_about_center(F.col("rotation"), F.col("aabb"), center).alias("pose")
    )


def yaw_voxels(poses: DataFrame, grid: DataFrame) -> DataFrame:
    """Absolute voxels of every turned object, clipped to the grid."""
    return voxelize_boxes(poses, grid, POSE)


def yaw_shapes(voxels: DataFrame) -> DataFrame:
    """Smallest voxel, horizontal extents and bottom footprint size per yaw."""
    # The voxels of a pose cross one shuffle and meet in one row, bounded by the grid.
    posed = voxels.dropna(subset=POSE).groupBy(*POSE).agg(
        F.min("i").alias("vi"), F.min("j").alias("vj"), F.min("k").alias("vk"), F.max("i").alias("hi"), F.max("j").alias("hj"),
        F.collect_list(F.struct("i", "j", "k")).alias("a"),
    )
    bottom = F.array_distinct(F.transform(F.filter("a", lambda v: v["k"] == F.col("vk")), lambda v: F.struct(v["i"] - F.col("vi"), v["j"] - F.col("vj"))))
    posed = posed.select(*POSE, "vi", "vj", "vk", (F.col("hi") - F.col("vi") + 1).alias("ext_i"), (F.col("hj") - F.col("vj") + 1).alias("ext_j"), bottom.alias("f"))
    mean = lambda n: F.aggregate("f", F.lit(0.0), lambda total, v: total + v["col" + n]) / F.size("f")
    return posed.select(*POSE, "vi", "vj", "vk", "ext_i", "ext_j", F.size("f").cast("long").alias("n_foot"), mean("1").alias("mean_i"), mean("2").alias("mean_j"))


def search_region(surface_cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Surface bounding box plus margin, clipped to the grid; upper ends exclusive."""
    box = surface_cells.groupBy(*OBJ, "table_z").agg(
        F.min("i").alias("i0"), F.min("j").alias("j0"), F.max("i").alias("i1"), F.max("j").alias("j1")
    ).join(grid.select(*FK, "gx", "gy", "gz"), FK)
    zero = F.lit(0)
    return box.select(
        *OBJ, "table_z", (F.col("table_z") + 1).alias("landing_z"), "gx", "gy", "gz",
        F.greatest(F.col("i0") - ROI_PAD, zero).alias("x0"), F.greatest(F.col("j0") - ROI_PAD, zero).alias("y0"),
        F.least(F.col("i1") + ROI_PAD + 1, "gx").alias("x1"), F.least(F.col("j1") + ROI_PAD + 1, "gy").alias("y1"),
    )


def anchor_rows(shapes: DataFrame, region: DataFrame) -> DataFrame:
    """Poses whose whole mask fits into the search region, with the last anchor row and column."""
    rows = shapes.join(region, OBJ).withColumn("gx_max", F.col("x1") - F.col("ext_i")).withColumn("gy_max", F.col("y1") - F.col("ext_j"))
    return rows.filter((F.col("gx_max") >= F.col("x0")) & (F.col("gy_max") >= F.col("y0")))


def _search_sides(voxels: DataFrame, shapes: DataFrame, region: DataFrame, obstacles: DataFrame, eroded: DataFrame | None):
    """(poses with their voxels as lists, rows of obstacles and surface), both dealt by frame and bundle of its objects.

    A row of obstacles (w >= 0) has the columns and words of its cells and is there once for each bundle, a row of an
    object's surface (w = -1) its packed words.
    """
    lists = voxels.groupBy(*POSE).agg(F.collect_list(F.struct(*[F.col(n).cast("int").alias(n) for n in "ijk"])).alias("a"))
    numbers = [F.col(c).cast("int").alias(c) for c in ("vi", "vj", "vk", "ext_i", "ext_j", "gz", "landing_z", "x0", "x1", "y0", "y1")]
    means = [F.col("n_foot").cast("long").alias("n_foot"), F.col("mean_i").cast("double").alias("mean_i"), F.col("mean_j").cast("double").alias("mean_j")]
    frames = bundled_frames(region)
    poses = anchor_rows(shapes, region).join(lists, POSE).join(frames, FK).select(*POSE, bundle_of("obj_id").alias("bundle"), *numbers, *means, "a.i", "a.j", "a.k")
    lines = obstacles.filter(F.col("obs") != 0).groupBy(*FK, "w", "i").agg(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), "obs")).alias("a"))
    met = lines.join(frames, FK).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)))
    ground = met.select(*FK, "bundle", F.lit(None).cast(region.schema["obj_id"].dataType).alias("obj_id"), F.col("w").cast("int").alias("w"), F.col("i").cast("int").alias("i"), "a.j", F.col("a.obs").alias("m"))
    if eroded is not None:
        rows = eroded.groupBy(*OBJ, F.col("i").cast("int").alias("i"), word_of(F.col("j")).alias("jw")).agg(F.bit_or(bit_in_word(F.col("j"))).alias("m"))
        rows = rows.join(frames, FK).select(*FK, bundle_of("obj_id").alias("bundle"), "obj_id", F.lit(-1).alias("w"), "i", F.array("jw").alias("j"), F.array("m").alias("m"))
        ground = ground.unionByName(rows)
    names = {c: "of_" + c for c in (*OBJ, "bundle")}
    return spread(poses, FK + ["bundle"]), spread(ground.withColumnsRenamed(names), ["of_" + c for c in (*FK, "bundle")])


def search_rows(voxels: DataFrame, shapes: DataFrame, region: DataFrame, obstacles: DataFrame, eroded: DataFrame | None = None) -> DataFrame:
    """Packed anchors (pose, gx, gw, raw, stable).

    ``raw``: fits and meets no obstacle. ``stable``: also every footprint cell and the
    centre of mass lie on the eroded surface (null without ``eroded``).

    The poses of some objects of a frame meet its obstacles and their surfaces in one group: a mask column is one
    comparison with all anchors at a time, and only words of anchors leave the group.
    """
    poses, ground = _search_sides(voxels, shapes, region, obstacles, eroded)
    keys = [poses.schema[c] for c in POSE]
    answer = T.StructType(keys + [T.StructField(n, t) for n, t in (("gx", T.IntegerType()), ("gw", T.IntegerType()), ("raw", T.LongType()), ("stable", T.LongType()))])
    sides = poses.groupBy(*FK, "bundle").cogroup(ground.groupBy(*["of_" + c for c in (*FK, "bundle")]))
    return sides.applyInArrow(anchor_search(eroded is not None), answer)


def row_candidates(rows: DataFrame, bits: str) -> DataFrame:
    """Packed anchors to candidate rows."""
    live = rows.filter(F.col(bits) != 0).withColumnRenamed(bits, "_bits")
    keep = [c for c in live.columns if c not in ("raw", "stable", "visible", "kept")]
    return explode_bits(live.select(*keep), "_bits", "gw", "gy", wide=True)


def collision_search(columns: DataFrame, grid: DataFrame, voxels: DataFrame, shapes: DataFrame, region: DataFrame, safety_margin: float, voxel_size: float) -> DataFrame:
    """Collision-free candidates (object, yaw_idx, gx, gy)."""
    steps = max(0, math.ceil(safety_margin / voxel_size))
    obstacles = dilate_xy(obstacle_columns(columns, grid), grid, steps)
    return row_candidates(search_rows(voxels, shapes, region, obstacles), "raw")


def search_meta(candidates: DataFrame, region: DataFrame, yaw_steps: int) -> DataFrame:
    counts = candidates.groupBy(*OBJ).agg(
        F.count(F.lit(1)).alias("valid_raw"), F.countDistinct("yaw_idx").alias("valid_yaw_angles")
    )
    zero = F.lit(0).cast("long")
    return region.join(counts, OBJ, "left").select(
        *OBJ, (F.col("gx").cast("long") * F.col("gy")).alias("total_xy"), F.coalesce("valid_raw", zero).alias("valid_raw"),
        F.lit(yaw_steps).alias("yaw_steps"), F.coalesce("valid_yaw_angles", zero).alias("valid_yaw_angles"), "landing_z", "table_z",
    )


def stable_rows(rows: DataFrame, voxels: DataFrame, shapes: DataFrame, eroded: DataFrame, min_support_ratio: float, bits: str) -> DataFrame:
    """Packed anchors with enough footprint on the eroded surface and the centre of mass on it, as ``bits`` words.

    General form for any ratio. A ratio of one is decided in ``search_rows``.
    """
    foot = voxels.join(shapes.select(*POSE, "vi", "vj", "vk"), POSE).filter(F.col("k") == F.col("vk"))
    foot = foot.groupBy(*POSE).agg(F.collect_list(F.struct((F.col("i") - F.col("vi")).alias("di"), (F.col("j") - F.col("vj")).alias("dj"))).alias("f"))
    feet = shapes.select(*POSE, "n_foot", "mean_i", "mean_j").join(foot.select(*POSE, "f.di", "f.dj"), POSE)
    held = held_words(rows.filter(F.col(bits) != 0), feet, eroded, min_support_ratio, bits)
    return held.withColumnRenamed("word", "bits")


def filter_stable(candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, eroded: DataFrame, min_support_ratio: float) -> DataFrame:
    """Candidates with enough footprint on the eroded surface and the centre of mass on it (``stable_rows``)."""
    return unpack_candidates(stable_rows(pack_candidates(candidates), voxels, shapes, eroded, min_support_ratio, "bits")).select(*CANDIDATE)


def eroded_surface(surface_cells: DataFrame, grid: DataFrame) -> DataFrame:
    return erode_2d(surface_cells, grid, OBJ + ["table_z"])


def camera_views(poses: DataFrame, shapes: DataFrame, region: DataFrame, grid: DataFrame, camera: DataFrame) -> DataFrame:
    """What the camera tests need per pose: base corners in camera space and the anchor shift."""
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", "img_w", "img_h", rigid_inverse(F.col("pose")).alias("w2c"))
    posed = poses.join(shapes.select(*POSE, "vi", "vj", "vk"), POSE).join(region.select(*OBJ, "landing_z"), OBJ)
    posed = posed.join(cam, FK).join(grid.select(*FK, "voxel_size"), FK)
    posed = posed.withColumn("pose_cam", matrix_product(F.col("w2c"), F.col("pose")))
    return posed.select(
        *POSE, "fx", "fy", "cx", "cy", "img_w", "img_h", "voxel_size", "vi", "vj", "w2c",
        ((F.col("landing_z") - F.col("vk")) * F.col("voxel_size")).alias("lift"),
        corner_array(F.col("aabb"), F.col("pose_cam")).alias("base"),
    )


def visible_rows(rows: DataFrame, views: DataFrame, bits: str) -> DataFrame:
    """Packed anchors (ROW, ``bits``) whose box is fully inside the image, as ``visible`` words."""
    return inside_words(rows, views, bits, "visible")


def unoccluded_rows(rows: DataFrame, views: DataFrame, layers: DataFrame, threshold: float, bits: str) -> DataFrame:
    """Packed anchors (ROW, ``bits``) with few enough corners behind scene geometry (``depth_layers``), as ``kept`` words."""
    return unhidden_words(rows, views, layers, threshold, bits, "kept")


def filter_visible(candidates: DataFrame, views: DataFrame) -> DataFrame:
    """Keep candidates whose box is fully inside the image."""
    return row_candidates(visible_rows(pack_candidates(candidates), views, "bits").drop("bits"), "visible").select(*CANDIDATE)


def filter_occluded(candidates: DataFrame, views: DataFrame, layers: DataFrame, threshold: float) -> DataFrame:
    """Drop candidates with too large a share of corners behind scene geometry (``depth_layers``)."""
    return row_candidates(unoccluded_rows(pack_candidates(candidates), views, layers, threshold, "bits").drop("bits"), "kept").select(*CANDIDATE)


def anchor_transforms(chosen: DataFrame, poses: DataFrame, shapes: DataFrame, grid: DataFrame) -> DataFrame:
    """World transform of placed anchors (gx, gy, landing_z): the yaw pose moved by whole voxels."""
    posed = poses.select(*POSE, "aabb", "yaw", "pose").join(shapes.select(*POSE, "vi", "vj", "vk"), POSE)
    rows = chosen.join(posed, POSE).join(grid.select(*FK, "voxel_size"), FK)
    vs = F.col("voxel_size")
    delta = (
        (F.col("gx") - F.col("vi")) * vs, (F.col("gy") - F.col("vj")) * vs, (F.col("landing_z") - F.col("vk")) * vs,
    )
    rows = rows.withColumn("transform_world", translate(F.col("pose"), delta))
    return rows.withColumn("aabb_world", world_aabb(F.col("aabb"), F.col("transform_world"))).withColumn(
        "center_world", F.array(*apply_matrix(F.col("transform_world"), aabb_center(F.col("aabb"))))
    ).drop("pose", "vi", "vj", "vk", "voxel_size")
