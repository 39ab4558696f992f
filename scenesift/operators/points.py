"""Depth pixels to points, and point cloud reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenesift.functions.geometry import apply_matrix, project_camera_point, rigid_inverse, voxel_index

FK = ["scene_id", "frame_id"]


def explode_depth(frames: DataFrame) -> DataFrame:
    """Dense frames (depth ARRAY, w) to pixel rows; the frame row stays whole until here."""
    return frames.select(*FK, "w", F.posexplode("depth").alias("pos", "d")).select(
        *FK,
        (F.col("pos") % F.col("w")).cast("int").alias("u"),
        F.floor(F.col("pos") / F.col("w")).cast("int").alias("v"),
        F.col("d").cast("double").alias("d"),
    )


def stride_sample(depth_px: DataFrame, stride: int) -> DataFrame:
    """Valid pixels on the sampling lattice."""
    valid = depth_px.filter(F.col("d") > 0)
    if stride > 1:
        valid = valid.filter((F.col("u") % stride == 0) & (F.col("v") % stride == 0))
    return valid


def depth_to_points(depth_px: DataFrame, camera: DataFrame, stride: int = 1, colors: DataFrame | None = None) -> DataFrame:
    """Back-project sampled pixels to world points.

    The camera is one row per frame. No broadcast hint: its size grows with the
    number of frames, so the optimizer decides by its measured size.
    """
    px = stride_sample(depth_px, stride)
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", "pose")
    d = F.col("d")
    local = ((F.col("u") - F.col("cx")) / F.col("fx") * d, (F.col("v") - F.col("cy")) / F.col("fy") * d, d)
    x, y, z = apply_matrix(F.col("pose"), local)
    points = px.join(cam, FK).select(*FK, "u", "v", "d", x.alias("x"), y.alias("y"), z.alias("z"))
    if colors is not None:
        points = points.join(colors.select(*FK, "u", "v", "r", "g", "b"), FK + ["u", "v"], "left")
    return points


def transform_points(points: DataFrame, transforms: DataFrame, on=tuple(FK)) -> DataFrame:
    """Apply the 4x4 ``matrix`` of each key to its points."""
    x, y, z = apply_matrix(F.col("matrix"), (F.col("x"), F.col("y"), F.col("z")))
    keep = [c for c in points.columns if c not in ("x", "y", "z")]
    return points.join(transforms.select(*on, "matrix"), list(on)).select(
        *keep, x.alias("x"), y.alias("y"), z.alias("z")
    )


def project_world(points: DataFrame, camera: DataFrame) -> DataFrame:
    """World points to (px_u, px_v, z_cam); nothing is filtered."""
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", "img_w", "img_h", rigid_inverse(F.col("pose")).alias("w2c"))
    local = apply_matrix(F.col("w2c"), (F.col("x"), F.col("y"), F.col("z")))
    u, v, z = project_camera_point(local, *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    return points.join(cam, FK).select(
        *points.columns, "img_w", "img_h", u.alias("px_u"), v.alias("px_v"), z.alias("z_cam")
    )


def crop_by_mask(depth_px: DataFrame, mask_px: DataFrame, camera: DataFrame, min_depth: float, max_depth: float) -> DataFrame:
    """Points of the pixels inside a 2-D mask and a depth range.

    The join carries the mask's own key columns (for example an object id).
    """
    ranged = depth_px.filter((F.col("d") >= min_depth) & (F.col("d") <= max_depth))
    extra = [c for c in mask_px.columns if c not in FK + ["u", "v"]]
    if not extra:
        return depth_to_points(ranged.join(mask_px.select(*FK, "u", "v").distinct(), FK + ["u", "v"], "left_semi"), camera)
    points = depth_to_points(ranged, camera)
    return points.join(mask_px, FK + ["u", "v"])


def voxel_downsample(points: DataFrame, key: list[str], voxel_size: float) -> DataFrame:
    """Mean point per voxel; partial sums keep hot voxels small before the shuffle."""
    zero = F.lit(0.0)
    cells = [voxel_index(F.col(a), zero, voxel_size).alias(n) for a, n in zip("xyz", "ijk")]
    return (
        points.select(*key, *cells, "x", "y", "z")
        .groupBy(*key, "i", "j", "k")
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count(F.lit(1)).alias("n_points"))
    )


def normalize_cloud(points: DataFrame, key: list[str]) -> DataFrame:
    """Centre on the mean and scale into the unit sphere.

    Two small aggregates per cloud are joined back, so a large cloud is never
    gathered in one task the way a window over it would.
    """
    mean = points.groupBy(*key).agg(*[F.avg(a).alias("m" + a) for a in "xyz"])
    centred = points.join(mean, key).select(
        *[c for c in points.columns if c not in "xyz"],
        *[(F.col(a) - F.col("m" + a)).alias(a) for a in "xyz"],
    )
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    radius = centred.groupBy(*key).agg(F.max(length).alias("radius"))
    scale = F.when(F.col("radius") > 0, F.col("radius")).otherwise(F.lit(1.0))
    return centred.join(radius, key).select(
        *[c for c in points.columns if c not in "xyz"], *[(F.col(a) / scale).alias(a) for a in "xyz"]
    )


def fit_bbox_aabb(points: DataFrame, key: list[str], min_points: int = 50) -> DataFrame:
    """Axis-aligned box per cloud; clouds with too few points give no row."""
    agg = points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("num_points"),
        *[F.min(a).alias("lo_" + a) for a in "xyz"],
        *[F.max(a).alias("hi_" + a) for a in "xyz"],
    )
    return agg.filter(F.col("num_points") >= min_points).select(
        *key,
        *[((F.col("lo_" + a) + F.col("hi_" + a)) / 2).alias("c" + a) for a in "xyz"],
        *[(F.col("hi_" + a) - F.col("lo_" + a)).alias(n) for a, n in zip("xyz", "lwh")],
        F.lit(0.0).alias("yaw"),
        "num_points",
    )


def fit_bbox_pca(points: DataFrame, key: list[str], min_points: int = 50) -> DataFrame:
    """Box turned to the principal horizontal direction of the cloud."""
    stats = (
        points.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("num_points"),
            F.var_pop("x").alias("vxx"),
            F.var_pop("y").alias("vyy"),
            F.covar_pop("x", "y").alias("vxy"),
        )
        .filter(F.col("num_points") >= min_points)
        .select(*key, "num_points", (F.atan2(2 * F.col("vxy"), F.col("vxx") - F.col("vyy")) * 0.5).alias("yaw"))
    )
    c, s = F.cos("yaw"), F.sin("yaw")
    turned = points.join(stats, key).select(
        *key, "num_points", "yaw",
        (c * F.col("x") + s * F.col("y")).alias("a"), (c * F.col("y") - s * F.col("x")).alias("b"), "z",
    )
    box = turned.groupBy(*key, "num_points", "yaw").agg(
        *[F.min(n).alias("lo_" + n) for n in ("a", "b", "z")], *[F.max(n).alias("hi_" + n) for n in ("a", "b", "z")]
    )
    ca, cb = [(F.col("lo_" + n) + F.col("hi_" + n)) / 2 for n in ("a", "b")]
    return box.select(
        *key,
        (c * ca - s * cb).alias("cx"), (s * ca + c * cb).alias("cy"), ((F.col("lo_z") + F.col("hi_z")) / 2).alias("cz"),
        (F.col("hi_a") - F.col("lo_a")).alias("l"), (F.col("hi_b") - F.col("lo_b")).alias("w"), (F.col("hi_z") - F.col("lo_z")).alias("h"),
        "yaw", "num_points",
    )
