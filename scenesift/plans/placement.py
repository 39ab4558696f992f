"""The whole placement plan for a batch of frames as one Spark job chain."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenesift.config import PlacementConfig
from scenesift.functions.geometry import world_aabb
from scenesift.functions.names import sample_id
from scenesift.operators.cluster import (
    adaptive_eps,
    cluster_infos,
    cluster_representative,
    dbscan,
    fixed_eps,
    rank_clusters,
)
from scenesift.operators.morphology import dilate_xy, obstacle_columns
from scenesift.operators.occupancy import (
    OBJ,
    depth_layers,
    grid_bounds,
    mark_objects,
    object_visible,
    occupancy_columns,
    voxelize_obb,
)
from scenesift.operators.placement import (
    ROW,
    anchor_transforms,
    camera_views,
    eroded_surface,
    search_region,
    search_rows,
    stable_rows,
    unoccluded_rows,
    visible_rows,
    yaw_poses,
    yaw_shapes,
    yaw_voxels,
)
from scenesift.operators.points import FK, depth_to_points
from scenesift.operators.surface import support_surface
from scenesift.session import cut_lineage


@dataclass
class PlacementTables:
    """Results of a plan; every field is a DataFrame keyed by frame."""

    points: DataFrame
    grid: DataFrame
    columns: DataFrame
    placements: DataFrame
    funnel: DataFrame
    clusters: DataFrame


def _word_count(words: DataFrame, name: str) -> DataFrame:
    return words.groupBy(*OBJ).agg(F.sum(F.bit_count("bits")).alias(name))


def stage_funnel(objects: DataFrame, has_voxels: DataFrame, visible: DataFrame, surface: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """Stage counters per object with the reason an object was skipped."""
    rows = objects.select(*OBJ, "class_name")
    rows = rows.join(has_voxels.select(*OBJ).distinct().withColumn("_voxels", F.lit(True)), OBJ, "left")
    rows = rows.join(visible.filter("visible").select(*OBJ).withColumn("_visible", F.lit(True)), OBJ, "left")
    rows = rows.join(surface.select(*OBJ).distinct().withColumn("_surface", F.lit(True)), OBJ, "left")
    for count in counts:
        rows = rows.join(count, OBJ, "left")
    reason = (
        F.when(F.col("_voxels").isNull(), "no voxels")
        .when(F.col("_visible").isNull(), "not fully visible")
        .when(F.col("_surface").isNull(), "no support surface")
    )
    names = ("num_raw_candidates", "num_after_stability", "num_after_visibility", "num_after_occlusion")
    zero = F.lit(0).cast("long")
    return rows.select(*OBJ, "class_name", reason.alias("skip_reason"), *[F.coalesce(F.col(n), zero).alias(n) for n in names])


def plan_placements(depth_px: DataFrame, camera: DataFrame, objects: DataFrame, cfg: PlacementConfig, surface=None) -> PlacementTables:
    """Plan every object of every frame.

    ``surface`` replaces the surface step: a function
    ``(points, columns, grid, objects, object_voxels) -> cells(object, table_z, i, j)``.

    Lineage is cut where a result feeds several branches: the points (so depth is read once), the packed grid, the
    object voxels, poses, the surface cells, the packed search rows and the surviving candidates.
    """
    objects = cut_lineage(objects)
    points = cut_lineage(depth_to_points(depth_px, camera, cfg.pixel_stride))
    grid = cut_lineage(grid_bounds(points, camera, cfg.voxel_size, cfg.grid_padding))
    seen = occupancy_columns(points, camera, grid)
    own = cut_lineage(voxelize_obb(objects, grid))
    base = cut_lineage(mark_objects(seen, own))

    with_voxels = objects.join(own.select(*OBJ).distinct(), OBJ, "left_semi")
    layers = cut_lineage(depth_layers(base, grid, camera, own))
    visible = cut_lineage(object_visible(with_voxels, camera, layers, cfg.voxel_size))
    active = cut_lineage(with_voxels.join(visible.filter("visible").select(*OBJ), OBJ, "left_semi"))
    active_own = own.join(active.select(*OBJ), OBJ, "left_semi")

    if surface is None:
        _, cells = support_surface(points, base, grid, active, active_own, cfg)
    else:
        cells = surface(points, base, grid, active, active_own)
    cells = cut_lineage(cells)

    region = search_region(cells, grid)
    poses = cut_lineage(yaw_poses(active, cfg.yaw_steps, cfg.preserve_orientation, cfg.orientation_threshold_deg))
    voxels = cut_lineage(yaw_voxels(poses, grid))
    shapes = cut_lineage(yaw_shapes(voxels))
    eroded = eroded_surface(cells, grid)
    steps = max(0, math.ceil(cfg.safety_margin / cfg.voxel_size))
    obstacles = dilate_xy(obstacle_columns(base, grid), grid, steps)

    views = cut_lineage(camera_views(poses, shapes, region, grid, camera))

    full_support = cfg.min_support_ratio == 1.0
    rows = search_rows(voxels, shapes, region, obstacles, eroded if full_support else None)
    rows = cut_lineage(rows)
    raw_count = rows.groupBy(*OBJ).agg(F.sum(F.bit_count("raw")).alias("num_raw_candidates"))
    if full_support:
        stable_count = rows.groupBy(*OBJ).agg(F.sum(F.bit_count("stable")).alias("num_after_stability"))
        stable, stable_bits = rows, "stable"
    else:
        stable, stable_bits = cut_lineage(stable_rows(rows, voxels, shapes, eroded, cfg.min_support_ratio, "raw")), "bits"
        stable_count = _word_count(stable, "num_after_stability")
    in_image = cut_lineage(visible_rows(stable, views, stable_bits).select(*ROW, F.col("visible").alias("bits")).filter(F.col("bits") != 0))
    kept = unoccluded_rows(in_image, views, layers, cfg.occlusion_threshold, "bits")
    kept = cut_lineage(kept.select(*ROW, F.col("kept").alias("bits")).filter(F.col("bits") != 0))

    if cfg.dbscan_eps is None:
        radius = adaptive_eps(active, shapes, grid)
    else:
        radius = fixed_eps(active, grid, cfg.dbscan_eps)
    clustered = dbscan(kept, radius, cfg.dbscan_min_samples)
    ranked = rank_clusters(cluster_representative(clustered))
    clusters = cluster_infos(ranked, region, grid, radius, cfg.yaw_steps, cfg.dbscan_min_samples)
    placed = anchor_transforms(clusters, poses, shapes, grid)
    placements = placed.join(
        objects.select(*OBJ, "class_name", F.col("pose").alias("original_pose_world"), F.col("aabb").alias("canonical_aabb_object")), OBJ
    ).select(
        sample_id(F.col("scene_id"), F.col("frame_id"), F.col("obj_id"), F.col("rank")).alias("sample_id"),
        *FK, F.lit(cfg.unit).alias("unit"), F.col("obj_id").alias("object_id"), "class_name", "rank", "canonical_aabb_object",
        "original_pose_world", world_aabb(F.col("canonical_aabb_object"), F.col("original_pose_world")).alias("original_aabb_world"),
        "center_world", "yaw_degrees", "transform_world", "aabb_world",
        F.floor("centroid_distance").cast("int").alias("free_space_score"),
    )
    funnel = stage_funnel(
        objects, own, visible, cells,
        [raw_count, stable_count, _word_count(in_image, "num_after_visibility"), _word_count(kept, "num_after_occlusion")],
    )
    return PlacementTables(points, grid, base, placements, funnel, clusters)


def placed_summary(funnel_objects: DataFrame, placements: DataFrame) -> DataFrame:
    """Objects with at least one placement against all objects, per frame."""
    have = placements.select(*FK, F.col("object_id").alias("obj_id")).distinct().withColumn("_has", F.lit(True))
    return funnel_objects.select(*OBJ).join(have, OBJ, "left").groupBy(*FK).agg(
        F.count("_has").alias("objects_placed"), F.count(F.lit(1)).alias("objects_total")
    )


def displacement_stats(placements: DataFrame) -> DataFrame:
    """Per object: distances from the original to the placed centres, and the union AABB."""
    box = F.col("original_aabb_world")
    # The mean of the posed corners is the posed AABB centre of the box.
    start = [(box[a] + box[a + 3]) / 2 for a in range(3)]
    delta = [F.col("center_world")[a] - start[a] for a in range(3)]
    far = F.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2])
    low = [F.min(F.col("aabb_world")[a]).alias("lo_" + n) for a, n in enumerate("xyz")]
    high = [F.max(F.col("aabb_world")[a + 3]).alias("hi_" + n) for a, n in enumerate("xyz")]
    return placements.groupBy(*FK, "object_id").agg(
        F.count(F.lit(1)).alias("n_placements"), F.min(far).alias("min_distance"), F.max(far).alias("max_distance"),
        F.avg(far).alias("avg_distance"), *low, *high,
    )
