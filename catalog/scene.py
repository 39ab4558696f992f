"""Shared inputs of the planning queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import load
from scenesift.config import PlacementConfig
from scenesift.functions.geometry import euler_to_matrix, translate
from scenesift.operators import occupancy as occ
from scenesift.operators import placement as plc
from scenesift.operators.points import FK, depth_to_points
from scenesift.session import cut_lineage

CONFIG = PlacementConfig(voxel_size=5.0, pixel_stride=1, grid_padding=10.0, safety_margin=2.0, yaw_steps=24)


def posed_objects(boxes: DataFrame) -> DataFrame:
    """Box rows (sx, sy, sz, px, py, roll_deg, yaw_deg) to objects with aabb and pose."""
    half = {n: F.col("s" + n) / 2 for n in "xyz"}
    height = F.when(F.col("roll_deg") == 0, half["z"]).otherwise(half["y"])
    turn = euler_to_matrix(F.radians("roll_deg"), F.lit(0.0), F.radians("yaw_deg"))
    return boxes.select(
        *FK, "obj_id", "class_name",
        F.array(*[-half[n] for n in "xyz"], *[half[n] for n in "xyz"]).alias("aabb"),
        translate(turn, (F.col("px"), F.col("py"), height)).alias("pose"),
    )


class Scene:
    """Lazily built DataFrames of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: PlacementConfig = CONFIG):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg

    @cached_property
    def depth(self):
        return load(self.spark, self.sf_dir, "fx_depth_px")

    @cached_property
    def camera(self):
        """One row for each frame, found by reading a whole table: written once, as every step asks for it."""
        return cut_lineage(load(self.spark, self.sf_dir, "fx_camera"))

    @cached_property
    def objects(self):
        return posed_objects(load(self.spark, self.sf_dir, "fx_boxes_posed"))

    @cached_property
    def points(self):
        """Written once: bounds, rays and surfaces all start from it."""
        return cut_lineage(depth_to_points(self.depth, self.camera, self.cfg.pixel_stride))

    @cached_property
    def grid(self):
        """One row for each frame, read by every later step."""
        return cut_lineage(occ.grid_bounds(self.points, self.camera, self.cfg.voxel_size, self.cfg.grid_padding))

    @cached_property
    def columns(self):
        return occ.occupancy_columns(self.points, self.camera, self.grid)

    @cached_property
    def own(self):
        return occ.voxelize_obb(self.objects, self.grid)

    @cached_property
    def base(self):
        return occ.mark_objects(self.columns, self.own)

    @cached_property
    def others(self):
        return occ.remove_target(self.base, self.objects, self.own)

    @cached_property
    def layers(self):
        return occ.depth_layers(self.base, self.grid, self.camera, self.own)

    @cached_property
    def poses(self):
        return plc.yaw_poses(self.objects, self.cfg.yaw_steps, self.cfg.preserve_orientation, self.cfg.orientation_threshold_deg)

    @cached_property
    def voxels(self):
        return plc.yaw_voxels(self.poses, self.grid)

    @cached_property
    def shapes(self):
        return plc.yaw_shapes(self.voxels)
