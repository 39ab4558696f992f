"""Projected wireframes of samples: what an overlay image would draw, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenesift.functions.geometry import apply_matrix, contact_face, corner, edge_structs, project_camera_point, rigid_inverse
from scenesift.operators.points import FK


def bbox_corners(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Eight world corners per posed box, as rows."""
    rows = boxes.select(*key, "aabb", "pose", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner"))
    x, y, z = apply_matrix(F.col("pose"), corner(F.col("aabb"), F.col("corner")))
    return rows.select(*key, "corner", x.alias("x"), y.alias("y"), z.alias("z"))


def bbox_edges_2d(boxes: DataFrame, camera: DataFrame, key: list[str]) -> DataFrame:
    """Projected edges per posed box; an edge with an end behind the camera is left out."""
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", rigid_inverse(F.col("pose")).alias("w2c"))
    rows = boxes.select(*key, "aabb", "pose", F.explode(edge_structs()).alias("e")).join(cam, FK)
    for end, name in (("a", "0"), ("b", "1")):
        world = apply_matrix(F.col("pose"), corner(F.col("aabb"), F.col("e")[end]))
        rows = rows.withColumns({f"w{a}{name}": p for a, p in zip("xyz", world)})
        local = apply_matrix(F.col("w2c"), tuple(F.col(f"w{a}{name}") for a in "xyz"))
        rows = rows.withColumns({f"c{a}{name}": p for a, p in zip("xyz", local)})
        u, v, _ = project_camera_point(tuple(F.col(f"c{a}{name}") for a in "xyz"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
        rows = rows.withColumns({"u" + name: u, "v" + name: v})
    return rows.filter((F.col("cz0") > 0) & (F.col("cz1") > 0)).select(*key, F.col("e.edge").alias("edge"), "u0", "v0", "u1", "v1")


def sample_overlay(samples: DataFrame, camera: DataFrame) -> DataFrame:
    """Edges of the original and the placed box of every sample."""
    kinds = F.array(
        F.struct(F.lit("original").alias("kind"), F.col("original_pose_world").alias("pose")),
        F.struct(F.lit("placement").alias("kind"), F.col("transform_world").alias("pose")),
    )
    boxes = samples.select("sample_id", *FK, F.col("canonical_aabb_object").alias("aabb"), F.explode(kinds).alias("k"))
    boxes = boxes.select("sample_id", *FK, "aabb", "k.kind", "k.pose")
    return bbox_edges_2d(boxes, camera, ["sample_id", *FK, "kind"])


def contact_faces(objects: DataFrame, camera: DataFrame, key: list[str]) -> DataFrame:
    """Projected corners of the face each object rests on, in drawing order."""
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", rigid_inverse(F.col("pose")).alias("w2c"))
    rows = objects.select(*key, "aabb", "pose", F.posexplode(contact_face(F.col("pose"))).alias("pos", "corner")).join(cam, FK)
    world = apply_matrix(F.col("pose"), corner(F.col("aabb"), F.col("corner")))
    rows = rows.withColumns({"w" + a: p for a, p in zip("xyz", world)})
    local = apply_matrix(F.col("w2c"), tuple(F.col("w" + a) for a in "xyz"))
    u, v, z = project_camera_point(local, *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    return rows.select(*key, "pos", "corner", u.alias("u"), v.alias("v"), z.alias("z"))
