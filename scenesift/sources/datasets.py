"""Readers of posed RGB-D datasets. Units are converted here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenesift.functions.geometry import make_matrix, matrix_product, rigid_inverse
from scenesift.operators.points import FK
from scenesift.schema import FRAME_ANNOTATION

# Unit factors into centimetres per source.
HOPE_DEPTH_SCALE, HOUSECAT_DEPTH_SCALE = 0.98042517 / 10.0, 0.1
METRES, MILLIMETRES = 100.0, 0.1


def _path_parts(path: Column, pattern: str):
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def _flat_pose(matrix: Column, factor: float) -> Column:
    """Nested 4x4 to a flat row-major array with its translation scaled."""
    rows = [[matrix[r][c] for c in range(3)] for r in range(3)]
    return make_matrix(rows, tuple(matrix[r][3] * factor for r in range(3)))


def scan_hope_annotations(spark: SparkSession, root: str, sizes: DataFrame | None = None):
    """(camera, objects) from ``scene_*/NNNN.json``, see ``parse_hope_annotations``."""
    scene, frame = _path_parts(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)\.json$")
    texts = spark.read.text(f"{root}/scene_*/*.json", wholetext=True).select(scene.alias("scene_id"), frame.alias("frame_id"), "value")
    return parse_hope_annotations(texts, sizes)


def parse_hope_annotations(texts: DataFrame, sizes: DataFrame | None = None):
    """(camera, objects) from annotation texts (scene_id, frame_id, value).

    Extrinsics are world to camera in metres; object poses are object to camera.
    ``sizes`` (class_name, aabb) fills objects without their own box.
    """
    raw = texts.select(*FK, F.from_json("value", FRAME_ANNOTATION).alias("d")).select(*FK, "d.camera", "d.objects")
    raw = raw.withColumn("w2c", _flat_pose(F.col("camera.extrinsics"), METRES))
    raw = raw.withColumn("pose_c2w", rigid_inverse(F.col("w2c")))
    k = F.col("camera.intrinsics")
    camera = raw.select(
        *FK, k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), F.col("pose_c2w").alias("pose")
    )
    rows = raw.select(*FK, "pose_c2w", F.posexplode("objects").alias("pos", "o"))
    rows = rows.withColumn("pose_cam", _flat_pose(F.col("o.pose"), 1.0))
    objects = rows.select(
        *FK, F.format_string("obj_%d", "pos").alias("obj_id"), F.col("o.class").alias("class_name"), F.col("o.bbox3d").alias("aabb"),
        matrix_product(F.col("pose_c2w"), F.col("pose_cam")).alias("pose"),
    )
    if sizes is not None:
        mesh = sizes.select("class_name", F.col("aabb").alias("mesh_aabb"))
        objects = objects.join(mesh, "class_name", "left").withColumn("aabb", F.coalesce("aabb", "mesh_aabb")).drop("mesh_aabb")
    return camera, objects.select(*FK, "obj_id", "class_name", "aabb", "pose")


def with_image_size(camera: DataFrame, img_w: int, img_h: int) -> DataFrame:
    return camera.withColumns({"img_w": F.lit(img_w), "img_h": F.lit(img_h)})


def mesh_bbox(spark: SparkSession, mesh_glob: str) -> DataFrame:
    """Canonical AABB per class from the vertex lines of ``class.obj`` files, in centimetres."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.obj$", 1)
    return vertex_boxes(spark.read.text(mesh_glob).select(name.alias("class_name"), "value"))


def vertex_boxes(lines: DataFrame) -> DataFrame:
    """AABB per class from mesh lines (class_name, value) in millimetres; other lines than vertices are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("value").startswith("v ")).select(
        "class_name", *[(parts[n + 1].cast("double") * MILLIMETRES).alias(a) for n, a in enumerate("xyz")],
    )
    return rows.groupBy("class_name").agg(
        F.concat(F.array(*[F.min(a) for a in "xyz"]), F.array(*[F.max(a) for a in "xyz"])).alias("aabb")
    )


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), lambda v: v.cast("double"))


def scan_housecat_text(spark: SparkSession, root: str) -> DataFrame:
    """Camera rows from ``scene*/intrinsics.txt`` and ``scene*/camera_pose/*.txt`` (camera to world, metres)."""
    intrinsics = spark.read.text(f"{root}/scene*/intrinsics.txt", wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/intrinsics\.txt$", 1).alias("scene_id"), "value"
    )
    scene, frame = _path_parts(F.col("_metadata.file_path"), r"([^/]+)/camera_pose/([^/]+)\.txt$")
    poses = spark.read.text(f"{root}/scene*/camera_pose/*.txt", wholetext=True).select(
        scene.alias("scene_id"), frame.alias("frame_id"), "value"
    )
    return parse_cameras(intrinsics, poses)


def parse_cameras(intrinsics: DataFrame, poses: DataFrame) -> DataFrame:
    """Camera rows from the texts of 3x3 intrinsics (scene_id, value) and 4x4 poses (scene_id, frame_id, value)."""
    intr = intrinsics.select("scene_id", _numbers(F.col("value")).alias("k"))
    poses = poses.select(*FK, _numbers(F.col("value")).alias("m"))
    pose = F.transform("m", lambda v, i: F.when(i.isin(3, 7, 11), v * METRES).otherwise(v))
    return poses.join(intr, "scene_id").select(
        *FK, *[F.get("k", F.lit(n)).alias(c) for c, n in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5))], pose.alias("pose")
    )


def housecat_objects(labels: DataFrame, camera: DataFrame) -> DataFrame:
    """Objects from parallel label arrays; arrays of different length, or a frame without a camera pose, are an error."""
    n = F.size("model_list")
    sizes = {c: F.size(c) for c in ("rotations", "translations", "gt_scales")}
    wrong = (sizes["rotations"] != n) | (sizes["translations"] != n) | (sizes["gt_scales"] != n)
    message = F.concat(F.lit("incomplete labels for "), "scene_id", F.lit("/"), "frame_id")
    checked = labels.withColumn("model_list", F.when(wrong, F.raise_error(message).cast("array<string>")).otherwise(F.col("model_list")))
    rows = checked.select(*FK, "instance_ids", F.posexplode(F.arrays_zip("model_list", "rotations", "translations", "gt_scales")).alias("pos", "o"))
    r, t, size = F.col("o.rotations"), F.col("o.translations"), F.col("o.gt_scales")
    local = make_matrix([[r[i][j] for j in range(3)] for i in range(3)], tuple(t[i] * METRES for i in range(3)))
    half = [size[i] * METRES * 0.5 for i in range(3)]
    rows = rows.join(camera.select(*FK, F.col("pose").alias("c2w")), FK, "left").withColumn("local", local)
    missing = F.concat(F.lit("no camera pose for "), "scene_id", F.lit("/"), "frame_id")
    rows = rows.withColumn("c2w", F.when(F.col("c2w").isNull(), F.raise_error(missing).cast("array<double>")).otherwise(F.col("c2w")))
    number = F.coalesce(F.get("instance_ids", F.col("pos")), F.col("pos").cast("long"))
    return rows.select(
        *FK, F.format_string("obj_%d", number).alias("obj_id"), F.col("o.model_list").alias("class_name"),
        F.array(*[-h for h in half], *half).alias("aabb"), matrix_product(F.col("c2w"), F.col("local")).alias("pose"),
    )


def scale_depth(depth_px: DataFrame, factor: float) -> DataFrame:
    """Raw depth counts to centimetres."""
    return depth_px.withColumn("d", F.col("d") * factor)


def list_files(spark: SparkSession, glob: str, patterns: dict[str, str]) -> DataFrame:
    """(scene_id, frame_id, kind) of files; a pattern has the scene and the frame as groups.

    Only paths are read, never contents.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path")
    kind = None
    for name, pattern in patterns.items():
        scene, frame = _path_parts(F.col("path"), pattern)
        hit = F.col("path").rlike(pattern)
        value = F.struct(scene.alias("scene_id"), frame.alias("frame_id"), F.lit(name).alias("kind"))
        kind = F.when(hit, value) if kind is None else kind.when(hit, value)
    return paths.select(kind.alias("k")).filter(F.col("k").isNotNull()).select("k.*")


# File layouts of the two datasets.
HOPE_FILES = {"rgb": r"(scene_[^/]*)/([^/]+)_rgb\.jpg$"}
HOUSECAT_FILES = {
    "rgb": r"(scene[^/]*)/rgb/([^/]+)\.png$",
    "depth": r"(scene[^/]*)/depth/([^/]+)\.png$",
    "pose": r"(scene[^/]*)/camera_pose/([^/]+)\.txt$",
    "label": r"(scene[^/]*)/labels/([^/]+)_label\.pkl$",
}


def list_dataset_frames(spark: SparkSession, root: str, kind: str, frame_step: int) -> DataFrame:
    """Usable frames of a dataset folder; HouseCat scenes also need their intrinsics file."""
    from scenesift.operators.batch_state import list_frames

    patterns = {"hope": HOPE_FILES, "housecat6d": HOUSECAT_FILES}[kind]
    frames = list_frames(list_files(spark, root, patterns), list(patterns), frame_step)
    if kind == "housecat6d":
        with_k = list_files(spark, root, {"intrinsics": r"(scene[^/]*)/(intrinsics)\.txt$"}).select("scene_id")
        frames = frames.join(with_k, "scene_id", "left_semi")
    return frames


def housecat_reader(spark, cfg):
    camera = with_image_size(scan_housecat_text(spark, cfg["root"]), cfg["img_w"], cfg["img_h"])
    labels = spark.read.parquet(cfg["labels"])
    return {"camera": camera, "objects": housecat_objects(labels, camera), "depth_px": scale_depth(spark.read.parquet(cfg["depth"]), HOUSECAT_DEPTH_SCALE)}


def hope_reader(spark, cfg):
    sizes = mesh_bbox(spark, cfg["meshes"]) if cfg.get("meshes") else None
    camera, objects = scan_hope_annotations(spark, cfg["root"], sizes)
    return {"camera": with_image_size(camera, cfg["img_w"], cfg["img_h"]), "objects": objects, "depth_px": scale_depth(spark.read.parquet(cfg["depth"]), HOPE_DEPTH_SCALE)}


# Reader per dataset type: (spark, cfg) -> {camera, objects, depth_px}. Own readers register here.
READERS = {"hope": hope_reader, "housecat6d": housecat_reader}


def read_dataset(spark: SparkSession, kind: str, cfg: dict) -> dict[str, DataFrame]:
    if kind not in READERS:
        raise ValueError(f"unknown dataset type: {kind}")
    return READERS[kind](spark, cfg)
