"""Reading emitted sample and placement documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenesift.functions.names import category_normalize, infer_frame_id, infer_scene_id, object_or_default
from scenesift.schema import PLACEMENTS_FILE, SUMMARY_FILE


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def sample_folders(spark: SparkSession, roots: list[str], strict: bool = False) -> list[str]:
    """Sample folders of several roots; missing ones are skipped, or an error when ``strict``."""
    found = []
    for root in roots:
        folder = root if os.path.basename(root.rstrip("/")) == "samples" else root.rstrip("/") + "/samples"
        if _exists(spark, folder):
            found.append(folder)
        elif strict:
            raise FileNotFoundError(folder)
    return found


#: Fields of a sample that are read, with the type each one is tried as.
SAMPLE_FIELDS = {
    "sample_id": "string", "scene_id": "string", "frame_id": "string", "unit": "string", "object_id": "string", "class_name": "string", "rank": "int",
    "canonical_aabb_object": "array<double>", "original_pose_world": "array<array<double>>", "original_aabb_world": "array<double>", "center_world": "array<double>",
    "yaw_degrees": "double", "transform_world": "array<array<double>>", "aabb_world": "array<double>", "free_space_score": "int",
}
DOCUMENT_FIELDS = ("schema_version", "scene_id", "frame_id", "unit")


def parse_documents(texts: DataFrame) -> DataFrame:
    """Documents from ``texts`` (value and any key columns): only text that is no JSON object is left out.

    Every field is tried on its own: one that is missing, null or of another type is null, and the document, the
    sample and its other fields stay.
    """
    read = texts.withColumn("_doc", F.try_parse_json("value")).filter(_is_object("_doc"))
    field = lambda e, name, kind: F.try_variant_get(e, f"$.{name}", kind)
    sample = lambda e: F.struct(*[field(e, n, k).alias(n) for n, k in SAMPLE_FIELDS.items()])
    kept = [c for c in texts.columns if c != "value"]
    return read.select(
        *[field(F.col("_doc"), n, "string").alias(n) for n in DOCUMENT_FIELDS],
        F.transform(F.try_variant_get("_doc", "$.samples", "array<variant>"), sample).alias("samples"), *kept,
    )


def _is_object(column: str):
    return F.coalesce(F.schema_of_variant(column).startswith("OBJECT"), F.lit(False))


def scan_samples(spark: SparkSession, roots: list[str], strict: bool = False, lines: bool = False) -> DataFrame:
    """One row per parsable samples document; others are left out (see ``skipped_documents``).

    ``lines``: files hold one document per line, as the sinks here write them; such files
    can be split. Otherwise a file is one document.
    """
    return parse_documents(sample_texts(spark, roots, strict, lines))


def corrupt_samples(spark: SparkSession, roots: list[str], lines: bool = False) -> DataFrame:
    """Paths of documents that do not parse."""
    read = sample_texts(spark, roots, False, lines).withColumn("_doc", F.try_parse_json("value"))
    return read.filter(~_is_object("_doc")).select("path", "source_dir")


def skipped_documents(texts: DataFrame) -> DataFrame:
    """(source_dir, n_documents, n_skipped): how many texts of each root are read and left out."""
    read = texts.withColumn("_doc", F.try_parse_json("value"))
    return read.groupBy("source_dir").agg(F.count_if(_is_object("_doc")).alias("n_documents"), F.count_if(~_is_object("_doc")).alias("n_skipped"))


def sample_texts(spark: SparkSession, roots: list[str], strict: bool = False, lines: bool = False) -> DataFrame:
    """(value, path, source_dir, stem): the text of every document."""
    folders = sample_folders(spark, roots, strict)
    if not folders:
        return spark.createDataFrame([], "value string, path string, source_dir string, stem string")
    path = F.col("_metadata.file_path")
    return spark.read.option("wholetext", not lines).option("pathGlobFilter", "*.json").text(folders).select(
        "value", path.alias("path"), F.regexp_extract(path, r"([^/]+)/samples/[^/]+$", 1).alias("source_dir"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("stem")
    )


def infer_frame_keys(documents: DataFrame) -> DataFrame:
    """Scene and frame ids from the document, else from the file stem."""
    return documents.withColumns(
        {"scene_id": infer_scene_id(F.col("scene_id"), F.col("stem")), "frame_id": infer_frame_id(F.col("frame_id"), F.col("stem"))}
    )


def flatten_samples(documents: DataFrame) -> DataFrame:
    """One row per sample record with its document and position."""
    return documents.select("path", "source_dir", F.posexplode("samples").alias("pos", "s")).select("path", "source_dir", "pos", "s.*")


def sample_rows(documents: DataFrame) -> DataFrame:
    """Rows for the statistics: document keys, category and object with their defaults."""
    rows = documents.select("path", "source_dir", "scene_id", "frame_id", F.posexplode("samples").alias("pos", "s"))
    return rows.select(
        "path", "source_dir", "pos", "scene_id", "frame_id", object_or_default(F.col("s.object_id")).alias("object_id"),
        category_normalize(F.col("s.class_name")).alias("category"),
    )


def file_counts(documents: DataFrame) -> DataFrame:
    """(path, source_dir, scene_id, n_samples) per document."""
    return documents.select("path", "source_dir", "scene_id", F.greatest(F.size("samples"), F.lit(0)).alias("n_samples"))


def placement_rows(documents: DataFrame) -> DataFrame:
    """One row per placement of placement documents, with the fields of its object."""
    objects = documents.select("scene_id", "frame_id", F.posexplode("objects").alias("object_pos", "o"))
    return objects.select("scene_id", "frame_id", "object_pos", "o.object_id", "o.class_name", F.explode("o.placements").alias("p")).select(
        "scene_id", "frame_id", "object_pos", "object_id", "class_name", "p.*"
    )


def load_placements_back(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Placement documents of the current layout or of the older {config, objects} one."""
    return spark.read.schema(PLACEMENTS_FILE).option("multiLine", not lines).json(glob)


def load_summary(spark: SparkSession, path: str) -> DataFrame:
    """Category rows of a summary document."""
    return spark.read.schema(SUMMARY_FILE).option("multiLine", True).json(path).select(F.inline("category_stats"))
