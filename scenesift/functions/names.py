"""Identifier and category text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters allowed in a sanitised identifier, its fallback, and the id formats.
UNSAFE_CHARS = "[^A-Za-z0-9._-]+"
EMPTY_NAME = "item"
SAMPLE_ID_FORMAT = "%s_%s_p%03d"
UNKNOWN_CATEGORY = "unknown"
UNKNOWN_OBJECT = "unknown_object"

# The six outputs whose presence makes a frame complete (slot, folder, suffix).
CORE_OUTPUTS = (
    (0, "placements", ".json"),
    (1, "samples", ".json"),
    (2, "point_clouds", ".ply"),
    (3, "occupancy_grids", ".npy"),
    (4, "occupancy_grids", ".ply"),
    (5, "grid_meta", ".json"),
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def name_clean(text: Column) -> Column:
    joined = F.regexp_replace(text.cast("string"), UNSAFE_CHARS, "_")
    stripped = F.regexp_replace(joined, r"^[._]+|[._]+$", "")
    return F.when(stripped == "", F.lit(EMPTY_NAME)).otherwise(stripped)


def frame_prefix(scene_id: Column, frame_id: Column) -> Column:
    return F.concat(name_clean(scene_id), F.lit("_"), name_clean(frame_id))


def sample_id(scene_id: Column, frame_id: Column, object_id: Column, rank: Column) -> Column:
    return F.format_string(SAMPLE_ID_FORMAT, frame_prefix(scene_id, frame_id), object_id, rank)


def output_keys(scene_id: Column, frame_id: Column) -> Column:
    """Array of structs (slot, kind, path) of the outputs of a frame."""
    prefix = frame_prefix(scene_id, frame_id)
    return F.array(
        *[
            F.struct(
                F.lit(slot).alias("slot"),
                F.lit(folder + "_" + suffix[1:]).alias("kind"),
                F.concat(F.lit(folder + "/"), prefix, F.lit(suffix)).alias("path"),
            )
            for slot, folder, suffix in CORE_OUTPUTS
        ]
    )


def overlay_name(source_dir: Column, sample: Column) -> Column:
    return F.concat(source_dir, F.lit("__"), sample, F.lit(".png"))


def category_normalize(name: Column) -> Column:
    return strip(F.coalesce(name, F.lit(UNKNOWN_CATEGORY)))


def object_or_default(object_id: Column) -> Column:
    return F.coalesce(object_id, F.lit(UNKNOWN_OBJECT))


def infer_scene_id(scene_id: Column, stem: Column) -> Column:
    """Given id unless empty, else ``scene_X`` of the file stem, else the stem."""
    parts = F.split(stem, "_")
    from_stem = F.when((F.size(parts) >= 2) & (parts[0] == "scene"), F.concat_ws("_", parts[0], parts[1])).otherwise(stem)
    return F.coalesce(F.when(scene_id != "", scene_id), from_stem)


def infer_frame_id(frame_id: Column, stem: Column) -> Column:
    """Given id (an empty one counts), else the last stem part, else the stem."""
    parts = F.split(stem, "_")
    from_stem = F.when((F.size(parts) >= 3) & (parts[0] == "scene"), F.element_at(parts, -1)).otherwise(stem)
    return F.coalesce(frame_id, from_stem)


def split_last(text: Column):
    """(head, tail) at the last underscore; no underscore gives (text, '')."""
    parts = F.split(text, "_")
    tail = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    head = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")).otherwise(text)
    return F.when(head == "", text).otherwise(head), tail
