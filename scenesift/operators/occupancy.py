"""Occupancy of all frames at once.

The grid is kept as packed columns: one row per (frame, i, j, word) with the FREE
layers and the OCCUPIED layers as bits. UNKNOWN is implicit, a layer with neither bit.
Rows are keyed down to the column, so one large frame spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenesift.functions.bits import bit_in_word, explode_bits, long_lit, range_bits, word_of
from scenesift.functions.geometry import (
    apply_matrix,
    at,
    cell,
    corner,
    pixel_index,
    project_camera_point,
    rigid_inverse,
    matrix_product,
    voxel_center,
    voxel_index,
    world_aabb,
)
from scenesift.operators.points import FK, depth_to_points
from scenesift.operators.rays import ray_intervals
from scenesift.session import spread

# Voxel states and their export colours.
FREE, OCCUPIED, UNKNOWN = 0, 1, 2
STATE_COLORS = {FREE: (76, 175, 80), OCCUPIED: (244, 67, 54), UNKNOWN: (158, 158, 158)}

OBJ = FK + ["obj_id"]


def grid_bounds(points: DataFrame, camera: DataFrame, voxel_size: float, padding: float) -> DataFrame:
    """Origin and shape per frame from the points and the camera position."""
    eye = camera.select(*FK, *[cell(F.col("pose"), r, 3).alias(a) for r, a in enumerate("xyz")])
    reach = (
        points.select(*FK, "x", "y", "z")
        .unionByName(eye)
        .groupBy(*FK)
        .agg(*[F.min(a).alias("lo" + a) for a in "xyz"], *[F.max(a).alias("hi" + a) for a in "xyz"])
    )
    lows = {a: F.col("lo" + a) - padding for a in "xyz"}
    return reach.select(
        *FK,
        *[lows[a].alias("o" + a) for a in "xyz"],
        F.lit(float(voxel_size)).alias("voxel_size"),
        *[F.ceil((F.col("hi" + a) + padding - lows[a]) / voxel_size).cast("int").alias("g" + a) for a in "xyz"],
    )


def _in_grid(i="i", j="j", k="k"):
    return (
        (F.col(i) >= 0) & (F.col(i) < F.col("gx"))
        & (F.col(j) >= 0) & (F.col(j) < F.col("gy"))
        & (F.col(k) >= 0) & (F.col(k) < F.col("gz"))
    )


def world_to_voxel(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds integer voxel indices (outside indices are kept)."""
    indices = [voxel_index(F.col(a), F.col("o" + a), F.col("voxel_size")).alias(n) for a, n in zip("xyz", "ijk")]
    return points.join(grid, FK).select(*points.columns, *indices)


def voxel_to_world(voxels: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds the world centre of each voxel."""
    centres = [voxel_center(F.col(n), F.col("o" + a), F.col("voxel_size")).alias(a) for a, n in zip("xyz", "ijk")]
    return voxels.join(grid, FK).select(*voxels.columns, *centres)


def _pack(voxels: DataFrame, key: list[str], name: str) -> DataFrame:
    """Pack voxel rows into column words."""
    return voxels.groupBy(*key, "i", "j", word_of(F.col("k")).alias("w")).agg(F.bit_or(bit_in_word(F.col("k"))).alias(name))


def _interval_words(intervals: DataFrame) -> DataFrame:
    """Layer intervals to unmerged words (frame, i, j, w, bits); no bit is set outside the grid."""
    low, high = F.least("z0", "z1"), F.greatest("z0", "z1")
    words = intervals.withColumn("w", F.explode(F.sequence(word_of(F.greatest(low, F.lit(0))), word_of(F.greatest(high, F.lit(0))))))
    bits = range_bits(F.col("w"), F.greatest(low, F.lit(0)), F.least(high, F.col("gz") - 1))
    inside = (F.col("i") >= 0) & (F.col("i") < F.col("gx")) & (F.col("j") >= 0) & (F.col("j") < F.col("gy"))
    return words.select(*FK, "i", "j", "w", F.when(inside, bits).otherwise(long_lit(0)).alias("bits"))


def _surface_indices(points: DataFrame, grid: DataFrame) -> DataFrame:
    """In-grid voxel of every point; frames are spread as for the rays, so that both read one shuffle."""
    located = spread(points.select(*FK, "x", "y", "z"), FK).join(grid, FK)
    index = [voxel_index(F.col(a), F.col("o" + a), F.col("voxel_size")).alias(n) for a, n in zip("xyz", "ijk")]
    return located.select(*FK, *index, "gx", "gy", "gz").filter(_in_grid()).select(*FK, "i", "j", "k")


def occupancy_columns(points: DataFrame, camera: DataFrame, grid: DataFrame) -> DataFrame:
    """Packed grid: rays and hits in one aggregation, OCCUPIED overrides FREE."""
    none = long_lit(0)
    free = _interval_words(ray_intervals(points, camera, grid)).select(*FK, "i", "j", "w", F.col("bits").alias("free"), none.alias("occ"))
    hits = _surface_indices(points, grid).select(*FK, "i", "j", word_of(F.col("k")).alias("w"), none.alias("free"), bit_in_word(F.col("k")).alias("occ"))
    packed = free.unionByName(hits).groupBy(*FK, "i", "j", "w").agg(F.bit_or("free").alias("free"), F.bit_or("occ").alias("occ"))
    packed = packed.filter((F.col("free") != 0) | (F.col("occ") != 0))
    return packed.withColumn("free", F.col("free").bitwiseAND(F.bitwise_not("occ")))


def _unpack_states(columns: DataFrame) -> DataFrame:
    """Known voxels with their state, in one pass over the columns; OCCUPIED overrides FREE."""
    known = columns.select(*FK, "i", "j", "w", "occ", F.col("free").bitwiseOR(F.col("occ")).alias("bits"))
    voxels = explode_bits(known, "bits", "w", "k")
    occupied = F.col("occ").bitwiseAND(bit_in_word(F.col("k"))) != 0
    return voxels.select(*FK, "i", "j", "k", F.when(occupied, OCCUPIED).otherwise(FREE).alias("state"))


def occupancy_grid(columns: DataFrame) -> DataFrame:
    """Packed columns to voxel rows (state FREE or OCCUPIED)."""
    return _unpack_states(columns)


def occupied_voxels(columns: DataFrame) -> DataFrame:
    rows = columns.filter(F.col("occ") != 0).select(*FK, "i", "j", "w", "occ")
    return explode_bits(rows, "occ", "w", "k")


def raycast_free(points: DataFrame, camera: DataFrame, grid: DataFrame) -> DataFrame:
    """Voxels passed by a ray, hits not yet removed."""
    words = _interval_words(ray_intervals(points, camera, grid)).groupBy(*FK, "i", "j", "w").agg(F.bit_or("bits").alias("free"))
    return explode_bits(words, "free", "w", "k")


def surface_voxels(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Voxels that hold a depth measurement."""
    return _surface_indices(points, grid).distinct()


def voxelize_boxes(boxes: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Voxels whose centre lies inside a posed AABB (inclusive), clipped to the grid.

    ``boxes`` has ``aabb``, ``pose`` and the key columns; the candidate range comes
    from the world AABB of each box, so there is no join beyond the frame's grid row.
    """
    wide = boxes.select(*key, "aabb", "pose").join(grid, FK)
    wide = wide.withColumn("wa", world_aabb(F.col("aabb"), F.col("pose")))
    for n, (axis, name) in enumerate(zip("xyz", "ijk")):
        vs, origin = F.col("voxel_size"), F.col("o" + axis)
        low = F.greatest(F.floor((at(F.col("wa"), n) - vs - origin) / vs).cast("int"), F.lit(0))
        high = F.least(F.ceil((at(F.col("wa"), n + 3) + vs - origin) / vs).cast("int"), F.col("g" + axis)) - 1
        wide = wide.withColumn("lo_" + name, low).withColumn("hi_" + name, high)
    wide = wide.withColumn("back", rigid_inverse(F.col("pose")))
    for name in "ijk":
        # An empty range explodes to no row. A filter here would be pushed below the
        # matrices and repeat their expressions.
        low, high = F.col("lo_" + name), F.col("hi_" + name)
        wide = wide.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))
    centre = tuple(voxel_center(F.col(n), F.col("o" + a), F.col("voxel_size")) for a, n in zip("xyz", "ijk"))
    local = apply_matrix(F.col("back"), centre)
    inside = None
    for n, value in enumerate(local):
        test = (value >= at(F.col("aabb"), n)) & (value <= at(F.col("aabb"), n + 3))
        inside = test if inside is None else inside & test
    return wide.filter(inside).select(*key, "i", "j", "k")


def voxelize_obb(objects: DataFrame, grid: DataFrame) -> DataFrame:
    """Target voxels per object."""
    return voxelize_boxes(objects, grid, OBJ)


def mark_objects(columns: DataFrame, object_voxels: DataFrame) -> DataFrame:
    """Packed grid with every object voxel OCCUPIED."""
    zero = F.lit(0).cast("long")
    mine = object_voxels.select(*FK, "i", "j", word_of(F.col("k")).alias("w"), bit_in_word(F.col("k")).alias("occ"))
    merged = (
        columns.select(*FK, "i", "j", "w", "free", "occ")
        .unionByName(mine.withColumn("free", zero))
        .groupBy(*FK, "i", "j", "w")
        .agg(F.bit_or("free").alias("free"), F.bit_or("occ").alias("occ"))
    )
    return merged.withColumn("free", F.col("free").bitwiseAND(F.bitwise_not("occ")))


def remove_target(columns: DataFrame, objects: DataFrame, object_voxels: DataFrame) -> DataFrame:
    """Packed OCCUPIED columns per (frame, object) without the object's own voxels."""
    own = _pack(object_voxels, OBJ, "own")
    base = columns.filter(F.col("occ") != 0).select(*FK, "i", "j", "w", "occ")
    per_object = base.join(objects.select(*OBJ), FK)
    joined = per_object.join(own, OBJ + ["i", "j", "w"], "left")
    left_over = F.col("occ").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long"))))
    return joined.select(*OBJ, "i", "j", "w", left_over.alias("occ")).filter(F.col("occ") != 0)


def grid_meta(columns: DataFrame, grid: DataFrame) -> DataFrame:
    """Shape, origin and voxel counts per state; UNKNOWN is what is left of the volume."""
    counts = columns.groupBy(*FK).agg(
        F.sum(F.bit_count("free")).alias("free_count"), F.sum(F.bit_count("occ")).alias("occupied_count")
    )
    zero = F.lit(0).cast("long")
    out = grid.join(counts, FK, "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("free_count", "occupied_count")}
    )
    volume = F.col("gx").cast("long") * F.col("gy") * F.col("gz")
    return out.withColumn("unknown_count", volume - F.col("free_count") - F.col("occupied_count"))


def layer_peak(columns: DataFrame) -> DataFrame:
    """Layer with the most OCCUPIED voxels per frame, the lowest on a tie."""
    layers = occupied_voxels(columns).groupBy(*FK, "k").agg(F.count(F.lit(1)).alias("n"))
    best = layers.groupBy(*FK).agg(F.max(F.struct("n", (-F.col("k")).alias("neg_k"))).alias("top"))
    return best.select(*FK, (-F.col("top.neg_k")).alias("table_z"), F.col("top.n").alias("n_occupied"))


def project_occupied(columns: DataFrame, grid: DataFrame, camera: DataFrame) -> DataFrame:
    """Pixel and camera depth of every OCCUPIED voxel centre inside the image.

    An empty array stands for a voxel outside: a filter would be pushed below the projection and repeat its expressions
    until the generated code is too long to be compiled.
    """
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", "img_w", "img_h", rigid_inverse(F.col("pose")).alias("w2c"))
    frame = grid.select(*FK, "ox", "oy", "oz", "voxel_size").join(cam, FK)
    voxels = occupied_voxels(columns).join(frame, FK)
    centre = tuple(voxel_center(F.col(n), F.col("o" + a), F.col("voxel_size")) for a, n in zip("xyz", "ijk"))
    kept = [*FK, "i", "j", "k", "fx", "fy", "cx", "cy", "img_w", "img_h"]
    seen = voxels.select(*kept, *[c.alias("l" + a) for a, c in zip("xyz", apply_matrix(F.col("w2c"), centre))])
    u, v, z = project_camera_point(tuple(F.col("l" + a) for a in "xyz"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    seen = seen.select(*FK, "i", "j", "k", "img_w", "img_h", u.alias("pu"), v.alias("pv"), z.alias("z"))
    inside = (F.col("z") > 0) & (F.col("pu") >= 0) & (F.col("pu") < F.col("img_w")) & (F.col("pv") >= 0) & (F.col("pv") < F.col("img_h"))
    pixel = F.struct("z", pixel_index(F.col("pu"), F.col("img_w")).alias("u"), pixel_index(F.col("pv"), F.col("img_h")).alias("v"))
    return seen.select(*FK, "i", "j", "k", F.explode(F.when(inside, F.array(pixel))).alias("_p")).select(*FK, "i", "j", "k", "_p.z", "_p.u", "_p.v")


def depth_layers(columns: DataFrame, grid: DataFrame, camera: DataFrame, object_voxels: DataFrame) -> DataFrame:
    """One buffer for a frame and all its objects: (frame, u, v, layers), layers an array of (z, owners).

    Each layer is the nearest depth of one owner set, the objects whose own voxels it comes from; nearer layers come
    first. The list ends where no object owns all layers so far, as every object then finds one that is not its own:
    mostly after one layer (scene geometry in front) or two (an object, then what is behind it).
    """
    seen = project_occupied(columns, grid, camera)
    owners = object_voxels.groupBy(*FK, "i", "j", "k").agg(F.sort_array(F.collect_set("obj_id")).alias("owners"))
    owned = seen.join(owners, FK + ["i", "j", "k"], "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    nearest = owned.groupBy(*FK, "u", "v", "owners").agg(F.min("z").alias("z"))
    stacked = nearest.groupBy(*FK, "u", "v").agg(F.sort_array(F.collect_list(F.struct("z", "owners"))).alias("all"))

    def keep(held, layer):
        left = F.when(F.size(held["layers"]) == 0, layer["owners"]).otherwise(F.array_intersect(held["left"], layer["owners"]))
        done = (F.size(held["layers"]) > 0) & (F.size(held["left"]) == 0)
        return F.when(done, held).otherwise(F.struct(F.concat(held["layers"], F.array(layer)).alias("layers"), left.alias("left")))

    kind = nearest.schema["owners"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<z:double,owners:{kind}>>").alias("layers"), F.array().cast(kind).alias("left"))
    return stacked.select(*FK, "u", "v", F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", start, keep)["layers"]).alias("layers"))


def depth_of_others(layers: Column, obj_id: Column) -> Column:
    """Nearest depth in ``layers`` that is not the object's own, or null (infinite)."""
    first = F.get(layers, F.lit(0))
    mine = F.array_contains(first["owners"], obj_id)
    return F.when(~mine, first["z"]).otherwise(F.get(F.filter(layers, lambda d: ~F.array_contains(d["owners"], obj_id)), F.lit(0))["z"])


def zbuffer(layers: DataFrame, objects: DataFrame) -> DataFrame:
    """The buffer as each object sees it: (object, u, v, z) without the object's own voxels; a missing row is infinite.

    A report: it has a row for each object and pixel. The tests of the plan look ``depth_layers`` up instead.
    """
    seen = layers.join(objects.select(*OBJ), FK)
    return seen.select(*OBJ, "u", "v", depth_of_others(F.col("layers"), F.col("obj_id")).alias("z")).filter(F.col("z").isNotNull())


def object_visible(objects: DataFrame, camera: DataFrame, layers: DataFrame, margin: float) -> DataFrame:
    """Per object: whole box inside the image and no corner behind other geometry (``depth_layers``)."""
    cam = camera.select(*FK, "fx", "fy", "cx", "cy", "img_w", "img_h", rigid_inverse(F.col("pose")).alias("w2c"))
    posed = objects.select(*OBJ, "aabb", F.col("pose").alias("obj_pose")).join(cam, FK)
    posed = posed.withColumn("pose_cam", matrix_product(F.col("w2c"), F.col("obj_pose")))
    corners = posed.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    local = apply_matrix(F.col("pose_cam"), corner(F.col("aabb"), F.col("n")))
    corners = corners.withColumns({"lx": local[0], "ly": local[1], "lz": local[2]})
    z = F.col("lz")
    safe = F.when(z > 0, z).otherwise(F.lit(1.0))
    u = F.col("fx") * F.col("lx") / safe + F.col("cx")
    v = F.col("fy") * F.col("ly") / safe + F.col("cy")
    inside = (z > 0) & (u >= 0) & (u < F.col("img_w")) & (v >= 0) & (v < F.col("img_h"))
    looked = corners.select(
        *OBJ, inside.alias("inside"), z.alias("corner_z"),
        pixel_index(u, F.col("img_w")).alias("u"), pixel_index(v, F.col("img_h")).alias("v"),
    ).join(layers, FK + ["u", "v"], "left")
    hidden = F.coalesce(F.col("corner_z") > depth_of_others(F.col("layers"), F.col("obj_id")) + margin, F.lit(False))
    return looked.groupBy(*OBJ).agg(
        F.bool_and("inside").alias("in_image"), (~F.bool_or(F.col("inside") & hidden)).alias("unoccluded")
    ).select(*OBJ, "in_image", (F.col("in_image") & F.col("unoccluded")).alias("visible"))


def export_occupancy_points(columns: DataFrame, grid: DataFrame, states=(OCCUPIED,), max_points: int | None = None, seed: int = 42) -> DataFrame:
    """Voxel centres of the chosen states with their colour.

    ``max_points`` caps a frame by a random draw without replacement: the rows with
    the smallest hash. The rank filter is pushed below the shuffle by Spark.
    UNKNOWN voxels are listed from the grid shape only when asked for.
    """
    voxels = _unpack_states(columns)
    if UNKNOWN in states:
        shape = grid.select(*FK, "gx", "gy", "gz")
        cells = shape
        for axis, name in zip("xyz", "ijk"):
            cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("g" + axis) - 1)))
        known = voxels.select(*FK, "i", "j", "k")
        unknown = cells.select(*FK, "i", "j", "k").join(known, FK + ["i", "j", "k"], "left_anti")
        voxels = voxels.unionByName(unknown.withColumn("state", F.lit(UNKNOWN)))
    voxels = voxels.filter(F.col("state").isin(*states))
    if max_points is not None:
        from pyspark.sql import Window

        draw = F.xxhash64(F.lit(seed), "i", "j", "k")
        order = Window.partitionBy(*FK).orderBy(draw, "i", "j", "k")
        voxels = voxels.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_points).drop("_rank")
    color = None
    for state, rgb in STATE_COLORS.items():
        hit, value = F.col("state") == state, F.array(*[F.lit(c) for c in rgb])
        color = F.when(hit, value) if color is None else color.when(hit, value)
    out = voxel_to_world(voxels.withColumn("_c", color), grid)
    return out.select(*FK, "state", "x", "y", "z", *[F.col("_c")[n].alias(c) for n, c in enumerate("rgb")])


def occupancy_from_depth(depth_px: DataFrame, camera: DataFrame, cfg):
    """(points, grid bounds, packed columns) of a batch of frames."""
    points = depth_to_points(depth_px, camera, cfg.pixel_stride)
    grid = grid_bounds(points, camera, cfg.voxel_size, cfg.grid_padding)
    return points, grid, occupancy_columns(points, camera, grid)
