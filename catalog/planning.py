"""Planning queries: from depth pixels to placements, with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.oracle_cte import FKC, OB, PZ, apply, dilated, eroded, out, query, _K
from catalog.scene import CONFIG, Scene
from catalog.tidy import spread_array, tidy
from catalog.views import duck, load
from scenesift.functions import boxes as bx
from scenesift.functions import geometry as geo
from scenesift.operators import cluster as clu
from scenesift.operators import components as cmp
from scenesift.operators import morphology as mor
from scenesift.operators import occupancy as occ
from scenesift.operators import overlay as ovl
from scenesift.operators import placement as plc
from scenesift.operators import points as pts
from scenesift.operators import surface as srf
from scenesift.plans import placement as plan
from scenesift.session import cut_lineage
from scenesift.sources import sinks

FK, OBJ, POSE, CANDIDATE = pts.FK, occ.OBJ, plc.POSE, plc.CANDIDATE
QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def scene_query(name, oracle=None):
    """Query over a Scene, tidied."""

    def add(fn):
        register(name, oracle)(lambda spark, sf_dir: tidy(fn(Scene(spark, sf_dir))))
        return fn

    return add


MAT = [f"m{n}" for n in range(12)]


def mat_cols(df, column):
    """First three rows of a 4x4 as columns."""
    return spread_array(df, column, MAT)


def small_cuts(s):
    """Cut the per-frame and per-object tables that several branches of a query read."""
    s.objects = cut_lineage(s.objects)
    s.own = cut_lineage(s.own)
    s.base = cut_lineage(s.base)
    return s


# ---- points and grid ---------------------------------------------------------------

scene_query("stride_sample", query("px", out(f"{FKC} u:i v:i d:d".replace(",", ""), "px WHERE d > 0 AND u % 2 = 0 AND v % 2 = 0")))(
    lambda s: pts.stride_sample(s.depth, 2)
)
scene_query("depth_to_points", query("pts", out("scene_id frame_id u:i v:i x:d y:d z:d", "pts")))(
    lambda s: pts.depth_to_points(s.depth, s.camera, s.cfg.pixel_stride).drop("d")
)
scene_query("depth_to_pointcloud", query("px cam pts", out("scene_id frame_id u:i v:i x:d y:d z:d", "pts WHERE u % 4 = 0 AND v % 4 = 0")))(
    lambda s: pts.depth_to_points(s.depth, s.camera, 4).drop("d")
)
scene_query("grid_bounds", query("grid", out("scene_id frame_id ox:d oy:d oz:d gx:i gy:i gz:i", "grid")))(lambda s: s.grid.drop("voxel_size"))
scene_query("world_to_voxel", query("pts grid", out("scene_id frame_id u:i v:i i:i j:i k:i", f"""(
 SELECT {FKC}, u, v, floor((x - ox) / 5) AS i, floor((y - oy) / 5) AS j, floor((z - oz) / 5) AS k FROM pts JOIN grid USING ({FKC}))""")))(
    lambda s: occ.world_to_voxel(s.points, s.grid).drop("d", "x", "y", "z")
)
scene_query("surface_voxels", query("surf", out("scene_id frame_id i:i j:i k:i", "surf")))(lambda s: occ.surface_voxels(s.points, s.grid))
scene_query("voxel_to_world", query("surf grid", out("scene_id frame_id i:i j:i k:i x:d y:d z:d", f"""(
 SELECT {FKC}, i, j, k, ox + (i + 0.5) * 5 AS x, oy + (j + 0.5) * 5 AS y, oz + (k + 0.5) * 5 AS z FROM surf JOIN grid USING ({FKC}))""")))(
    lambda s: occ.voxel_to_world(occ.surface_voxels(s.points, s.grid), s.grid)
)
scene_query("raycast_free", query("free0", out("scene_id frame_id i:i j:i k:i", "free0")))(lambda s: occ.raycast_free(s.points, s.camera, s.grid))
scene_query("occupancy_grid", query("vox0", out("scene_id frame_id i:i j:i k:i state:i", "vox0")))(lambda s: occ.occupancy_grid(s.columns))
GRID_META = query("vox0 grid", out("scene_id frame_id ox:d oy:d oz:d gx:i gy:i gz:i free_count:i occupied_count:i unknown_count:i", f"""(
 SELECT *, gx * gy * gz - free_count - occupied_count AS unknown_count FROM (
  SELECT {FKC}, ox, oy, oz, gx, gy, gz, count(CASE WHEN state = 0 THEN 1 END) AS free_count, count(CASE WHEN state = 1 THEN 1 END) AS occupied_count
  FROM grid LEFT JOIN vox0 USING ({FKC}) GROUP BY ALL))"""))
scene_query("grid_meta", GRID_META)(lambda s: occ.grid_meta(s.columns, s.grid).drop("voxel_size"))
scene_query("layer_peak", query("peak", out("scene_id frame_id table_z:i n_occupied:i", "peak")))(lambda s: occ.layer_peak(s.base))
scene_query("export_occupancy_points", query("vox0 grid", out("scene_id frame_id state:i x:d y:d z:d r:i g:i b:i", f"""(
 SELECT {FKC}, state, ox + (i + 0.5) * 5 AS x, oy + (j + 0.5) * 5 AS y, oz + (k + 0.5) * 5 AS z,
  CASE state WHEN 0 THEN 76 ELSE 244 END AS r, CASE state WHEN 0 THEN 175 ELSE 67 END AS g, CASE state WHEN 0 THEN 80 ELSE 54 END AS b
 FROM vox0 JOIN grid USING ({FKC}))""")))(lambda s: occ.export_occupancy_points(s.columns, s.grid, (occ.FREE, occ.OCCUPIED)))

# ---- object geometry ---------------------------------------------------------------

_CORNER = apply("p", _K)
scene_query("bbox_corners", query("obj corner", out("scene_id frame_id obj_id corner:i x:d y:d z:d", f"(SELECT {OB}, corner, {_CORNER[0]} AS x, {_CORNER[1]} AS y, {_CORNER[2]} AS z FROM obj, corner)")))(
    lambda s: ovl.bbox_corners(s.objects, OBJ)
)
scene_query("obb_world_aabb", query("obj corner", f"""
SELECT {OB}, {", ".join(f"round(min(v{n}), 6) + 0e0 AS lo_{a}, round(max(v{n}), 6) + 0e0 AS hi_{a}" for n, a in enumerate("xyz"))}
FROM (SELECT {OB}, {", ".join(f"{_CORNER[n]} AS v{n}" for n in range(3))} FROM obj, corner) GROUP BY ALL"""))(
    lambda s: spread_array(s.objects.select(*OBJ, geo.world_aabb(F.col("aabb"), F.col("pose")).alias("w")), "w", ["lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z"])
)
scene_query("transform_points", query("obj corner", out("scene_id frame_id obj_id corner:i x:d y:d z:d", f"(SELECT {OB}, corner, {_CORNER[0]} AS x, {_CORNER[1]} AS y, {_CORNER[2]} AS z FROM obj, corner)")))(
    lambda s: pts.transform_points(
        s.objects.select(*OBJ, F.col("aabb").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner")).select(
            *OBJ, "corner", *[c.alias(a) for c, a in zip(geo.corner(F.col("bx"), F.col("corner")), "xyz")]
        ),
        s.objects.withColumnRenamed("pose", "matrix"), OBJ,
    )
)
scene_query("rotation_z", query("obj yaws", "SELECT " + OB + ", CAST(yaw_idx AS BIGINT) AS yaw_idx, " + ", ".join(
    f"round({e}, 6) + 0e0 AS m{n}" for n, e in enumerate(("cos(yaw)", "-sin(yaw)", "0e0", "0e0", "sin(yaw)", "cos(yaw)", "0e0", "0e0", "0e0", "0e0", "1e0", "0e0"))
) + " FROM obj, yaws"))(lambda s: mat_cols(plc.yaw_grid(s.objects.select(*OBJ), CONFIG.yaw_steps).select(*POSE, geo.rotation_z(F.col("yaw")).alias("m")), "m"))
scene_query("euler_to_matrix", query("obj", out("scene_id frame_id obj_id " + " ".join(f"m{n}:d" for n in range(12)), f"(SELECT {OB}, {', '.join(f'p{n} AS m{n}' for n in range(12))} FROM obj)")))(
    lambda s: mat_cols(s.objects.select(*OBJ, F.col("pose").alias("m")), "m")
)
_SING = "sqrt(p0 * p0 + p4 * p4)"
scene_query("matrix_to_euler", query("obj", out("scene_id frame_id obj_id roll:d pitch:d yaw:d", f"""(
 SELECT {OB}, CASE WHEN {_SING} < 1e-6 THEN atan2(-p6, p5) ELSE atan2(p9, p10) END AS roll, atan2(-p8, {_SING}) AS pitch,
        CASE WHEN {_SING} < 1e-6 THEN 0 ELSE atan2(p4, p0) END AS yaw FROM obj)""")))(
    lambda s: s.objects.select(*OBJ, geo.matrix_to_euler(F.col("pose")).alias("e")).select(*OBJ, "e.*")
)
scene_query("pose_orientation", query("obj", out("scene_id frame_id obj_id vertical_axis_index:i vertical_axis_alignment:d flat_axis_index:i upright_axis_index:i is_axis_aligned is_flat is_upright is_reasonable", f"""(
 SELECT *, al >= cos(radians(15)) AS is_axis_aligned, al >= cos(radians(15)) AND vertical_axis_index = flat_axis_index AS is_flat,
   al >= cos(radians(15)) AND vertical_axis_index = upright_axis_index AS is_upright, al >= cos(radians(15)) AS is_reasonable, al AS vertical_axis_alignment
 FROM (SELECT {OB}, greatest(abs(p8), abs(p9), abs(p10)) AS al,
   CASE WHEN abs(p8) >= abs(p9) AND abs(p8) >= abs(p10) THEN 0 WHEN abs(p9) >= abs(p10) THEN 1 ELSE 2 END AS vertical_axis_index,
   CASE WHEN hi0 - lo0 <= hi1 - lo1 AND hi0 - lo0 <= hi2 - lo2 THEN 0 WHEN hi1 - lo1 <= hi2 - lo2 THEN 1 ELSE 2 END AS flat_axis_index,
   CASE WHEN hi0 - lo0 >= hi1 - lo1 AND hi0 - lo0 >= hi2 - lo2 THEN 0 WHEN hi1 - lo1 >= hi2 - lo2 THEN 1 ELSE 2 END AS upright_axis_index FROM obj))""")))(
    lambda s: s.objects.select(*OBJ, geo.pose_orientation(F.col("pose"), F.col("aabb"), 15.0, 15.0).alias("o")).select(*OBJ, "o.*")
)
scene_query("rigid_inverse", query("cam", out("scene_id frame_id " + " ".join(f"m{n}:d" for n in range(12)), f"(SELECT {FKC}, {', '.join(f'w{n} AS m{n}' for n in range(12))} FROM cam)")))(
    lambda s: mat_cols(s.camera.select(*FK, geo.rigid_inverse(F.col("pose")).alias("m")), "m")
)
_WP = apply("w", ("x", "y", "z"))
_PROJ = query("pts cam", out("scene_id frame_id u:i v:i px_u:d px_v:d z_cam:d", f"""(
 SELECT {FKC}, u, v, (fx * xc + cx * zc) / zs AS px_u, (fy * yc + cy * zc) / zs AS px_v, zc AS z_cam FROM (
  SELECT *, CASE WHEN abs(zc) < 1e-8 THEN 1e-8 ELSE zc END AS zs FROM (
   SELECT {FKC}, u, v, fx, fy, cx, cy, {_WP[0]} AS xc, {_WP[1]} AS yc, {_WP[2]} AS zc FROM pts JOIN cam USING ({FKC}))))"""))
for _n in ("project_world", "project_to_image"):
    scene_query(_n, _PROJ)(lambda s: pts.project_world(s.points, s.camera).select(*FK, "u", "v", "px_u", "px_v", "z_cam"))
_EDGES = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(geo.BOX_EDGES))
_CAMC = apply("w", ("x", "y", "z"))
_UVC = f"""SELECT {OB}, corner, zc, (fx * xc + cx * zc) / (CASE WHEN abs(zc) < 1e-8 THEN 1e-8 ELSE zc END) AS pu, (fy * yc + cy * zc) / (CASE WHEN abs(zc) < 1e-8 THEN 1e-8 ELSE zc END) AS pv
 FROM (SELECT *, {_CAMC[0]} AS xc, {_CAMC[1]} AS yc, {_CAMC[2]} AS zc FROM (
  SELECT *, {_CORNER[0]} AS x, {_CORNER[1]} AS y, {_CORNER[2]} AS z FROM obj, corner) JOIN cam USING ({FKC}))"""
scene_query("bbox_edges_2d", query("obj corner cam", out("scene_id frame_id obj_id edge:i u0:d v0:d u1:d v1:d", f"""(
 SELECT scene_id, frame_id, obj_id, edge, a.pu AS u0, a.pv AS v0, b.pu AS u1, b.pv AS v1 FROM ({_UVC}) a JOIN ({_UVC}) b USING ({OB})
 JOIN (VALUES {_EDGES}) e(edge, ca, cb) ON a.corner = ca AND b.corner = cb WHERE a.zc > 0 AND b.zc > 0)""")))(
    lambda s: ovl.bbox_edges_2d(s.objects, s.camera, OBJ)
)
_FACES = ", ".join(f"({a}, {sg}, {pos}, {c})" for a, sg, cs in geo.CONTACT_FACES for pos, c in enumerate(cs))
scene_query("contact_face", query("obj corner cam", out("scene_id frame_id obj_id pos:i corner:i u:d v:d z:d", f"""(
 SELECT {OB}, pos, corner, pu AS u, pv AS v, zc AS z FROM ({_UVC}) JOIN (
  SELECT {OB}, CASE WHEN abs(p8) >= abs(p9) AND abs(p8) >= abs(p10) THEN 0 WHEN abs(p9) >= abs(p10) THEN 1 ELSE 2 END AS axis,
         CAST(sign(CASE WHEN abs(p8) >= abs(p9) AND abs(p8) >= abs(p10) THEN -p8 WHEN abs(p9) >= abs(p10) THEN -p9 ELSE -p10 END) AS INT) AS sg FROM obj) USING ({OB})
 JOIN (VALUES {_FACES}) f(axis, sg, pos, corner) USING (axis, sg, corner))""")))(lambda s: ovl.contact_faces(s.objects, s.camera, OBJ))
scene_query("yaw_grid", query("obj yaws", out("scene_id frame_id obj_id yaw_idx:i yaw:d", "obj, yaws")))(lambda s: plc.yaw_grid(s.objects.select(*OBJ), CONFIG.yaw_steps))
scene_query("placed_transform", query("poses", out("scene_id frame_id obj_id yaw_idx:i " + " ".join(f"m{n}:d" for n in range(12)), f"(SELECT {PZ}, {', '.join(f'r{n} AS m{n}' for n in range(12))} FROM poses)")))(
    lambda s: mat_cols(s.poses.select(*POSE, F.col("pose").alias("m")), "m")
)
scene_query("anchor_transform", query("placed visible", out("scene_id frame_id obj_id rank:i " + " ".join(f"m{n}:d" for n in range(12)), f"""(
 SELECT {OB}, "rank", {', '.join(f'r{n} AS m{n}' for n in range(12))} FROM placed SEMI JOIN (SELECT {OB} FROM visible WHERE visible) USING ({OB}))""")))(
    lambda s: mat_cols(layer_plan(s).placements.select(*FK, F.col("object_id").alias("obj_id"), "rank", F.col("transform_world").alias("m")), "m")
)
_BOXW = f"""(SELECT {OB}, w0*p3+w1*p7+w2*p11+w3 AS cx, w4*p3+w5*p7+w6*p11+w7 AS cy, w8*p3+w9*p7+w10*p11+w11 AS cz, hi0 - lo0 AS l, hi1 - lo1 AS w, hi2 - lo2 AS h,
 atan2(w4 * cos(t) + w5 * sin(t), w0 * cos(t) + w1 * sin(t)) AS yaw FROM (SELECT *, atan2(p4, p0) AS t FROM obj) JOIN cam USING ({FKC}))"""


def heading_boxes(s):
    """7-DoF boxes of the objects in world axes."""
    lo, hi = ([geo.at(F.col("aabb"), n + k) for n in range(3)] for k in (0, 3))
    centre = [geo.cell(F.col("pose"), r, 3) for r in range(3)]
    yaw = F.atan2(geo.cell(F.col("pose"), 1, 0), geo.cell(F.col("pose"), 0, 0))
    return s.objects.select(*OBJ, bx.box(*centre, *[b - a for a, b in zip(lo, hi)], yaw).alias("box"))


scene_query("box_frame_change", query("obj cam", out("scene_id frame_id obj_id cx:d cy:d cz:d l:d w:d h:d yaw:d", _BOXW)))(
    lambda s: heading_boxes(s).join(s.camera.select(*FK, geo.rigid_inverse(F.col("pose")).alias("m")), FK)
    .select(*OBJ, bx.box_change_frame(F.col("box"), F.col("m")).alias("b")).select(*OBJ, "b.*")
)

# ---- objects in the grid -----------------------------------------------------------

scene_query("voxelize_obb", query("own", out("scene_id frame_id obj_id i:i j:i k:i", "own")))(lambda s: s.own)
scene_query("mark_objects", query("free occ", out("scene_id frame_id i:i j:i k:i state:i", f"(SELECT *, 0 AS state FROM free UNION ALL SELECT *, 1 FROM occ)")))(
    lambda s: occ.occupancy_grid(s.base)
)
scene_query("remove_target", query("others", out("scene_id frame_id obj_id i:i j:i k:i", "others")))(
    lambda s: occ.explode_bits(s.others, "occ", "w", "k")
)
scene_query("zbuffer", query("zb", out("scene_id frame_id obj_id u:i v:i z:d", "zb")))(lambda s: occ.zbuffer(small_cuts(s).layers, s.objects))
scene_query("object_visible", query("visible", out("scene_id frame_id obj_id in_image visible", "visible")))(
    lambda s: occ.object_visible(s.objects, s.camera, small_cuts(s).layers, CONFIG.voxel_size)
)

# ---- morphology and components -----------------------------------------------------

LAYER = FK + ["k"]


def occ_cells(s):
    return occ.occupied_voxels(s.columns)


def morph(name, source, *steps):
    """Oracle over the measured OCCUPIED cells of every layer."""
    key, text, n = FKC + ", k", source, 0
    for step in steps:
        text = f"({step(text, key)}) AS s{n}"
        n += 1
    return query("surf off9 grid", out("scene_id frame_id k:i i:i j:i", text))


_SRC = "(SELECT scene_id, frame_id, k, i, j FROM surf)"
scene_query("erode_2d", morph("erode_2d", _SRC, eroded))(lambda s: mor.erode_2d(occ_cells(s), s.grid, LAYER))
scene_query("dilate_2d", morph("dilate_2d", _SRC, dilated))(lambda s: mor.dilate_2d(occ_cells(s), s.grid, LAYER))
scene_query("open_2d", morph("open_2d", _SRC, eroded, dilated))(lambda s: mor.open_2d(occ_cells(s), s.grid, LAYER))
scene_query("close_2d", morph("close_2d", _SRC, dilated, eroded))(lambda s: mor.close_2d(occ_cells(s), s.grid, LAYER))
scene_query("dilate_xy", query("free grid", out("scene_id frame_id i:i j:i k:i", f"""(
 SELECT DISTINCT {FKC}, i, j, k FROM (
  SELECT {FKC}, i + a AS i, j + b AS j, k, gx, gy FROM (
   SELECT {FKC}, gx, gy, i, j, k FROM (SELECT *, unnest(range(0, gz)) AS k FROM (SELECT *, unnest(range(0, gy)) AS j FROM (SELECT *, unnest(range(0, gx)) AS i FROM grid)))
   ANTI JOIN free USING ({FKC}, i, j, k)),
  (SELECT a, b FROM range(-2, 3) x(a), range(-2, 3) y(b) WHERE abs(a) + abs(b) <= 2))
 WHERE i >= 0 AND i < gx AND j >= 0 AND j < gy)""")))(
    lambda s: mor.obstacle_voxels(mor.dilate_xy(mor.obstacle_columns(s.base, s.grid), s.grid, 2))
)
scene_query("label_components", query("cc_occ", out("scene_id frame_id k:i i:i j:i lab:i area:i comp_rank:i", f"""(
 SELECT *, dense_rank() OVER (PARTITION BY {FKC}, k ORDER BY area DESC, lab) - 1 AS comp_rank FROM (
  SELECT *, count(*) OVER (PARTITION BY {FKC}, k, lab) AS area FROM cc_occ))""")))(
    lambda s: cmp.label_components(occ.occupied_voxels(s.base), LAYER).withColumnRenamed("label", "lab")
)


def grid_surface(s):
    small_cuts(s)
    return srf.surface_grid(s.others, s.grid, s.own, CONFIG.min_surface_voxels)


scene_query("surface_grid", query("cc_fl best", out("scene_id frame_id obj_id table_z:i i:i j:i", f"""(
 SELECT {OB}, table_z, i, j FROM best b JOIN cc_fl c USING ({OB}, lab) WHERE c.k = b.table_z)""")))(lambda s: grid_surface(s)[1])
scene_query("best_surface", query("best", out("scene_id frame_id obj_id table_z:i area:i d2:i", "best")))(
    lambda s: grid_surface(s)[0].select(*OBJ, "table_z", "area", "d2")
)


def component_distances(s):
    small_cuts(s)
    runs = srf.surface_layer_components(s.others, s.grid, CONFIG.min_surface_voxels)
    big = cmp.component_areas(runs, srf.CAND, CONFIG.min_surface_voxels)
    near = srf.surface_object_distance(runs.join(big.select(*srf.CAND, "label"), srf.CAND + ["label"]), s.own)
    return near.select(*OBJ, F.col("table_z").alias("k"), F.col("label").alias("lab"), "d2", F.sqrt("d2").alias("distance"))


scene_query("surface_object_distance", query("comp_dist", out("scene_id frame_id obj_id k:i lab:i d2:i distance:d", "(SELECT *, sqrt(d2) AS distance FROM comp_dist)")))(component_distances)


def ransac(s):
    small_cuts(s)
    return srf.surface_ransac(s.points, s.base, s.grid, s.objects, s.own, CONFIG)[0].select(*OBJ, "plane", "table_z", "area", "d2")


scene_query("surface_ransac", query("rs_best", out("scene_id frame_id obj_id plane:i table_z:i area:i d2:i", "rs_best")))(ransac)


def supported(s):
    small_cuts(s)
    return srf.support_surface(s.points, s.base, s.grid, s.objects, s.own, CONFIG)[1]


scene_query("support_surface", query("rs_cells", out("scene_id frame_id obj_id table_z:i i:i j:i", "rs_cells")))(supported)

# ---- search and filters on the layer surface ---------------------------------------


class Search:
    """Search inputs on the fullest layer as the surface, for all objects of all frames."""

    def __init__(self, s: Scene):
        self.s = s
        small_cuts(s)
        s.poses = cut_lineage(s.poses)
        s.voxels = cut_lineage(s.voxels)
        s.shapes = cut_lineage(s.shapes)
        self.cells = cut_lineage(srf.layer_surface(s.base, s.grid, s.objects, s.own))
        self.region = plc.search_region(self.cells, s.grid)
        self.eroded = plc.eroded_surface(self.cells, s.grid)
        steps = math.ceil(s.cfg.safety_margin / s.cfg.voxel_size)
        self.obstacles = mor.dilate_xy(mor.obstacle_columns(s.base, s.grid), s.grid, steps)

    def rows(self):
        s = self.s
        rows = plc.search_rows(s.voxels, s.shapes, self.region, self.obstacles, self.eroded)
        return cut_lineage(rows)

    def views(self):
        s = self.s
        return cut_lineage(plc.camera_views(s.poses, s.shapes, self.region, s.grid, s.camera))

    def in_view(self, views):
        """Packed candidates."""
        return plc.visible_rows(self.rows(), views, "stable").select(*plc.ROW, F.col("visible").alias("bits"))

    def kept(self):
        views = self.views()
        seen = cut_lineage(self.in_view(views))
        kept = plc.unoccluded_rows(seen, views, self.s.layers, CONFIG.occlusion_threshold, "bits")
        return kept.select(*plc.ROW, F.col("kept").alias("bits"))


def unpacked(words, *extra):
    return plc.unpack_candidates(words).select(*CANDIDATE, *extra)


CAND_OUT = "scene_id frame_id obj_id yaw_idx:i gx:i gy:i"
scene_query("collision_search", query("cand", out(CAND_OUT, "cand")))(
    lambda s: plc.row_candidates(plc.search_rows((q := Search(s)).s.voxels, q.s.shapes, q.region, q.obstacles), "raw")
)
scene_query("collision_search_margin", query("cand", out(CAND_OUT, "cand")))(
    lambda s: plc.collision_search((q := Search(s)).s.base, q.s.grid, q.s.voxels, q.s.shapes, q.region, CONFIG.safety_margin, CONFIG.voxel_size).select(*CANDIDATE)
)
scene_query("collision_search_no_margin", query("cand_0", out(CAND_OUT, "cand_0")))(
    lambda s: plc.collision_search((q := Search(s)).s.base, q.s.grid, q.s.voxels, q.s.shapes, q.region, 0.0, CONFIG.voxel_size).select(*CANDIDATE)
)
scene_query("search_meta", query("cand region", out("scene_id frame_id obj_id total_xy:i valid_raw:i yaw_steps:i valid_yaw_angles:i landing_z:i table_z:i", f"""(
 SELECT {OB}, grid_x * grid_y AS total_xy, count(yaw_idx) AS valid_raw, {CONFIG.yaw_steps} AS yaw_steps, count(DISTINCT yaw_idx) AS valid_yaw_angles, region.landing_z, region.table_z
 FROM region LEFT JOIN cand USING ({OB}) GROUP BY {OB}, grid_x, grid_y, region.landing_z, region.table_z)""")))(
    lambda s: plc.search_meta(plc.row_candidates(plc.search_rows((q := Search(s)).s.voxels, q.s.shapes, q.region, q.obstacles), "raw"), q.region, CONFIG.yaw_steps)
)
scene_query("filter_stable", query("stable", out(CAND_OUT, "stable")))(lambda s: plc.row_candidates(Search(s).rows(), "stable"))
scene_query("filter_stable_ratio", query("held com", out(CAND_OUT, f"(SELECT {PZ}, gx, gy FROM held SEMI JOIN com USING ({PZ}, gx, gy) WHERE held / n_foot >= 0.75)")))(
    lambda s: unpacked(plc.stable_rows((q := Search(s)).rows(), q.s.voxels, q.s.shapes, q.eroded, 0.75, "raw"))
)
scene_query("filter_visible", query("in_view", out(CAND_OUT, "in_view")))(
    lambda s: unpacked((q := Search(s)).in_view(q.views()))
)
scene_query("filter_visible_rows", query("in_view", out(CAND_OUT, "in_view")))(
    lambda s: plc.filter_visible(plc.row_candidates((q := Search(s)).rows(), "stable"), q.views())
)
scene_query("filter_occluded", query("kept", out(CAND_OUT, "kept")))(lambda s: unpacked(Search(s).kept()))
scene_query("adaptive_eps", query("radius", out("scene_id frame_id obj_id eps:d", "radius")))(
    lambda s: clu.adaptive_eps(s.objects, s.shapes, s.grid).select(*OBJ, "eps")
)


def clustered(s):
    q = Search(s)
    kept = cut_lineage(q.kept())
    return clu.dbscan(kept, clu.adaptive_eps(s.objects, s.shapes, s.grid), 1)


scene_query("dbscan", query("clu", out(CAND_OUT + " cluster_id:i", "clu")))(lambda s: unpacked(clustered(s), "cluster_id"))
REP_OUT = "scene_id frame_id obj_id cluster_id:i size:i used_original_yaw yaw_idx:i gx:i gy:i centroid_cells:d"
scene_query("cluster_representative", query("rep", out(REP_OUT, "rep")))(lambda s: clu.cluster_representative(clustered(s)))
scene_query("rank_clusters", query("ranked", out(REP_OUT + ' rank:i', "ranked")))(lambda s: clu.rank_clusters(clu.cluster_representative(clustered(s))))


def layer_plan(s):
    surface = lambda p, c, g, o, v: srf.layer_surface(c, g, o, v)
    return plan.plan_placements(s.depth, s.camera, s.objects, CONFIG, surface)


_FUNNEL = f"""(
 SELECT {OB}, class_name, CASE WHEN NOT has_vox THEN 'no voxels' WHEN NOT vis THEN 'not fully visible' WHEN NOT has_srf THEN 'no support surface' END AS skip_reason,
  CASE WHEN vis AND has_srf THEN n_raw ELSE 0 END AS num_raw_candidates, CASE WHEN vis AND has_srf THEN n_st ELSE 0 END AS num_after_stability,
  CASE WHEN vis AND has_srf THEN n_vis ELSE 0 END AS num_after_visibility, CASE WHEN vis AND has_srf THEN n_occ ELSE 0 END AS num_after_occlusion
 FROM (SELECT {OB}, class_name, coalesce(visible, false) AS vis, hv.n IS NOT NULL AS has_vox, hs.n IS NOT NULL AS has_srf,
   coalesce(a.n, 0) AS n_raw, coalesce(b.n, 0) AS n_st, coalesce(c.n, 0) AS n_vis, coalesce(d.n, 0) AS n_occ
  FROM obj LEFT JOIN visible USING ({OB})
  LEFT JOIN (SELECT {OB}, count(*) AS n FROM own GROUP BY ALL) hv USING ({OB}) LEFT JOIN (SELECT {OB}, count(*) AS n FROM surface GROUP BY ALL) hs USING ({OB})
  LEFT JOIN (SELECT {OB}, count(*) AS n FROM cand GROUP BY ALL) a USING ({OB}) LEFT JOIN (SELECT {OB}, count(*) AS n FROM stable GROUP BY ALL) b USING ({OB})
  LEFT JOIN (SELECT {OB}, count(*) AS n FROM in_view GROUP BY ALL) c USING ({OB}) LEFT JOIN (SELECT {OB}, count(*) AS n FROM kept GROUP BY ALL) d USING ({OB})))"""
FUNNEL_OUT = "scene_id frame_id obj_id class_name skip_reason num_raw_candidates:i num_after_stability:i num_after_visibility:i num_after_occlusion:i"
scene_query("stage_funnel", query("obj visible own surface cand stable in_view kept", out(FUNNEL_OUT, _FUNNEL)))(lambda s: layer_plan(s).funnel)
_SHOWN = f"(SELECT p.* FROM placed_box p SEMI JOIN (SELECT {OB} FROM visible WHERE visible) USING ({OB}))"
scene_query("placed_summary", query("obj placed_box visible", out("scene_id frame_id objects_placed:i objects_total:i", f"""(
 SELECT {FKC}, count(DISTINCT p.obj_id) AS objects_placed, count(DISTINCT o.obj_id) AS objects_total FROM obj o LEFT JOIN {_SHOWN} p USING ({OB}) GROUP BY ALL)""")))(
    lambda s: plan.placed_summary(s.objects, layer_plan(s).placements)
)
_OB0 = apply("p", tuple(f"((lo{a} + hi{a}) / 2)" for a in range(3)))
_DIST = f"sqrt({' + '.join(f'(ctr{n} - ({_OB0[n]})) * (ctr{n} - ({_OB0[n]}))' for n in range(3))})"
scene_query("displacement_stats", query("obj placed_box visible", out("scene_id frame_id object_id n_placements:i min_distance:d max_distance:d avg_distance:d lo_x:d lo_y:d lo_z:d hi_x:d hi_y:d hi_z:d", f"""(
 SELECT {FKC}, obj_id AS object_id, count(*) AS n_placements, min({_DIST}) AS min_distance, max({_DIST}) AS max_distance, avg({_DIST}) AS avg_distance,
  {", ".join(f"min(alo{n}) AS lo_{a}, max(ahi{n}) AS hi_{a}" for n, a in enumerate("xyz"))} FROM {_SHOWN} JOIN obj USING ({OB}) GROUP BY ALL)""")))(
    lambda s: plan.displacement_stats(layer_plan(s).placements)
)


def flat_placements(t):
    p = t.placements.select("sample_id", *FK, "object_id", "class_name", "rank", "yaw_degrees", "free_space_score", "center_world", "aabb_world")
    p = spread_array(p, "center_world", ["center_x", "center_y", "center_z"])
    return spread_array(p, "aabb_world", ["lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z"])


_FLAT = out("sample_id scene_id frame_id object_id class_name rank:i yaw_degrees:d free_space_score:i center_x:d center_y:d center_z:d lo_x:d lo_y:d lo_z:d hi_x:d hi_y:d hi_z:d", f"""(
 SELECT concat(scene_id, '_', frame_id, '_', obj_id, '_p', lpad(CAST("rank" AS VARCHAR), 3, '0')) AS sample_id, {FKC}, obj_id AS object_id, class_name, "rank",
  degrees(yaw) AS yaw_degrees, floor(centroid_cells * 5) AS free_space_score, ctr0 AS center_x, ctr1 AS center_y, ctr2 AS center_z,
  {", ".join(f"alo{n} AS lo_{a}, ahi{n} AS hi_{a}" for n, a in enumerate("xyz"))} FROM {_SHOWN} JOIN obj USING ({OB}))""")
scene_query("sink_samples", query("obj placed_box visible", _FLAT))(lambda s: flat_placements(layer_plan(s)))
scene_query("plan_placements", query("obj placed_box visible", _FLAT, surface="rs_cells"))(
    lambda s: flat_placements(plan.plan_placements(s.depth, s.camera, s.objects, CONFIG))
)

# ---- masks and point clouds --------------------------------------------------------

scene_query("crop_by_mask", query("pts", out("scene_id frame_id u:i v:i mask_id x:d y:d z:d", f"(SELECT {FKC}, u, v, mask_id, x, y, z FROM pts JOIN ({duck('fx_mask_px')}) USING ({FKC}, u, v) WHERE d >= 95 AND d <= 100)")))(
    lambda s: pts.crop_by_mask(s.depth, load(s.spark, s.sf_dir, "fx_mask_px"), s.camera, 95.0, 100.0).drop("d")
)
scene_query("depth_lift", query("pts", out("scene_id frame_id mask_id n_points:i x:d y:d z:d", f"""(
 SELECT {FKC}, mask_id, count(*) AS n_points, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts JOIN ({duck('fx_mask_px')}) USING ({FKC}, u, v) WHERE d >= 95 AND d <= 100 GROUP BY ALL)""")))(
    lambda s: pts.crop_by_mask(s.depth, load(s.spark, s.sf_dir, "fx_mask_px"), s.camera, 95.0, 100.0).groupBy(*FK, "mask_id").agg(
        F.count(F.lit(1)).alias("n_points"), *[F.avg(a).alias(a) for a in "xyz"]
    )
)
scene_query("export_points", query("pts", f"SELECT {FKC}, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y, round(z, 4) + 0e0 AS z FROM pts"))(
    lambda s: sinks.point_lines(s.points.withColumns({c: F.lit(None).cast("int") for c in "rgb"})).select(*FK, *[(F.col(a) + 0.0).alias(a) for a in "xyz"])
)
scene_query("sink_grid_meta", query("free occ grid", out("scene_id frame_id unit free:i occupied:i unknown:i", f"""(
 SELECT {FKC}, 'cm' AS unit, f AS free, o AS occupied, gx * gy * gz - f - o AS unknown FROM grid
 LEFT JOIN (SELECT {FKC}, count(*) AS f FROM free GROUP BY ALL) USING ({FKC}) LEFT JOIN (SELECT {FKC}, count(*) AS o FROM occ GROUP BY ALL) USING ({FKC}))""")))(
    lambda s: sinks.grid_meta_documents(occ.grid_meta(s.base, s.grid), "cm").select(*FK, "unit", "voxel_counts.*")
)
