"""DuckDB building blocks of the oracles: named CTEs with their dependencies.

They state the semantics cell by cell, without packing, tiles or runs, so they check
the Spark plans by a different route.
"""

from __future__ import annotations

import math

from catalog.scene import CONFIG
from catalog.views import duck

VS, PAD, YAWS, MIN_VOXELS = "CAST(5 AS DOUBLE)", "CAST(10 AS DOUBLE)", CONFIG.yaw_steps, CONFIG.min_surface_voxels
# Cross-shaped steps by which obstacles grow: the margin in whole voxels, rounded up.
STEPS = math.ceil(CONFIG.safety_margin / CONFIG.voxel_size)
STEP = "(CAST(5 AS DOUBLE) * CAST(0.5 AS DOUBLE))"
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    CTE[name] = (tuple(deps.split()), sql.strip())


def query(deps: str, final: str, surface: str | None = None) -> str:
    """WITH chain of ``deps`` and what they need, then ``final``; ``surface`` names the rows that replace the layer surface."""
    order: list[str] = []
    steps = CTE | {"surface": ((surface,), f"SELECT {SK}, i, j FROM {surface}")} if surface else CTE

    def visit(name):
        if name in order:
            return
        for need in steps[name][0]:
            visit(need)
        order.append(name)

    for name in deps.split():
        visit(name)
    parts = [f"{REC[n] if n in REC else n + ' AS MATERIALIZED'} (\n{steps[n][1]}\n)" for n in order]
    head = "WITH RECURSIVE " if any(n in REC for n in order) else "WITH "
    return head + ",\n".join(parts) + "\n" + final.strip()


REC: dict[str, str] = {}


def out(columns: str, source: str) -> str:
    """Final select: ``name`` text, ``name:i`` BIGINT, ``name:d`` rounded DOUBLE, ``name:b`` boolean."""
    items = []
    for c in columns.split():
        n, _, t = c.partition(":")
        if t == "i":
            items.append(f"CAST({n} AS BIGINT) AS {n}")
        elif t == "d":
            items.append(f"round(CAST({n} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {n}")
        else:
            items.append(n)
    return f"SELECT {', '.join(items)} FROM {source}"


FKC, OB = "scene_id, frame_id", "scene_id, frame_id, obj_id"
PZ = OB + ", yaw_idx"


def apply(m: str, p, translate=True):
    """Rows of matrix columns m0..m11 (row-major 3x4) times a point."""
    rows = []
    for r in range(3):
        t = f" + {m}{r * 4 + 3}" if translate else ""
        rows.append(f"({m}{r * 4} * {p[0]} + {m}{r * 4 + 1} * {p[1]} + {m}{r * 4 + 2} * {p[2]}{t})")
    return rows


def euler(cr, sr, cp, sp, cy, sy):
    return [
        f"{cy}*{cp}", f"{cy}*{sp}*{sr} - {sy}*{cr}", f"{cy}*{sp}*{cr} + {sy}*{sr}",
        f"{sy}*{cp}", f"{sy}*{sp}*{sr} + {cy}*{cr}", f"{sy}*{sp}*{cr} - {cy}*{sr}",
        f"-{sp}", f"{cp}*{sr}", f"{cp}*{cr}",
    ]


cte("px", "", duck("fx_depth_px"))
cte("cam_raw", "", duck("fx_camera"))
cte("cam", "cam_raw", f"""
SELECT {FKC}, fx, fy, cx, cy, img_w, img_h, {", ".join(f"pose[{n + 1}] AS c{n}" for n in range(12))},
       {", ".join(f"pose[{(n % 4) * 4 + n // 4 + 1}] AS w{n}" for n in range(12) if n % 4 < 3)},
       {", ".join(f"-(pose[{r + 1}] * pose[4] + pose[{4 + r + 1}] * pose[8] + pose[{8 + r + 1}] * pose[12]) AS w{r * 4 + 3}" for r in range(3))}
FROM cam_raw""")
_E = euler("t_cr", "t_sr", "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)", "t_cy", "t_sy")
cte("obj", "", f"""
SELECT {OB}, class_name, -sx / 2 AS lo0, -sy / 2 AS lo1, -sz / 2 AS lo2, sx / 2 AS hi0, sy / 2 AS hi1, sz / 2 AS hi2,
       {", ".join(f"{_E[r * 3 + c]} AS p{r * 4 + c}" for r in range(3) for c in range(3))},
       px AS p3, py AS p7, CASE WHEN roll_deg = 0 THEN sz / 2 ELSE sy / 2 END AS p11
FROM (SELECT *, cos(radians(roll_deg)) AS t_cr, sin(radians(roll_deg)) AS t_sr, cos(radians(yaw_deg)) AS t_cy, sin(radians(yaw_deg)) AS t_sy
      FROM ({duck("fx_boxes_posed")}))""")
_L = ("((u - cx) / fx * d)", "((v - cy) / fy * d)", "d")
_W = apply("c", _L)
cte("pts", "px cam", f"SELECT {FKC}, u, v, d, {_W[0]} AS x, {_W[1]} AS y, {_W[2]} AS z FROM px JOIN cam USING ({FKC}) WHERE d > 0")
cte("grid", "pts cam", f"""
SELECT {FKC}, min(x) - {PAD} AS ox, min(y) - {PAD} AS oy, min(z) - {PAD} AS oz,
       CAST(ceil((max(x) + {PAD} - (min(x) - {PAD})) / {VS}) AS INT) AS gx,
       CAST(ceil((max(y) + {PAD} - (min(y) - {PAD})) / {VS}) AS INT) AS gy,
       CAST(ceil((max(z) + {PAD} - (min(z) - {PAD})) / {VS}) AS INT) AS gz
FROM (SELECT {FKC}, x, y, z FROM pts UNION ALL SELECT {FKC}, c3, c7, c11 FROM cam) GROUP BY ALL""")


def vox(x, o):
    return f"CAST(floor(({x} - {o}) / {VS}) AS INT)"


IN_GRID = "i >= 0 AND i < gx AND j >= 0 AND j < gy AND k >= 0 AND k < gz"
cte("surf", "pts grid", f"""
SELECT DISTINCT {FKC}, i, j, k FROM (
  SELECT {FKC}, {vox("x", "ox")} AS i, {vox("y", "oy")} AS j, {vox("z", "oz")} AS k, gx, gy, gz FROM pts JOIN grid USING ({FKC})
) WHERE {IN_GRID}""")
cte("free0", "pts grid cam", f"""
SELECT DISTINCT {FKC}, i, j, k FROM (
  SELECT {FKC}, {vox("(c3 + dx * t)", "ox")} AS i, {vox("(c7 + dy * t)", "oy")} AS j, {vox("(c11 + dz * t)", "oz")} AS k, gx, gy, gz
  FROM (SELECT *, (x - c3) / len AS dx, (y - c7) / len AS dy, (z - c11) / len AS dz, unnest(range(0, CAST(ceil(len / {STEP}) AS BIGINT) + 1)) * {STEP} AS t
        FROM (SELECT *, sqrt((x - c3) * (x - c3) + (y - c7) * (y - c7) + (z - c11) * (z - c11)) AS len
              FROM pts JOIN grid USING ({FKC}) JOIN cam USING ({FKC})))
  WHERE t < len
) WHERE {IN_GRID}""")
cte("vox0", "surf free0", f"""
SELECT {FKC}, i, j, k, 1 AS state FROM surf UNION ALL
SELECT {FKC}, i, j, k, 0 FROM free0 ANTI JOIN surf USING ({FKC}, i, j, k)""")


def voxelize(source: str, key: str, m: str) -> str:
    """Voxel centres inside posed boxes of ``source`` (columns lo*, hi*, m0..m11)."""
    ranges = []
    for n, (axis, o, g, name) in enumerate(zip("xyz", ("ox", "oy", "oz"), ("gx", "gy", "gz"), "ijk")):
        c = " + ".join(f"{m}{n * 4 + a} * ((lo{a} + hi{a}) / 2)" for a in range(3)) + f" + {m}{n * 4 + 3}"
        e = " + ".join(f"abs({m}{n * 4 + a}) * ((hi{a} - lo{a}) / 2)" for a in range(3))
        ranges.append(f"greatest(CAST(floor((({c}) - ({e}) - {VS} - {o}) / {VS}) AS INT), 0) AS l{name}, "
                      f"least(CAST(ceil((({c}) + ({e}) + {VS} - {o}) / {VS}) AS INT), {g}) AS h{name}")
    inv_t = [f"-({m}{a} * {m}3 + {m}{4 + a} * {m}7 + {m}{8 + a} * {m}11)" for a in range(3)]
    centre = [f"(ox + (i + 0.5) * {VS})", f"(oy + (j + 0.5) * {VS})", f"(oz + (k + 0.5) * {VS})"]
    tests = []
    for a in range(3):
        v = f"({m}{a} * {centre[0]} + {m}{4 + a} * {centre[1]} + {m}{8 + a} * {centre[2]} + {inv_t[a]})"
        tests.append(f"{v} >= lo{a} AND {v} <= hi{a}")
    return f"""
SELECT {key}, i, j, k FROM (
 SELECT *, unnest(range(lk, hk)) AS k FROM (
  SELECT *, unnest(range(lj, hj)) AS j FROM (
   SELECT *, unnest(range(li, hi)) AS i FROM (
    SELECT *, {", ".join(ranges)} FROM {source} JOIN grid USING ({FKC})))))
WHERE {" AND ".join(tests)}"""


cte("own", "obj grid", voxelize("obj", OB, "p"))
cte("occ", "surf own", f"SELECT {FKC}, i, j, k FROM surf UNION SELECT {FKC}, i, j, k FROM own")
cte("free", "free0 occ", f"SELECT {FKC}, i, j, k FROM free0 ANTI JOIN occ USING ({FKC}, i, j, k)")
cte("others", "occ obj own", f"""
SELECT {OB}, i, j, k FROM occ JOIN (SELECT {OB} FROM obj) USING ({FKC}) ANTI JOIN own USING ({OB}, i, j, k)""")
_C = ("(ox + (i + 0.5) * 5)", "(oy + (j + 0.5) * 5)", "(oz + (k + 0.5) * 5)")
_P = apply("w", _C)
RINT_U = "CAST(greatest(0, least(img_w - 1, round_even({0}, 0))) AS INT)"
RINT_V = "CAST(greatest(0, least(img_h - 1, round_even({0}, 0))) AS INT)"
cte("zb", "others grid cam", f"""
SELECT {OB}, {RINT_U.format("pu")} AS u, {RINT_V.format("pv")} AS v, min(zc) AS z FROM (
  SELECT {OB}, img_w, img_h, zc, (fx * xc + cx * zc) / (CASE WHEN abs(zc) < 1e-8 THEN 1e-8 ELSE zc END) AS pu,
         (fy * yc + cy * zc) / (CASE WHEN abs(zc) < 1e-8 THEN 1e-8 ELSE zc END) AS pv
  FROM (SELECT {OB}, fx, fy, cx, cy, img_w, img_h, {_P[0]} AS xc, {_P[1]} AS yc, {_P[2]} AS zc
        FROM others JOIN grid USING ({FKC}) JOIN cam USING ({FKC})))
WHERE zc > 0 AND pu >= 0 AND pu < img_w AND pv >= 0 AND pv < img_h GROUP BY ALL""")
cte("corner", "", "SELECT CAST(n AS INT) AS corner FROM range(0, 8) t(n)")
_K = tuple(f"(CASE WHEN (corner & {1 << a}) = 0 THEN lo{a} ELSE hi{a} END)" for a in range(3))
_PC = [[" + ".join(f"w{r * 4 + k} * p{k * 4 + c}" for k in range(3)) for c in range(3)] for r in range(3)]
_PT = [f"(w{r * 4} * p3 + w{r * 4 + 1} * p7 + w{r * 4 + 2} * p11 + w{r * 4 + 3})" for r in range(3)]
cte("obj_cam", "obj cam", f"""
SELECT {OB}, lo0, lo1, lo2, hi0, hi1, hi2, fx, fy, cx, cy, img_w, img_h,
       {", ".join(f"{_PC[r][c]} AS q{r * 4 + c}" for r in range(3) for c in range(3))}, {", ".join(f"{_PT[r]} AS q{r * 4 + 3}" for r in range(3))}
FROM obj JOIN cam USING ({FKC})""")
_Q = apply("q", _K)
cte("visible", "obj_cam corner zb", f"""
SELECT {OB}, bool_and(inside) AS in_image, bool_and(inside) AND NOT bool_or(inside AND coalesce(cz > zb.z + 5, false)) AS visible
FROM (SELECT *, cz > 0 AND fu >= 0 AND fu < img_w AND fv >= 0 AND fv < img_h AS inside,
             {RINT_U.format("fu")} AS u, {RINT_V.format("fv")} AS v
      FROM (SELECT *, fx * lx / (CASE WHEN cz > 0 THEN cz ELSE 1 END) + cx AS fu, fy * ly / (CASE WHEN cz > 0 THEN cz ELSE 1 END) + cy AS fv
            FROM (SELECT {OB}, fx, fy, cx, cy, img_w, img_h, {_Q[0]} AS lx, {_Q[1]} AS ly, {_Q[2]} AS cz FROM obj_cam, corner)))
LEFT JOIN zb USING ({OB}, u, v) GROUP BY {OB}""")

# Surface: fullest OCCUPIED layer, without the target, opened 3x3.
cte("off9", "", "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM range(-1, 2) x(a), range(-1, 2) y(b)")
cte("peak", "occ", f"""
SELECT {FKC}, arg_max(k, n * 100000 - k) AS table_z, max(n) AS n_occupied FROM (SELECT {FKC}, k, count(*) AS n FROM occ GROUP BY ALL) GROUP BY ALL""")
cte("layer", "others peak", f"SELECT {OB}, table_z, i, j FROM others JOIN peak USING ({FKC}) WHERE k = table_z")


def eroded(source: str, key: str) -> str:
    return f"""
SELECT {key}, i, j FROM (SELECT {key}, i - a AS i, j - b AS j FROM {source}, off9) GROUP BY ALL HAVING count(*) = 9"""


def dilated(source: str, key: str) -> str:
    return f"""
SELECT DISTINCT {key}, i, j FROM (SELECT {key}, i + a AS i, j + b AS j FROM {source}, off9) JOIN grid USING ({FKC})
WHERE i >= 0 AND i < gx AND j >= 0 AND j < gy"""


SK = OB + ", table_z"
cte("layer_er", "layer off9", eroded("layer", SK))
cte("surface", "layer_er off9 grid", dilated("layer_er", SK))
cte("support", "surface off9", eroded("surface", SK))

# Yaw poses.
_TAU = f"CAST({2.0 * math.pi / YAWS!r} AS DOUBLE)"
_R = euler("cr", "sr", "cp", "sp", "cy", "sy")
_CW = apply("p", tuple(f"((lo{a} + hi{a}) / 2)" for a in range(3)))
cte("yaws", "", f"SELECT CAST(n AS INT) AS yaw_idx, n * {_TAU} AS yaw FROM range(0, {YAWS}) t(n)")
cte("poses", "obj yaws", f"""
SELECT {PZ}, yaw, keep, lo0, lo1, lo2, hi0, hi1, hi2, {", ".join(f"r{r * 4 + c}" for r in range(3) for c in range(3))},
       {", ".join(f"m{r} - ({' + '.join(f'r{r * 4 + a} * ((lo{a} + hi{a}) / 2)' for a in range(3))}) AS r{r * 4 + 3}" for r in range(3))}
FROM (SELECT *, {", ".join(f"CASE WHEN keep THEN {_R[r * 3 + c]} ELSE {z} END AS r{r * 4 + c}" for r, row in enumerate((("cy", "-sy", "0"), ("sy", "cy", "0"), ("0", "0", "1"))) for c, z in enumerate(row))}
      FROM (SELECT *, cos(yaw) AS cy, sin(yaw) AS sy FROM (
        SELECT {OB}, lo0, lo1, lo2, hi0, hi1, hi2, {", ".join(f"{w} AS m{n}" for n, w in enumerate(_CW))},
               greatest(abs(p8), abs(p9), abs(p10)) >= cos(radians(15)) AS keep,
               cos(e_roll) AS cr, sin(e_roll) AS sr, cos(e_pitch) AS cp, sin(e_pitch) AS sp
        FROM (SELECT *, CASE WHEN sqrt(p0 * p0 + p4 * p4) < 1e-6 THEN atan2(-p6, p5) ELSE atan2(p9, p10) END AS e_roll,
                     atan2(-p8, sqrt(p0 * p0 + p4 * p4)) AS e_pitch FROM obj)), yaws))""")
cte("yvox", "poses grid", voxelize("poses", PZ, "r"))
cte("shape", "yvox", f"""
SELECT {PZ}, vi, vj, vk, ext_i, ext_j, count(*) AS n_foot, avg(i - vi) AS mean_i, avg(j - vj) AS mean_j
FROM yvox JOIN (SELECT {PZ}, min(i) AS vi, min(j) AS vj, min(k) AS vk, max(i) - min(i) + 1 AS ext_i, max(j) - min(j) + 1 AS ext_j FROM yvox GROUP BY ALL)
USING ({PZ}) WHERE k = vk GROUP BY ALL""")
cte("region", "surface grid", f"""
SELECT {OB}, table_z, table_z + 1 AS landing_z, gx AS grid_x, gy AS grid_y, gz, greatest(min(i) - 5, 0) AS x0, greatest(min(j) - 5, 0) AS y0,
       least(max(i) + 6, gx) AS x1, least(max(j) + 6, gy) AS y1
FROM surface JOIN grid USING ({FKC}) GROUP BY {OB}, table_z, gx, gy, gz""")
cte("fits", "shape region", f"""
SELECT *, unnest(range(y0, y1 - ext_j + 1)) AS gy FROM (
 SELECT *, unnest(range(x0, x1 - ext_i + 1)) AS gx FROM shape JOIN region USING ({OB}))""")
# Obstacles grown by the margin: a free cell counts only while all cells of the diamond around it, inside the grid, are free.
DIAMOND = ", ".join(f"({a}, {b})" for a in range(-STEPS, STEPS + 1) for b in range(-STEPS, STEPS + 1) if 0 < abs(a) + abs(b) <= STEPS)
cte("free_m", "free grid", "SELECT * FROM free" if not STEPS else f"""
SELECT {FKC}, i, j, k FROM free ANTI JOIN (
 SELECT {FKC}, ci AS i, cj AS j, k FROM (
  SELECT {FKC}, i AS ci, j AS cj, k, i + a AS i, j + b AS j FROM free JOIN grid USING ({FKC}), (VALUES {DIAMOND}) n(a, b)
  WHERE i + a >= 0 AND i + a < gx AND j + b >= 0 AND j + b < gy) ANTI JOIN free USING ({FKC}, i, j, k)) USING ({FKC}, i, j, k)""")
cte("blocked", "fits yvox free_m", f"""
SELECT DISTINCT {PZ}, gx, gy FROM (
 SELECT f.scene_id, f.frame_id, f.obj_id, f.yaw_idx, f.gx, f.gy, f.gx + y.i - vi AS i, f.gy + y.j - vj AS j, landing_z + y.k - vk AS k, gz
 FROM fits f JOIN yvox y USING ({PZ})) ANTI JOIN free_m USING ({FKC}, i, j, k) WHERE k < gz""")
cte("cand", "fits blocked", f"SELECT {PZ}, gx, gy, table_z, landing_z FROM fits ANTI JOIN blocked USING ({PZ}, gx, gy)")
# The same without a margin.
cte("blocked_0", "fits yvox free", CTE["blocked"][1].replace("ANTI JOIN free_m USING", "ANTI JOIN free USING"))
cte("cand_0", "fits blocked_0", f"SELECT {PZ}, gx, gy FROM fits ANTI JOIN blocked_0 USING ({PZ}, gx, gy)")
cte("held", "cand yvox shape support", f"""
SELECT {PZ}, gx, gy, n_foot, count(*) AS held FROM (
 SELECT {PZ}, gx, gy, n_foot, gx + y.i - vi AS i, gy + y.j - vj AS j FROM cand JOIN shape USING ({PZ}) JOIN yvox y USING ({PZ}) WHERE y.k = vk)
JOIN support USING ({OB}, i, j) GROUP BY ALL""")
cte("com", "cand shape support", f"""
SELECT {PZ}, gx, gy FROM (SELECT {PZ}, gx, gy, CAST(round_even(gx + mean_i, 0) AS INT) AS i, CAST(round_even(gy + mean_j, 0) AS INT) AS j
 FROM cand JOIN shape USING ({PZ})) SEMI JOIN support USING ({OB}, i, j)""")
cte("stable", "held com", f"SELECT {PZ}, gx, gy FROM held SEMI JOIN com USING ({PZ}, gx, gy) WHERE held = n_foot")
_RC = [[" + ".join(f"w{r * 4 + k} * r{k * 4 + c}" for k in range(3)) for c in range(3)] for r in range(3)]
_RT = [f"(w{r * 4} * r3 + w{r * 4 + 1} * r7 + w{r * 4 + 2} * r11 + w{r * 4 + 3})" for r in range(3)]
cte("pose_cam", "poses cam shape region", f"""
SELECT {PZ}, lo0, lo1, lo2, hi0, hi1, hi2, fx, fy, cx, cy, img_w, img_h, vi, vj, (landing_z - vk) * 5 AS lift, w0, w1, w2, w4, w5, w6, w8, w9, w10,
       {", ".join(f"{_RC[r][c]} AS q{r * 4 + c}" for r in range(3) for c in range(3))}, {", ".join(f"{_RT[r]} AS q{r * 4 + 3}" for r in range(3))}
FROM poses JOIN cam USING ({FKC}) JOIN shape USING ({PZ}) JOIN region USING ({OB})""")
_S = [f"(w{r * 4} * ((gx - vi) * 5) + w{r * 4 + 1} * ((gy - vj) * 5) + w{r * 4 + 2} * lift)" for r in range(3)]


def placed_corners(source: str) -> str:
    return f"""
SELECT {PZ}, gx, gy, corner, cz, lx / (CASE WHEN cz > 0 THEN cz ELSE 1 END) * fx + cx AS fu, ly / (CASE WHEN cz > 0 THEN cz ELSE 1 END) * fy + cy AS fv, img_w, img_h
FROM (SELECT *, {", ".join(f"{q} + {s} AS {n}" for q, s, n in zip(_Q, _S, ("lx", "ly", "cz")))} FROM {source} JOIN pose_cam USING ({PZ}), corner)"""


cte("vis_corner", "stable pose_cam corner", placed_corners("stable"))
cte("in_view", "vis_corner", f"""
SELECT {PZ}, gx, gy FROM vis_corner GROUP BY ALL
HAVING bool_and(cz > 0 AND fu >= 0 AND fu < img_w AND fv >= 0 AND fv < img_h)""")
cte("kept", "in_view vis_corner zb", f"""
SELECT {PZ}, gx, gy FROM (
 SELECT {PZ}, gx, gy, cz, {RINT_U.format("fu")} AS u, {RINT_V.format("fv")} AS v FROM vis_corner SEMI JOIN in_view USING ({PZ}, gx, gy))
LEFT JOIN zb USING ({OB}, u, v) GROUP BY ALL HAVING count(CASE WHEN cz > 0 AND cz > zb.z + 5 THEN 1 END) / 8.0 <= 0.3""")
cte("radius", "shape obj", f"""
SELECT {OB}, CASE WHEN size IS NULL THEN CAST(25 AS DOUBLE) ELSE least(greatest(size * 0.5 * 5, 15), 60) END AS eps FROM (SELECT {OB} FROM obj)
LEFT JOIN (SELECT {OB}, CAST(median(greatest(ext_i, ext_j)) AS DOUBLE) AS size FROM shape GROUP BY ALL) USING ({OB})""")
LB = 2147483648


def components(name: str, source: str, key: str, link: str, extra: str = "") -> None:
    """Recursive min-label propagation over cells (key, i, j)."""
    names = [k.strip() for k in key.split(",")]
    cols = ", ".join(f"c.{n}" for n in names)
    on = " AND ".join(f"c.{n} = n.{n}" for n in names)
    CTE[name] = ((source,), f"""
 SELECT {key}, {extra}i, j, CAST(i AS BIGINT) * {LB} + j AS lab FROM {source}
 UNION
 SELECT {cols}, {"c.r2, " if extra else ""}c.i, c.j, min(n.lab) FROM {name} n JOIN recurring.{name} c ON {on} AND {link}
 WHERE n.lab < c.lab GROUP BY ALL""")
    REC[name] = f"{name}({key}, {'r2, ' if extra else ''}i, j, lab) USING KEY ({key}, i, j) AS"


cte("occ_cells", "occ", f"SELECT {FKC}, k, i, j FROM occ")
NEXT = "abs(c.i - n.i) + abs(c.j - n.j) = 1 AND c.i BETWEEN n.i - 1 AND n.i + 1"
components("cc_occ", "occ_cells", FKC + ", k", NEXT)
# Grid surface: opened, filled layers of every object's own view of the grid.
LK = OB + ", k"
cte("filled", "others", f"SELECT {LK} FROM others GROUP BY ALL HAVING count(*) >= {MIN_VOXELS}")
cte("fl_er", "others filled off9", eroded(f"(SELECT {LK}, i, j FROM others SEMI JOIN filled USING ({LK}))", LK))
cte("fl_open", "fl_er off9 grid", dilated("fl_er", LK))
components("cc_fl", "fl_open", LK, NEXT)
cte("comp_area", "cc_fl", f"SELECT {LK}, lab, count(*) AS area FROM cc_fl GROUP BY ALL HAVING count(*) >= {MIN_VOXELS}")
cte("own_col", "own", f"SELECT {OB}, i AS ti, j AS tj, min(k) AS k0, max(k) AS k1 FROM own GROUP BY ALL")
cte("comp_dist", "cc_fl own_col comp_area", f"""
SELECT {LK}, lab, min((i - ti) * (i - ti) + (j - tj) * (j - tj) + greatest(0, k0 - k, k - k1) * greatest(0, k0 - k, k - k1)) AS d2
FROM cc_fl SEMI JOIN comp_area USING ({LK}, lab) JOIN own_col USING ({OB}) GROUP BY ALL""")
cte("best", "comp_area comp_dist", f"""
SELECT {OB}, k AS table_z, lab, area, d2 FROM (
 SELECT *, row_number() OVER (PARTITION BY {OB} ORDER BY coalesce(d2, 1e18), area DESC, k, lab) AS rn
 FROM comp_area LEFT JOIN comp_dist USING ({LK}, lab)) WHERE rn = 1""")
# Fitted planes: three points drawn by MD5 for each plane, kept when near-horizontal, equal ones once.
RP = FKC + ", plane"
RK = OB + ", plane, table_z"
_DRAW = f"('0x' || substr(md5(concat_ws(':', '{CONFIG.ransac_seed}', {FKC}, plane, slot)), 1, 13))::BIGINT"
cte("rs_tri", "pts", f"""
SELECT {RP}, {", ".join(f"max({a}) FILTER (slot = {n}) AS {a}{n}" for n in range(3) for a in "xyz")}
FROM (SELECT {FKC}, plane, slot, {_DRAW} % total AS ordinal
      FROM (SELECT {FKC}, count(*) AS total FROM pts GROUP BY ALL HAVING count(*) >= 3), range({CONFIG.ransac_iterations}) p(plane), range(3) s(slot))
JOIN (SELECT {FKC}, x, y, z, row_number() OVER (PARTITION BY {FKC} ORDER BY v, u) - 1 AS ordinal FROM pts) USING ({FKC}, ordinal)
GROUP BY ALL HAVING count(DISTINCT ordinal) = 3""")
cte("rs_plane", "rs_tri", f"""
SELECT {FKC}, min(plane) AS plane, nx, ny, nz, e, arg_min(z0, plane) AS z_ref FROM (
 SELECT *, -(nx * x0 + ny * y0 + nz * z0) + CAST(0 AS DOUBLE) AS e FROM (
  SELECT {RP}, x0, y0, z0, {", ".join(f"c{a} * (CASE WHEN cz < 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END / norm) + CAST(0 AS DOUBLE) AS n{a}" for a in "xyz")} FROM (
   SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS norm FROM (
    SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS cx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS cy, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS cz
    FROM rs_tri))
  WHERE norm >= CAST(1e-8 AS DOUBLE) AND abs(cz) >= CAST({CONFIG.ransac_normal_z_min} AS DOUBLE) * norm))
GROUP BY {FKC}, nx, ny, nz, e""")
cte("rs_vox", "pts grid rs_plane", f"""
SELECT {RP}, i, j, k, {IN_GRID} AS inside, count(*) AS n, sum(z - z_ref) AS s1, sum((z - z_ref) * (z - z_ref)) AS s2 FROM (
 SELECT {FKC}, x, y, z, {vox("x", "ox")} AS i, {vox("y", "oy")} AS j, {vox("z", "oz")} AS k, gx, gy, gz FROM pts JOIN grid USING ({FKC}))
JOIN rs_plane USING ({FKC}) WHERE abs(x * nx + y * ny + z * nz + e) <= CAST(7.5 AS DOUBLE) GROUP BY ALL""")
# The median of the points' layers, from counts for each layer: the mean of the two middle ones.
cte("rs_mid", "rs_vox", f"""
SELECT {RP}, CAST(floor((min(k) FILTER (upto > (total - 1) // 2) + min(k) FILTER (upto > total // 2)) / CAST(2 AS DOUBLE)) AS INT) AS table_z FROM (
 SELECT {RP}, k, sum(n) OVER (PARTITION BY {RP} ORDER BY k) AS upto, sum(n) OVER (PARTITION BY {RP}) AS total
 FROM (SELECT {RP}, k, CAST(sum(n) AS BIGINT) AS n FROM rs_vox WHERE inside GROUP BY ALL)) GROUP BY ALL""")
cte("rs_stat", "rs_vox rs_mid", f"""
SELECT {RP}, table_z, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), CAST(0 AS DOUBLE))) / {VS} AS z_spread FROM (
 SELECT {RP}, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(n) FILTER (inside) AS valid FROM rs_vox GROUP BY ALL) JOIN rs_mid USING ({RP})
WHERE valid >= {MIN_VOXELS}""")
cte("rs_occ", "rs_vox rs_stat occ", f"""
SELECT * FROM (SELECT {RP}, table_z, i, j, k, n, sum(n) OVER (PARTITION BY {RP}) AS near_n FROM rs_vox JOIN rs_stat USING ({RP}) WHERE inside AND abs(k - table_z) <= 1)
SEMI JOIN occ USING ({FKC}, i, j, k) WHERE near_n >= {MIN_VOXELS}""")
cte("rs_left", "rs_occ obj own", f"""
SELECT {RK}, i, j, n FROM rs_occ JOIN (SELECT {OB} FROM obj) USING ({FKC}) ANTI JOIN own USING ({OB}, i, j, k)""")
cte("rs_mask", "rs_left", f"""
SELECT DISTINCT {RK}, i, j FROM rs_left SEMI JOIN (SELECT {RK} FROM rs_left GROUP BY ALL HAVING sum(n) >= {MIN_VOXELS}) USING ({RK})""")
cte("rs_cd", "rs_mask off9 grid", dilated("rs_mask", RK))
cte("rs_ce", "rs_cd off9", eroded("rs_cd", RK))
cte("rs_oe", "rs_ce off9", eroded("rs_ce", RK))
cte("rs_od", "rs_oe off9 grid", dilated("rs_oe", RK))
# Row runs of cells stand for their cells while labels spread.
cte("rs_run", "rs_od", f"""
SELECT {RK}, i, min(j) AS a, max(j) AS b FROM (SELECT *, j - row_number() OVER (PARTITION BY {RK}, i ORDER BY j) AS island FROM rs_od) GROUP BY {RK}, i, island""")
_ON = " AND ".join(f"c.{n} = n.{n}" for n in RK.split(", "))
CTE["rs_cr"] = (("rs_run",), f"""
 SELECT {RK}, i, a, b, CAST(i AS BIGINT) * {LB} + a AS lab FROM rs_run
 UNION
 SELECT {", ".join(f"c.{n}" for n in RK.split(", "))}, c.i, c.a, c.b, min(n.lab) FROM
  (SELECT *, unnest([i - 1, i + 1]) AS to_i FROM rs_cr) n JOIN recurring.rs_cr c ON {_ON} AND c.i = n.to_i AND c.a <= n.b AND n.a <= c.b
 WHERE n.lab < c.lab GROUP BY ALL""")
REC["rs_cr"] = f"rs_cr({RK}, i, a, b, lab) USING KEY ({RK}, i, a) AS"
cte("rs_cc", "rs_cr", f"SELECT {RK}, i, unnest(range(a, b + 1)) AS j, lab FROM rs_cr")
cte("rs_area", "rs_cc", f"SELECT {RK}, lab, count(*) AS area FROM rs_cc GROUP BY ALL HAVING count(*) >= {MIN_VOXELS}")
cte("rs_dist", "rs_cc own_col rs_area", f"""
SELECT {RK}, lab, min((i - ti) * (i - ti) + (j - tj) * (j - tj) + greatest(0, k0 - table_z, table_z - k1) * greatest(0, k0 - table_z, table_z - k1)) AS d2
FROM rs_cc SEMI JOIN rs_area USING ({RK}, lab) JOIN own_col USING ({OB}) GROUP BY ALL""")
cte("rs_best", "rs_area rs_dist rs_stat", f"""
SELECT {RK}, lab, area, d2 FROM (
 SELECT *, row_number() OVER (PARTITION BY {OB} ORDER BY coalesce(d2, 1e18), round(area - z_spread, 6) DESC, area DESC, table_z, plane, lab) AS rn
 FROM rs_area LEFT JOIN rs_dist USING ({RK}, lab) JOIN rs_stat USING ({RP}, table_z)) WHERE rn = 1""")
cte("rs_cells", "rs_best rs_cc best cc_fl", f"""
SELECT {OB}, table_z, i, j FROM rs_cc SEMI JOIN rs_best USING ({RK}, lab) UNION ALL
SELECT {OB}, table_z, i, j FROM (SELECT * FROM best ANTI JOIN rs_best USING ({OB})) b JOIN cc_fl c USING ({OB}, lab) WHERE c.k = b.table_z""")
# Clusters of the kept candidates (every point is a core point).
cte("kept_cells", "kept radius", f"SELECT DISTINCT {OB}, (eps / 5) * (eps / 5) AS r2, gx AS i, gy AS j FROM kept JOIN radius USING ({OB})")
components("cc_db", "kept_cells", OB, "(c.i - n.i) * (c.i - n.i) + (c.j - n.j) * (c.j - n.j) <= c.r2", "r2, ")
cte("clu", "cc_db kept", f"""
SELECT {PZ}, gx, gy, dense_rank() OVER (PARTITION BY {OB} ORDER BY first_pos) - 1 AS cluster_id FROM (
 SELECT *, min(CAST(yaw_idx AS BIGINT) * 100000000 + gx * 10000 + gy) OVER (PARTITION BY {OB}, lab) AS first_pos
 FROM kept JOIN (SELECT {OB}, i AS gx, j AS gy, lab FROM cc_db) USING ({OB}, gx, gy))""")
cte("rep", "clu", f"""
SELECT {OB}, cluster_id, size, used_original_yaw, yaw_idx, gx, gy, sqrt(d2) AS centroid_cells FROM (
 SELECT *, row_number() OVER (PARTITION BY {OB}, cluster_id ORDER BY d2, yaw_idx, gx, gy) AS rn FROM (
  SELECT *, round((gx - mx) * (gx - mx) + (gy - my) * (gy - my), 9) AS d2 FROM (
   SELECT *, avg(gx) OVER w AS mx, avg(gy) OVER w AS my FROM (
    SELECT *, count(*) OVER (PARTITION BY {OB}, cluster_id) AS size, bool_or(yaw_idx = 0) OVER (PARTITION BY {OB}, cluster_id) AS used_original_yaw FROM clu)
   WHERE yaw_idx = 0 OR NOT used_original_yaw WINDOW w AS (PARTITION BY {OB}, cluster_id)))) WHERE rn = 1""")
cte("ranked", "rep", f'SELECT *, row_number() OVER (PARTITION BY {OB} ORDER BY size DESC, cluster_id) - 1 AS "rank" FROM rep')
cte("placed", "ranked poses shape region", f"""
SELECT {OB}, "rank", centroid_cells, yaw_idx, yaw, lo0, lo1, lo2, hi0, hi1, hi2, {", ".join(f"r{r * 4 + c}" for r in range(3) for c in range(3))},
       r3 + (gx - vi) * 5 AS r3, r7 + (gy - vj) * 5 AS r7, r11 + (landing_z - vk) * 5 AS r11
FROM ranked JOIN poses USING ({PZ}) JOIN shape USING ({PZ}) JOIN region USING ({OB})""")
_PB = apply("r", tuple(f"((lo{a} + hi{a}) / 2)" for a in range(3)))
_EX = [" + ".join(f"abs(r{n * 4 + a}) * ((hi{a} - lo{a}) / 2)" for a in range(3)) for n in range(3)]
cte("placed_box", "placed", f"""
SELECT {OB}, "rank", centroid_cells, yaw, {", ".join(f"{_PB[n]} AS ctr{n}, {_PB[n]} - ({_EX[n]}) AS alo{n}, {_PB[n]} + ({_EX[n]}) AS ahi{n}" for n in range(3))} FROM placed""")
