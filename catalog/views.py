"""Input views of the registered queries, over the whole given tables.

One SQL text serves both engines; ``{name}`` stands for a table and the few dialect
differences are named below. See FIXTURES.md for the shapes they carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {
        "STR": "STRING", "ARR": "array(", "END": ")",
        "EACH": "LATERAL VIEW explode(sequence(0, CAST(ceil(size(embedding) / 3) AS INT) - 1)) t AS point",
        **{f"E{n}": f"coalesce(get(embedding, 3 * point + {n}), 0)" for n in range(3)},
    },
    "duckdb": {
        "STR": "VARCHAR", "ARR": "[", "END": "]",
        "EACH": ", LATERAL (SELECT unnest(range(0, CAST(ceil(len(embedding) / 3e0) AS INT))) AS point) t",
        **{f"E{n}": f"coalesce(embedding[3 * point + {n + 1}], 0)" for n in range(3)},
    },
}

# Orders per frame; a frame then holds about 5,000 pixels and 8 objects at every scale.
FRAME = "CAST(floor(l_orderkey / 1250) AS INT)"
OBJ_FRAME = "CAST(floor(s_suppkey * 3 / 25) AS INT)"


def _frame_key(frame: str) -> str:
    return (
        f"concat('scene_', lpad(CAST(CAST(floor({frame} / 3) AS INT) AS <STR>), 4, '0')) AS scene_id, "
        f"lpad(CAST(({frame} % 3) * 5 AS <STR>), 4, '0') AS frame_id"
    )


U = "CAST((l_orderkey * 7 + l_linenumber * 131) % 640 AS INT)"
V = "CAST((l_orderkey * 11 + l_linenumber * 53 + l_suppkey) % 480 AS INT)"

RAW = {
    "fx_depth_px": f"""
SELECT {_frame_key(FRAME)}, {U} AS u, {V} AS v,
       MIN(CASE WHEN l_discount = 0 AND l_tax = 0 THEN CAST(0 AS DOUBLE)
                WHEN {U} BETWEEN 80 AND 199 AND {V} BETWEEN 80 AND 199 THEN CAST(90 AS DOUBLE)
                ELSE CAST(100 AS DOUBLE) END) AS d
FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    "fx_camera": f"""
SELECT DISTINCT {_frame_key(FRAME)}, CAST(320 AS DOUBLE) AS fx, CAST(320 AS DOUBLE) AS fy,
       CAST(320 AS DOUBLE) AS cx, CAST(240 AS DOUBLE) AS cy, 640 AS img_w, 480 AS img_h,
       <ARR>{", ".join(f"CAST({x} AS DOUBLE)" for x in (1, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1, 100, 0, 0, 0, 1))}<END> AS pose
FROM {{lineitem}}""",
    "fx_boxes_posed": f"""
SELECT {_frame_key(OBJ_FRAME)}, concat('obj_', CAST(s_suppkey % 25 AS <STR>)) AS obj_id, lower(n_name) AS class_name,
       CAST(10.37 AS DOUBLE) + (s_suppkey * 7) % 15 AS sx, CAST(10.41 AS DOUBLE) + (s_suppkey * 5) % 11 AS sy,
       CAST(10.43 AS DOUBLE) + (s_suppkey * 3) % 7 AS sz,
       CAST((s_suppkey * 37) % 120 - 60 AS DOUBLE) AS px, CAST((s_suppkey * 23) % 90 - 45 AS DOUBLE) AS py,
       CASE WHEN s_suppkey % 5 = 4 THEN CAST(40 AS DOUBLE) WHEN s_suppkey % 5 = 3 THEN CAST(90 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS roll_deg,
       CAST((s_suppkey * 15) % 360 AS DOUBLE) AS yaw_deg
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "fx_frame_log": """
SELECT event_id, ts, concat('scene_', lpad(CAST(user_id AS <STR>), 5, '0')) AS scene_id,
       lpad(CAST((event_id % 2) * 5 AS <STR>), 4, '0') AS frame_id,
       CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed'
            WHEN 'signup' THEN (CASE WHEN value < 5 THEN 'cleared' ELSE 'completed' END) ELSE 'output' END AS state,
       CASE WHEN event_type = 'error' THEN concat('code ', CAST(event_id % 7 AS <STR>)) END AS reason,
       CASE WHEN event_type IN ('view', 'purchase')
            THEN CAST(floor(event_id / 10) AS INT) % (CASE WHEN user_id % 10 = 9 THEN 5 ELSE 6 END) END AS output_slot
FROM {events}""",
    "fx_samples": """
SELECT concat('out_', CAST(l_suppkey % 2 AS <STR>)) AS source_dir,
       concat('scene', lpad(CAST(l_suppkey AS <STR>), 6, '0')) AS scene_id,
       lpad(CAST((l_orderkey % 8) * 10 AS <STR>), 6, '0') AS frame_id,
       concat('obj_', CAST(l_linenumber AS <STR>)) AS object_id,
       concat(CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END, lower(p_type), '-', p_name, ' ') AS class_name_raw,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_boxes": """
SELECT l_orderkey AS sample_key, l_linenumber AS k, l_partkey AS part_key, lower(p_type) AS class_name, l_extendedprice AS score,
       CAST(l_quantity AS DOUBLE) AS p_cx, CAST(l_linenumber AS DOUBLE) AS p_cy, CAST(0 AS DOUBLE) AS p_cz,
       CAST(10 + p_size AS DOUBLE) AS p_l, CAST(20 AS DOUBLE) AS p_w, CAST(10 AS DOUBLE) AS p_h,
       l_quantity + l_discount * 100 AS g_cx, l_linenumber + l_tax * 50 AS g_cy, CAST(1 AS DOUBLE) AS g_cz,
       CAST(12 + p_size AS DOUBLE) AS g_l, CAST(18 AS DOUBLE) AS g_w, CAST(11 AS DOUBLE) AS g_h
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # Every vector unfolds into consecutive triples, one point each; the last, incomplete one is filled with zeros.
    "fx_points": """
SELECT vec_id, point, label AS cluster_id, CAST(<E0> AS DOUBLE) * 100 AS x, CAST(<E1> AS DOUBLE) * 100 AS y,
       CAST(<E2> AS DOUBLE) * 100 AS z FROM {embeddings} <EACH>""",
    "fx_mask_px": f"""
SELECT DISTINCT {_frame_key(FRAME)}, {U} AS u, {V} AS v, concat('mask_', CAST(l_partkey % 3 AS <STR>)) AS mask_id
FROM {{lineitem}} WHERE l_quantity < 25""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def sql_text(name: str, dialect: str) -> str:
    text = RAW[name]
    for mark, value in DIALECT[dialect].items():
        text = text.replace(f"<{mark}>", value)
    return text


def duck(name: str) -> str:
    """View text for DuckDB with the plain table names."""
    text = sql_text(name, "duckdb")
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text.strip()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """View as a DataFrame; only the tables it names are read."""
    text = sql_text(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
