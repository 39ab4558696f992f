"""Statistics, batch state, box evaluation and point cloud queries, with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.oracle_cte import out
from catalog.tidy import tidy
from catalog.views import duck, load
from scenesift.functions import boxes as bx
from scenesift.functions import names
from scenesift.operators import batch_state as bs
from scenesift.operators import evaluation as ev
from scenesift.operators import points as pts
from scenesift.operators import stats as st
from scenesift.operators.points import FK
from scenesift.sources import samples as smp

QUERIES, ORACLES = {}, {}


def view_query(name, view, oracle=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(load(spark, sf_dir, view)))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# ---- samples -----------------------------------------------------------------------

PATH = "concat(source_dir, '/samples/', scene_id, '_', frame_id, '.json')"


def samples(df):
    """View rows as statistics input: document path, position, normalised category."""
    return df.select(
        F.concat("source_dir", F.lit("/samples/"), "scene_id", F.lit("_"), "frame_id", F.lit(".json")).alias("path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "source_dir", "scene_id", "frame_id",
        names.object_or_default(F.col("object_id")).alias("object_id"), names.category_normalize(F.col("class_name_raw")).alias("category"),
    )


def files(df):
    return samples(df).groupBy("path", "source_dir", "scene_id").agg(F.count(F.lit(1)).alias("n_samples"))


def mapping(df):
    """Categories of the LARGE and SMALL types merge into their type."""
    kind = F.split(names.category_normalize(F.col("class_name_raw")), "-")[0]
    return df.select(names.category_normalize(F.col("class_name_raw")).alias("category"), kind.alias("merged")).filter(
        F.col("merged").isin("large", "small")
    ).distinct()


S = f"""s AS (SELECT {PATH} AS path, l_orderkey * 8 + l_linenumber AS pos, source_dir, scene_id, frame_id, object_id, trim(class_name_raw) AS category
 FROM ({duck("fx_samples")})),
cs AS (SELECT *, sample_count / sum(sample_count) OVER () AS ratio FROM (
  SELECT category, count(*) AS sample_count, count(DISTINCT concat(scene_id, '|', frame_id, '|', object_id)) AS object_count,
         count(DISTINCT scene_id) AS scene_count, min(concat(path, '#', lpad(CAST(pos AS VARCHAR), 12, '0'))) AS first_seen FROM s GROUP BY 1)),
mp AS (SELECT DISTINCT category, split_part(category, '-', 1) AS merged FROM s WHERE split_part(category, '-', 1) IN ('large', 'small')),
mg AS (SELECT *, sample_count / sum(sample_count) OVER () AS ratio FROM (
  SELECT coalesce(merged, category) AS category, sum(sample_count) AS sample_count, sum(object_count) AS object_count, sum(scene_count) AS scene_count
  FROM cs LEFT JOIN mp USING (category) GROUP BY 1)),
sd AS (SELECT scene_id, count(*) AS sample_count FROM s GROUP BY 1)"""
CAT = "category sample_count:i object_count:i scene_count:i ratio:d"
FIVE = ["category", "sample_count", "object_count", "scene_count", "ratio"]


def sam(name, final, fn):
    view_query(name, "fx_samples", f"WITH {S}\n{final}")(fn)


def stats_of(df):
    return st.category_stats(samples(df))


def merged_of(df):
    return st.merge_categories(stats_of(df), mapping(df))


sam("category_stats", out(CAT, "cs"), lambda d: stats_of(d).select(*FIVE))
sam("stats_overview", out("total_scenes:i total_categories:i total_samples:i source_file_count:i avg_samples_per_scene:d", """(
 SELECT count(DISTINCT scene_id) AS total_scenes, count(DISTINCT category) AS total_categories, count(*) AS total_samples,
        count(DISTINCT path) AS source_file_count, count(*) / count(DISTINCT scene_id) AS avg_samples_per_scene FROM s)"""),
    lambda d: st.stats_overview(files(d), samples(d)))
sam("scene_distribution", out("scene_id sample_count:i", "sd"), lambda d: st.scene_distribution(samples(d)))
sam("count_samples", out("source_dir n_samples:i", "(SELECT source_dir, count(*) AS n_samples FROM s GROUP BY ROLLUP (source_dir))"), lambda d: st.count_samples(files(d)))
sam("merge_categories", out(CAT, "mg"), merged_of)
sam("merge_summary", out("merged_category_count:i total_samples:i", "(SELECT count(*) AS merged_category_count, sum(sample_count) AS total_samples FROM mg)"),
    lambda d: st.merge_summary(merged_of(d)))
sam("full_mapping", "SELECT category, coalesce(merged, category) AS merged FROM cs LEFT JOIN mp USING (category)", lambda d: st.full_mapping(stats_of(d), mapping(d)))
sam("scene_hist", f""", r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi, bins
  FROM (SELECT CAST(min(sample_count) AS DOUBLE) AS lo, CAST(max(sample_count) AS DOUBLE) AS hi, greatest(1, least(20, count(DISTINCT sample_count))) AS bins FROM sd)),
 e AS (SELECT bin, lo + bin * ((hi - lo) / bins) AS low, CASE WHEN bin = bins - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / bins) END AS high, bin = bins - 1 AS last
  FROM (SELECT *, unnest(range(0, bins)) AS bin FROM r))
 {out("bin:i low:d high:d n_scenes:i", "(SELECT bin, low, high, count(scene_id) AS n_scenes FROM e LEFT JOIN sd ON sample_count >= low AND (sample_count < high OR (last AND sample_count <= high)) GROUP BY 1, 2, 3)")}""",
    lambda d: st.scene_hist(st.scene_distribution(samples(d))))
sam("top_categories", out(CAT, "(SELECT * FROM cs ORDER BY sample_count DESC, first_seen LIMIT 20)"), lambda d: st.top_categories(stats_of(d), 20).select(*FIVE))
sam("category_topk_others", out("label size:i", """(
 SELECT CASE WHEN rn <= 10 THEN category ELSE 'others' END AS label, sum(sample_count) AS size FROM (
  SELECT *, row_number() OVER (ORDER BY sample_count DESC, first_seen) AS rn FROM cs) GROUP BY 1)"""), lambda d: st.category_topk_others(stats_of(d), 10))
sam("merged_boxplot", f""", q AS (SELECT quantile_cont(CAST(sample_count AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(sample_count AS DOUBLE), 0.5) AS median, quantile_cont(CAST(sample_count AS DOUBLE), 0.75) AS q3 FROM mg)
 {out("q1:d median:d q3:d whisker_low:d whisker_high:d n_outliers:i outlier_sum:d", '''(
 SELECT q1, median, q3, least(min(CASE WHEN v >= lo THEN v END), q1) AS whisker_low, greatest(max(CASE WHEN v <= hi THEN v END), q3) AS whisker_high,
        count(CASE WHEN v < lo OR v > hi THEN 1 END) AS n_outliers, sum(CASE WHEN v < lo OR v > hi THEN v END) AS outlier_sum
 FROM (SELECT *, CAST(sample_count AS DOUBLE) AS v, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM mg, q) GROUP BY q1, median, q3)''')}""",
    lambda d: st.merged_boxplot(merged_of(d)))
sam("boxplot_outliers", f""", q AS (SELECT quantile_cont(CAST(sample_count AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(sample_count AS DOUBLE), 0.75) AS q3 FROM mg)
 {out(CAT, "(SELECT mg.* FROM mg, q WHERE sample_count < q1 - (q3 - q1) * 1.5 OR sample_count > q3 + (q3 - q1) * 1.5)")}""",
    lambda d: st.boxplot_outliers(merged_of(d)))


def with_ids(df):
    """Samples with an id of their own: rows that share path and position are numbered by what they hold."""
    nth = F.row_number().over(Window.partitionBy("path", "pos").orderBy("category", "object_id"))
    s = samples(df).withColumn("pos", F.col("pos") * 1000 + nth)
    return s.withColumn("sample_id", F.concat("path", F.lit("#"), F.lpad(F.col("pos").cast("string"), 15, "0")))


sam("limit_samples", """, n AS (SELECT path, category, pos * 1000 + row_number() OVER (PARTITION BY path, pos ORDER BY category, object_id) AS pos FROM s),
 w AS (SELECT concat(path, '#', lpad(CAST(pos AS VARCHAR), 15, '0')) AS sample_id, * FROM n)
 SELECT sample_id, category FROM w WHERE category NOT LIKE 'large%' ORDER BY path, pos LIMIT 50""",
    lambda d: st.limit_samples(with_ids(d), with_ids(d).filter(F.col("category").startswith("large")), 50).select("sample_id", "category"))
sam("sink_stats", """, o AS (SELECT *, row_number() OVER (ORDER BY sample_count DESC, first_seen) AS rn FROM cs)
 SELECT 0::BIGINT AS line_no, printf('total_scenes: %d', count(DISTINCT scene_id)) AS line FROM s UNION ALL
 SELECT 1, printf('total_categories: %d', count(DISTINCT category)) FROM s UNION ALL SELECT 2, printf('total_samples: %d', count(*)) FROM s UNION ALL
 SELECT 3, printf('source_file_count: %d', count(DISTINCT path)) FROM s UNION ALL
 SELECT 4, printf('avg_samples_per_scene: %.2f', count(*) / count(DISTINCT scene_id)) FROM s UNION ALL SELECT 5, 'Top 10' UNION ALL
 SELECT rn + 5, printf('%s: samples=%d, objects=%d, scenes=%d, ratio=%.2f%%', category, sample_count, object_count, scene_count, ratio * 100) FROM o WHERE rn <= 10""",
    lambda d: st.summary_lines(st.stats_overview(files(d), samples(d)), stats_of(d), 10))
view_query("category_normalize", "fx_samples", f"SELECT DISTINCT class_name_raw, trim(class_name_raw) AS category FROM ({duck('fx_samples')})")(
    lambda d: d.select("class_name_raw", names.category_normalize(F.col("class_name_raw")).alias("category")).distinct())
_RAWNAME = "concat('.', scene_id, '/', class_name_raw, '#', object_id, '_')"
view_query("name_clean", "fx_samples", f"""
SELECT DISTINCT raw, CASE WHEN c = '' THEN 'item' ELSE c END AS clean FROM (
 SELECT raw, trim(regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS c FROM (SELECT {_RAWNAME} AS raw FROM ({duck('fx_samples')})))""")(
    lambda d: d.select(F.concat(F.lit("."), "scene_id", F.lit("/"), "class_name_raw", F.lit("#"), "object_id", F.lit("_")).alias("raw")).distinct()
    .select("raw", names.name_clean(F.col("raw")).alias("clean")))
view_query("sample_id", "fx_samples", f"""
SELECT DISTINCT scene_id, frame_id, object_id, CAST(l_linenumber AS BIGINT) AS "rank", concat(scene_id, '_', frame_id, '_', object_id, '_p', lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) AS sample_id
FROM ({duck('fx_samples')})""")(
    lambda d: d.select("scene_id", "frame_id", "object_id", F.col("l_linenumber").alias("rank"), names.sample_id(F.col("scene_id"), F.col("frame_id"), F.col("object_id"), F.col("l_linenumber")).alias("sample_id")).distinct())
_SLOTS = ", ".join(f"({n}, '{d}_{s[1:]}', '{d}/', '{s}')" for n, d, s in names.CORE_OUTPUTS)
view_query("output_keys", "fx_samples", f"""
SELECT scene_id, frame_id, CAST(slot AS BIGINT) AS slot, kind, concat(dir, scene_id, '_', frame_id, suffix) AS path
FROM (SELECT DISTINCT scene_id, frame_id FROM ({duck('fx_samples')})), (VALUES {_SLOTS}) t(slot, kind, dir, suffix)""")(
    lambda d: d.select(*FK).distinct().select(*FK, F.explode(names.output_keys(F.col("scene_id"), F.col("frame_id"))).alias("o")).select(*FK, "o.*"))
view_query("infer_frame_keys", "fx_samples", f"""
SELECT DISTINCT stem, CASE WHEN given <> '' THEN given WHEN stem LIKE 'scene\\_%' ESCAPE '\\' THEN concat('scene_', split_part(stem, '_', 2)) ELSE stem END AS scene_id,
 CASE WHEN stem LIKE 'scene\\_%\\_%' ESCAPE '\\' THEN split_part(stem, '_', -1) ELSE stem END AS frame_id
FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN concat('scene_', l_suppkey, '_', frame_id) ELSE concat(scene_id, '_', frame_id) END AS stem,
             CASE WHEN l_linenumber % 3 = 0 THEN scene_id ELSE '' END AS given FROM ({duck('fx_samples')}))""")(
    lambda d: d.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("scene_"), "l_suppkey", F.lit("_"), "frame_id")).otherwise(F.concat("scene_id", F.lit("_"), "frame_id")).alias("stem"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("scene_id")).otherwise(F.lit("")).alias("given"),
    ).select("stem", names.infer_scene_id(F.col("given"), F.col("stem")).alias("scene_id"), names.infer_frame_id(F.lit(None).cast("string"), F.col("stem")).alias("frame_id")).distinct())


def documents(d):
    """Nested documents, as a samples reader returns them."""
    rows = samples(d)
    return rows.groupBy("path", "source_dir", "scene_id", "frame_id").agg(F.collect_list(F.struct(F.col("object_id"), F.col("category").alias("class_name"), "pos")).alias("samples"))


sam("flatten_samples", out("path object_id class_name n:i", "(SELECT path, object_id, category AS class_name, count(*) AS n FROM s GROUP BY ALL)"),
    lambda d: smp.flatten_samples(documents(d)).groupBy("path", "object_id", "class_name").agg(F.count(F.lit(1)).alias("n")))


def texts(d):
    """Document texts as files would hold them: odd types in fields, missing and null fields, and some broken files."""
    score = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" 3.0")).when(F.col("l_linenumber") % 3 == 1, F.lit("\"high\"")).otherwise(F.lit("null"))
    name = F.to_json(F.struct(F.col("class_name_raw").alias("class_name")))
    inner = F.concat(F.expr("substring(n, 1, length(n) - 1)"), F.lit(", \"object_id\": "), "l_linenumber", F.lit(", \"free_space_score\": "), "score", F.lit("}"))
    rows = d.withColumns({"score": score, "n": name}).withColumn("text", F.when(F.col("l_linenumber") == 7, F.lit("{}")).otherwise(inner))
    path = F.concat("source_dir", F.lit("/samples/"), "scene_id", F.lit("_"), "frame_id", F.lit(".json"))
    whole = F.concat(F.lit("{\"unit\": 1, \"samples\": ["), F.array_join(F.collect_list("text"), ", "), F.lit("]"))
    files = rows.groupBy(path.alias("path"), "source_dir", "scene_id", "frame_id").agg(whole.alias("open"))
    broken = (F.col("frame_id") == "000070") & (F.col("source_dir") == "out_1")
    return files.select("path", "source_dir", F.concat("scene_id", F.lit("_"), "frame_id").alias("stem"), F.concat("open", F.when(broken, F.lit("")).otherwise(F.lit("}"))).alias("value"))


sam("scan_samples", out("source_dir scene_id category object_id n:i scored:i", """(
 SELECT source_dir, concat(scene_id, '_', frame_id) AS scene_id, CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE trim(class_name_raw) END AS category,
  CASE WHEN l_linenumber = 7 THEN 'unknown_object' ELSE CAST(l_linenumber AS VARCHAR) END AS object_id, count(*) AS n, count(CASE WHEN l_linenumber <> 7 AND l_linenumber % 3 = 0 THEN 1 END) AS scored
 FROM (""" + duck("fx_samples") + """) WHERE NOT (frame_id = '000070' AND source_dir = 'out_1') GROUP BY ALL)"""),
    lambda d: smp.infer_frame_keys(smp.parse_documents(texts(d))).select("source_dir", "scene_id", F.explode("samples").alias("s")).groupBy(
        "source_dir", "scene_id", names.category_normalize(F.col("s.class_name")).alias("category"), names.object_or_default(F.col("s.object_id")).alias("object_id"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count("s.free_space_score").alias("scored")))
sam("skipped_documents", """SELECT source_dir, count(CASE WHEN NOT broken THEN 1 END) AS n_documents, count(CASE WHEN broken THEN 1 END) AS n_skipped
 FROM (SELECT DISTINCT source_dir, path, frame_id = '000070' AND source_dir = 'out_1' AS broken FROM s) GROUP BY ALL""",
    lambda d: smp.skipped_documents(texts(d)))

# ---- batch state -------------------------------------------------------------------

LOG = duck("fx_frame_log")
B = f"""l AS ({LOG}),
f AS (SELECT scene_id, frame_id, m.state AS state, m.reason AS reason, slots AS n_outputs, slots = 6 AS is_complete FROM (
 SELECT scene_id, frame_id, max(CASE WHEN state <> 'output' THEN struct_pack(ts := ts, event_id := event_id, state := state, reason := reason) END) AS m,
        count(DISTINCT output_slot) AS slots FROM l GROUP BY ALL)),
fl AS (SELECT scene_id, frame_id, coalesce(state, 'cleared') = 'failed' AS is_failed, is_complete AS is_completed, coalesce(state, 'cleared') = 'running' AS is_running FROM f),
sp AS (SELECT *, CASE WHEN is_completed OR is_running THEN false WHEN is_failed THEN false ELSE true END AS should_process FROM fl)"""


def log(name, final, fn):
    view_query(name, "fx_frame_log", f"WITH {B}\n{final}")(fn)


log("frame_complete", out("scene_id frame_id n_outputs:i is_complete", "f"), bs.frame_complete)
log("completed_frames", "SELECT scene_id, frame_id FROM f WHERE is_complete", bs.completed_frames)
log("frame_flags", "SELECT * FROM fl", bs.frame_flags)
log("should_process", "SELECT * FROM sp", bs.should_process)
log("should_process_retry", "SELECT scene_id, frame_id, is_failed, is_completed, is_running, NOT is_completed AND NOT is_running AS should_process FROM fl",
    lambda d: bs.should_process(d, retry_failed=True))
log("skip_counts", """SELECT count(CASE WHEN NOT should_process AND (is_completed OR NOT is_failed) THEN 1 END) AS skipped_completed,
 count(CASE WHEN NOT should_process AND NOT is_completed AND is_failed THEN 1 END) AS skipped_failed, count(CASE WHEN should_process THEN 1 END) AS remaining FROM sp""", bs.skip_counts)
log("failed_frames", "SELECT scene_id, frame_id, coalesce(reason, '') AS reason FROM f WHERE state = 'failed'", bs.failed_frames)
log("status_summary", "SELECT count(CASE WHEN is_running THEN 1 END) AS processing, count(CASE WHEN is_completed THEN 1 END) AS completed, count(CASE WHEN is_failed THEN 1 END) AS failed FROM fl", bs.status_summary)
log("recover_stale", f"""SELECT scene_id, frame_id, CASE WHEN is_complete THEN 'cleared' ELSE 'failed' END AS state,
 CASE WHEN NOT is_complete THEN '{bs.KILLED_REASON}' END AS reason FROM f WHERE state = 'running'""", bs.recover_stale)
log("clear_failed", "SELECT scene_id, frame_id, 'cleared' AS state, CAST(NULL AS VARCHAR) AS reason FROM f WHERE state = 'failed'", bs.clear_failed)
TODO = "SELECT scene_id, frame_id FROM sp WHERE should_process"
for _name, _state, _fn in (("mark_running", "running", bs.mark_running), ("mark_completed", "completed", bs.mark_completed)):
    log(_name, f"SELECT scene_id, frame_id, '{_state}' AS state, CAST(NULL AS VARCHAR) AS reason FROM ({TODO})",
        lambda d, fn=_fn: fn(bs.should_process(d).filter("should_process")))
log("mark_failed", f"SELECT scene_id, frame_id, 'failed' AS state, concat('lost ', frame_id) AS reason FROM ({TODO})",
    lambda d: bs.mark_failed(bs.should_process(d).filter("should_process").withColumn("reason", F.concat(F.lit("lost "), "frame_id"))))
log("batch_report", """SELECT count(CASE WHEN is_complete AND coalesce(state, '') <> 'failed' THEN 1 END) AS success,
 count(CASE WHEN state = 'failed' THEN 1 END) AS failed, count(*) AS total FROM f""", lambda d: bs.batch_report(d.select(*FK).distinct(), d))
log("mark_cycle", """, n AS (SELECT scene_id, frame_id, CASE WHEN should_process THEN 'running' WHEN is_failed THEN 'failed' WHEN is_running THEN 'running' ELSE 'none' END AS state FROM sp)
 SELECT state, count(*) AS n FROM n GROUP BY ALL""",
    lambda d: bs.frame_flags(bs.append_marks(d, bs.mark_running(bs.should_process(d).filter("should_process")), "2030-01-01 00:00:00", 1 << 40)).groupBy(
        F.when(F.col("is_running"), "running").when(F.col("is_failed"), "failed").otherwise("none").alias("state")).agg(F.count(F.lit(1)).alias("n")))


def skips(d):
    """Every frame '0005' of failed scenes, and all of scenes that reported code 3."""
    one = d.filter(F.col("state") == "failed").select("scene_id", F.lit("0005").alias("frame_id"))
    return one.union(d.filter(F.col("reason") == "code 3").select("scene_id", F.lit("*").alias("frame_id"))).distinct()


log("skip_frames", """SELECT DISTINCT scene_id, frame_id FROM l WHERE scene_id NOT IN (SELECT scene_id FROM l WHERE reason = 'code 3')
 AND NOT (frame_id = '0005' AND scene_id IN (SELECT scene_id FROM l WHERE state = 'failed'))""", lambda d: bs.skip_frames(d.select(*FK).distinct(), skips(d)))
log("expand_tasks", "SELECT DISTINCT scene_id, frame_id FROM l", lambda d: bs.expand_tasks(d.groupBy("scene_id").agg(F.collect_set("frame_id").alias("frame_ids"))))
log("list_frames", """SELECT scene_id, frame_id FROM l WHERE CAST(frame_id AS INT) % 5 = 0 GROUP BY ALL
 HAVING bool_or(state = 'output') AND bool_or(state = 'running') AND bool_or(state = 'failed')""",
    lambda d: bs.list_frames(d.select(*FK, F.col("state").alias("kind")), ["output", "running", "failed"], 5))

# ---- boxes -------------------------------------------------------------------------


def pairs(d):
    p = bx.box(*[F.col("p_" + c) for c in ("cx", "cy", "cz", "l", "w", "h")])
    g = bx.box(*[F.col("g_" + c) for c in ("cx", "cy", "cz", "l", "w", "h")])
    return d.select("sample_key", "k", "part_key", "class_name", "score", p.alias("pred"), g.alias("gt"))


def _ov(c, s):
    return f"greatest(least(p_{c} + p_{s} / 2, g_{c} + g_{s} / 2) - greatest(p_{c} - p_{s} / 2, g_{c} - g_{s} / 2), 0)"


def _hu(c, s):
    return f"(greatest(p_{c} + p_{s} / 2, g_{c} + g_{s} / 2) - least(p_{c} - p_{s} / 2, g_{c} - g_{s} / 2))"


X = f"""b AS ({duck("fx_boxes")}),
o AS (SELECT *, {_ov("cx", "l")} * {_ov("cy", "w")} * {_ov("cz", "h")} AS inter, p_l * p_w * p_h AS va, g_l * g_w * g_h AS vb, {_hu("cx", "l")} * {_hu("cy", "w")} * {_hu("cz", "h")} AS hull FROM b),
x AS (SELECT *, inter / (va + vb - inter) AS iou, inter / (va + vb - inter) - (hull - (va + vb - inter)) / hull AS giou FROM o),
e AS (SELECT *, abs(p_cx - g_cx) + abs(p_cy - g_cy) + abs(p_cz - g_cz) + abs(p_l - g_l) + abs(p_w - g_w) + abs(p_h - g_h) AS l1, CAST(0 AS DOUBLE) AS yaw_error, 1 - giou AS giou3d FROM x),
t AS (SELECT *, l1 * 5 + giou3d * 2 + yaw_error AS total FROM e)"""
KEY = "sample_key:i k:i part_key:i"


def boxq(name, final, fn):
    view_query(name, "fx_boxes", f"WITH {X}\n{final}")(lambda d: fn(pairs(d)))


# Rotated pairs: the prediction has a heading from the keys, the ground truth that and a number of quarter turns, so
# the overlap is axis-aligned in the prediction's own axes.
_YAW = "radians(part_key % 23 * 15e0 + 5)"
R = f"""b AS ({duck("fx_boxes")}), y AS (SELECT *, {_YAW} AS yaw, k % 4 AS turns FROM b),
a AS (SELECT *, cos(yaw) AS c, sin(yaw) AS s, cos(yaw) * (g_cx - p_cx) + sin(yaw) * (g_cy - p_cy) AS du, cos(yaw) * (g_cy - p_cy) - sin(yaw) * (g_cx - p_cx) AS dv,
 CASE WHEN turns % 2 = 1 THEN g_w ELSE g_l END AS gl, CASE WHEN turns % 2 = 1 THEN g_l ELSE g_w END AS gw FROM y),
o AS (SELECT *, greatest(least(p_l / 2, du + gl / 2) - greatest(-p_l / 2, du - gl / 2), 0) * greatest(least(p_w / 2, dv + gw / 2) - greatest(-p_w / 2, dv - gw / 2), 0)
  * {_ov("cz", "h")} AS inter, p_l * p_w * p_h AS va, g_l * g_w * g_h AS vb,
 abs(c) * p_l / 2 + abs(s) * p_w / 2 AS ex, abs(s) * p_l / 2 + abs(c) * p_w / 2 AS ey, abs(c) * gl / 2 + abs(s) * gw / 2 AS fx, abs(s) * gl / 2 + abs(c) * gw / 2 AS fy FROM a),
h AS (SELECT *, (greatest(p_cx + ex, g_cx + fx) - least(p_cx - ex, g_cx - fx)) * (greatest(p_cy + ey, g_cy + fy) - least(p_cy - ey, g_cy - fy)) * {_hu("cz", "h")} AS hull, va + vb - inter AS uni FROM o),
x AS (SELECT *, inter / uni AS iou, inter / uni - (hull - uni) / hull AS giou FROM h),
e AS (SELECT *, abs(p_cx - g_cx) + abs(p_cy - g_cy) + abs(p_cz - g_cz) + abs(p_l - g_l) + abs(p_w - g_w) + abs(p_h - g_h) AS l1,
 abs(s - sin(yaw + turns * pi() / 2)) + abs(c - cos(yaw + turns * pi() / 2)) AS yaw_error, 1 - giou AS giou3d FROM x),
t AS (SELECT *, l1 * 5 + giou3d * 2 + yaw_error AS total FROM e)"""


def turned(d):
    """Pairs with headings."""
    yaw = F.radians(F.col("part_key") % 23 * 15.0 + 5)
    names = ("cx", "cy", "cz", "l", "w", "h")
    p = bx.box(*[F.col("p_" + c) for c in names], yaw)
    g = bx.box(*[F.col("g_" + c) for c in names], yaw + F.col("k") % 4 * (math.pi / 2))
    return d.select("sample_key", "k", "part_key", "class_name", "score", p.alias("pred"), g.alias("gt"))


def turnq(name, final, fn):
    view_query(name, "fx_boxes", f"WITH {R}\n{final}")(lambda d: fn(turned(d)))


BK = ["sample_key", "k", "part_key"]
boxq("iou3d", out(KEY + " iou:d", "x"), lambda p: p.select(*BK, bx.iou3d(F.col("pred"), F.col("gt"), False).alias("iou")))
boxq("giou3d", out(KEY + " giou:d", "x"), lambda p: p.select(*BK, bx.giou3d(F.col("pred"), F.col("gt"), False).alias("giou")))
turnq("iou3d_rotated", out(KEY + " iou:d", "x"), lambda p: p.select(*BK, bx.iou3d(F.col("pred"), F.col("gt"), True).alias("iou")))
turnq("giou3d_rotated", out(KEY + " giou:d", "x"), lambda p: p.select(*BK, bx.giou3d(F.col("pred"), F.col("gt"), True).alias("giou")))
turnq("box_errors_rotated", out(KEY + " l1:d yaw_error:d giou3d:d total:d", "t"), lambda p: ev.box_errors(p, True).select(*BK, "l1", "yaw_error", "giou3d", "total"))
turnq("box_to_corners", out(KEY + " corner:i x:d y:d z:d", """(SELECT *, p_cx + c * dx - s * dy AS x, p_cy + s * dx + c * dy AS y, p_cz + (CASE WHEN (corner & 4) = 0 THEN -0.5 ELSE 0.5 END) * p_h AS z
 FROM (SELECT *, (CASE WHEN (corner & 1) = 0 THEN -0.5 ELSE 0.5 END) * p_l AS dx, (CASE WHEN (corner & 2) = 0 THEN -0.5 ELSE 0.5 END) * p_w AS dy FROM a, (SELECT unnest(range(0, 8)) AS corner)))"""),
    lambda p: p.select(*BK, F.explode(bx.box_to_corners(F.col("pred"))).alias("c")).select(*BK, F.col("c.idx").alias("corner"), "c.x", "c.y", "c.z"))
turnq("corners_to_box", out(KEY + " cx:d cy:d cz:d l:d w:d h:d heading:d", """(SELECT sample_key, k, part_key, p_cx AS cx, p_cy AS cy, p_cz AS cz, p_l AS l, p_w AS w, p_h AS h,
 CASE WHEN yaw > pi() THEN yaw - 2 * pi() ELSE yaw END AS heading FROM a)"""),
    lambda p: p.select(*BK, bx.box_to_corners(F.col("pred")).alias("c")).select(*BK, bx.corners_to_box(F.col("c")).alias("b")).select(*BK, "b.*").withColumnRenamed("yaw", "heading"))
boxq("grounding_metrics", out("class_name n:i acc_25:d acc_5:d miou:d", """(SELECT class_name, count(*) AS n, avg(CASE WHEN iou >= 0.25 THEN 1e0 ELSE 0e0 END) AS acc_25,
 avg(CASE WHEN iou >= 0.5 THEN 1e0 ELSE 0e0 END) AS acc_5, avg(iou) AS miou FROM x GROUP BY ROLLUP (class_name))"""), lambda p: ev.grounding_metrics(p, False))
boxq("box_errors", out(KEY + " l1:d yaw_error:d giou3d:d total:d", "t"), lambda p: ev.box_errors(p, False).select(*BK, "l1", "yaw_error", "giou3d", "total"))
boxq("match_predictions", out("sample_key:i n_candidates:i total:d k:i l1:d yaw_error:d giou3d:d", """(SELECT *, count(*) OVER (PARTITION BY sample_key) AS n_candidates,
 row_number() OVER (PARTITION BY sample_key ORDER BY total, k) AS rn FROM t) WHERE rn = 1"""),
    lambda p: ev.match_predictions(p, ["sample_key"], ["k"], False))
BOX_ID = ["k", "part_key", "score", *["pred." + c for c in ("cx", "cy", "cz", "l", "w", "h")], *["gt." + c for c in ("cx", "cy", "cz", "l", "w", "h")]]


def numbered_boxes(d):
    """Predicted boxes with an id over all columns; rows equal in all of them are told apart by a number."""
    p = pairs(d).withColumn("order_key", F.struct(*[F.col(c) for c in BOX_ID]))
    nth = F.row_number().over(Window.partitionBy("sample_key").orderBy("order_key"))
    return p.select("sample_key", F.format_string("%06d", nth).alias("box_id"), "score", F.col("pred").alias("box"))


NMS = f"""{X}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY k, part_key, score, p_cx, p_cy, p_cz, p_l, p_w, p_h, g_cx, g_cy, g_cz, g_l, g_w, g_h) AS nth FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, nth) AS place FROM r),
hit AS (SELECT a.sample_key, a.place AS winner, b.place AS loser FROM q a JOIN q b ON a.sample_key = b.sample_key AND a.place < b.place
 WHERE {{ov}} / (a.p_l * a.p_w * a.p_h + b.p_l * b.p_w * b.p_h - {{ov}}) > 0.5),
step AS (
 SELECT sample_key, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM q GROUP BY sample_key UNION ALL
 SELECT s.sample_key, s.place + 1, CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.sample_key = s.sample_key AND h.loser = s.place + 1 AND list_contains(s.kept, h.winner)) THEN s.kept ELSE list_append(s.kept, s.place + 1) END
 FROM step s JOIN q ON q.sample_key = s.sample_key AND q.place = s.place + 1),
last AS (SELECT sample_key, arg_max(kept, place) AS kept FROM step GROUP BY sample_key)
SELECT q.sample_key, lpad(CAST(nth AS VARCHAR), 6, '0') AS box_id, round(CAST(score AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS score FROM q JOIN last USING (sample_key) WHERE list_contains(kept, place)"""
_OVER = " * ".join(f"greatest(least(a.p_{c} + a.p_{s} / 2, b.p_{c} + b.p_{s} / 2) - greatest(a.p_{c} - a.p_{s} / 2, b.p_{c} - b.p_{s} / 2), 0)" for c, s in (("cx", "l"), ("cy", "w"), ("cz", "h")))
view_query("nms3d", "fx_boxes", "WITH RECURSIVE " + NMS.replace("{ov}", f"({_OVER})"))(
    lambda d: ev.nms3d(numbered_boxes(d), ["sample_key"], "box_id", "score", 0.5, False).select("sample_key", "box_id", "score"))
# Every 11th part is 1,000 times as long and wide; a quarter turn for each part number swaps length and width.
_BIG, _TURN = "CASE WHEN part_key % 11 = 0 THEN 1000 ELSE 1 END", "part_key % 2 = 1"


def reshaped(d, turned):
    """Boxes of very different sizes, with headings in quarter turns when ``turned``."""
    numbered = pairs(d).withColumn("order_key", F.struct(*[F.col(c) for c in BOX_ID]))
    nth = F.row_number().over(Window.partitionBy("sample_key").orderBy("order_key"))
    b, big = F.col("pred"), F.expr(_BIG)
    yaw = F.col("part_key") % 4 * F.lit(math.pi / 2) if turned else F.lit(0.0)
    shape = bx.box(b["cx"], b["cy"], b["cz"], b["l"] * big, b["w"] * big, b["h"], yaw)
    return numbered.select("sample_key", F.format_string("%06d", nth).alias("box_id"), "score", shape.alias("box"))


def reshaped_sql(turned):
    side = lambda a, b: f"(CASE WHEN {_TURN} THEN p_{b} ELSE p_{a} END) * ({_BIG})" if turned else f"p_{a} * ({_BIG})"
    shaped = NMS.replace("q AS (SELECT *, row", f"r2 AS (SELECT * REPLACE ({side('l', 'w')} AS p_l, {side('w', 'l')} AS p_w) FROM r),\nq AS (SELECT *, row").replace("AS place FROM r)", "AS place FROM r2)")
    return "WITH RECURSIVE " + shaped.replace("> 0.5)", "> 0.4567)").replace("{ov}", f"({_OVER})")


for _name, _turned in (("nms3d_scales", False), ("nms3d_rotated", True)):
    view_query(_name, "fx_boxes", reshaped_sql(_turned))(
        lambda d, turned=_turned: ev.nms3d(reshaped(d, turned), ["sample_key"], "box_id", "score", 0.4567, turned).select("sample_key", "box_id", "score"))
_Q = """(SELECT *, CASE WHEN confidence < 0.5 THEN 'low confidence' WHEN num_points < 100 THEN 'too few points'
 WHEN least(p_l, p_w, p_h) <= 0 OR greatest(p_l, p_w, p_h) > least(p_l, p_w, p_h) * 10 THEN 'bad aspect ratio' WHEN g_cx / 10 < 0.1 OR g_cx / 10 > 10 THEN 'depth out of range' END AS reason
 FROM (SELECT *, iou AS confidence, part_key % 400 AS num_points FROM x))"""


def annotations(p):
    return ev.quality_filter(p.select(
        *BK, bx.iou3d(F.col("pred"), F.col("gt"), False).alias("confidence"), (F.col("part_key") % 400).alias("num_points"),
        F.col("pred.l").alias("l"), F.col("pred.w").alias("w"), F.col("pred.h").alias("h"), (F.col("gt.cx") / 10).alias("depth")))


boxq("quality_filter", out(KEY + " confidence:d num_points:i reason is_valid", f"(SELECT *, reason IS NULL AS is_valid FROM {_Q})"),
     lambda p: annotations(p).select(*BK, "confidence", "num_points", "reason", "is_valid"))
boxq("annotation_report", f"SELECT CASE WHEN reason IS NULL THEN 'success' WHEN reason = 'too few points' THEN 'failed' ELSE 'filtered' END AS status, count(*) AS n FROM {_Q} GROUP BY ALL",
     lambda p: ev.annotation_report(annotations(p).select(F.when(F.col("is_valid"), "success").when(F.col("reason") == "too few points", "failed").otherwise("filtered").alias("status"))))

# ---- clouds ------------------------------------------------------------------------

P = duck("fx_points")
view_query("voxel_downsample", "fx_points", out("cluster_id:i i:i j:i k:i x:d y:d z:d n_points:i", f"""(
 SELECT cluster_id, floor(x / 5) AS i, floor(y / 5) AS j, floor(z / 5) AS k, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_points
 FROM ({P}) v GROUP BY cluster_id, floor(v.x / 5), floor(v.y / 5), floor(v.z / 5))"""))(
    lambda d: pts.voxel_downsample(d, ["cluster_id"], 5.0))
view_query("normalize_cloud", "fx_points", f"""
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(point AS BIGINT) AS point, CAST(cluster_id AS BIGINT) AS cluster_id, round(a / r, 6) + 0e0 AS x, round(b / r, 6) + 0e0 AS y, round(c / r, 6) + 0e0 AS z FROM (
 SELECT *, max(sqrt(a * a + b * b + c * c)) OVER (PARTITION BY cluster_id) AS r FROM (
  SELECT vec_id, point, cluster_id, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM ({P}) WINDOW w AS (PARTITION BY cluster_id)))""")(
    lambda d: pts.normalize_cloud(d, ["cluster_id"]))
view_query("fit_bbox_aabb", "fx_points", out("cluster_id:i cx:d cy:d cz:d l:d w:d h:d yaw:d num_points:i", f"""(
 SELECT cluster_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, max(x) - min(x) AS l, max(y) - min(y) AS w, max(z) - min(z) AS h,
  0 AS yaw, count(*) AS num_points FROM ({P}) GROUP BY ALL HAVING count(*) >= 50)"""))(lambda d: pts.fit_bbox_aabb(d, ["cluster_id"], 50))
view_query("fit_bbox_pca", "fx_points", out("cluster_id:i cx:d cy:d cz:d l:d w:d h:d yaw:d num_points:i", f"""(
 SELECT cluster_id, cos(yaw) * (min(a) + max(a)) / 2 - sin(yaw) * (min(b) + max(b)) / 2 AS cx, sin(yaw) * (min(a) + max(a)) / 2 + cos(yaw) * (min(b) + max(b)) / 2 AS cy,
  (min(z) + max(z)) / 2 AS cz, max(a) - min(a) AS l, max(b) - min(b) AS w, max(z) - min(z) AS h, yaw, count(*) AS num_points FROM (
  SELECT cluster_id, yaw, z, cos(yaw) * x + sin(yaw) * y AS a, cos(yaw) * y - sin(yaw) * x AS b FROM ({P}) JOIN (
   SELECT cluster_id, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) * 0.5 AS yaw FROM ({P}) GROUP BY ALL HAVING count(*) >= 50) USING (cluster_id)) GROUP BY cluster_id, yaw)"""))(
    lambda d: pts.fit_bbox_pca(d, ["cluster_id"], 50))
