"""A resumable batch: settle what the last run left, choose frames, plan them together, write, and mark them.

The frame log is an append-only table. A run that dies leaves its frames marked as running; the next one settles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenesift.config import PlacementConfig
from scenesift.functions.names import CORE_OUTPUTS
from scenesift.operators import batch_state as bs
from scenesift.operators.occupancy import export_occupancy_points, grid_meta
from scenesift.operators.points import FK
from scenesift.plans.placement import plan_placements
from scenesift.session import cut_lineage
from scenesift.sources import sinks

LOG_SCHEMA = "event_id long, ts timestamp, scene_id string, frame_id string, state string, reason string, output_slot int"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The frame log; empty before the first run."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def append(marks: DataFrame, path: str) -> None:
    """Append marks or outputs. Every batch of rows gets one time and a number above all before it."""
    spark = marks.sparkSession
    last = read_log(spark, path).agg(F.max("event_id")).first()[0]
    slot = F.col("output_slot").cast("int") if "output_slot" in marks.columns else F.lit(None).cast("int")
    rows = marks.select(
        F.lit((last or 0) + 1).cast("long").alias("event_id"), F.current_timestamp().alias("ts"), *FK, "state", F.col("reason").cast("string").alias("reason"),
        slot.alias("output_slot"),
    )
    rows.write.mode("append").parquet(path)


def frames_to_do(tasks: DataFrame, log: DataFrame, skips: DataFrame | None, force: bool, retry_failed: bool) -> DataFrame:
    """Listed frames that are not skipped and that their state, if they have one, lets run."""
    wanted = bs.skip_frames(tasks.select(*FK).distinct(), skips) if skips is not None else tasks.select(*FK).distinct()
    state = bs.should_process(log, force, retry_failed).select(*FK, "should_process")
    return wanted.join(state, FK, "left").filter(F.coalesce("should_process", F.lit(True))).select(*FK)


def run_batch(depth_px: DataFrame, camera: DataFrame, objects: DataFrame, tasks: DataFrame, out: str, cfg: PlacementConfig,
              skips: DataFrame | None = None, force: bool = False, retry_failed: bool = False) -> DataFrame:
    """Plan the frames of ``tasks`` that are still to do; returns the report over all tasks.

    ``out`` gets one folder for each kind of output and the log in ``frame_log``. The frames of a run share a folder
    named by the run, so a repeated run adds files and changes none.
    """
    spark, log_path = tasks.sparkSession, f"{out}/frame_log"
    append(cut_lineage(bs.recover_stale(read_log(spark, log_path))), log_path)
    log = read_log(spark, log_path)
    todo = cut_lineage(frames_to_do(tasks, log, skips, force, retry_failed))
    if todo.isEmpty():
        return bs.batch_report(tasks, log)
    append(bs.mark_running(todo), log_path)
    run = f"run_{read_log(spark, log_path).agg(F.max('event_id')).first()[0]:06d}"
    only = lambda table: table.join(todo, FK, "left_semi")
    plan = plan_placements(only(depth_px), only(camera), only(objects), cfg)
    placements = cut_lineage(plan.placements)
    meta = cut_lineage(grid_meta(plan.columns, plan.grid))
    sinks.sink_placements(placements, f"{out}/placements/{run}")
    sinks.sink_sample_documents(placements, f"{out}/samples/{run}")
    plan.points.write.mode("overwrite").parquet(f"{out}/point_clouds/{run}")
    plan.columns.write.mode("overwrite").parquet(f"{out}/occupancy_grids/{run}")
    export_occupancy_points(plan.columns, plan.grid).write.mode("overwrite").parquet(f"{out}/occupancy_points/{run}")
    sinks.sink_grid_meta(meta, f"{out}/grid_meta/{run}", cfg.unit)
    # A frame is done when its grid could be built; one without a usable pixel has nothing to plan on.
    done = cut_lineage(todo.join(meta.select(*FK), FK, "left_semi"))
    slots = done.select(*FK, F.explode(F.array(*[F.lit(slot) for slot, _, _ in CORE_OUTPUTS])).alias("output_slot"))
    append(slots.select("*", F.lit("output").alias("state"), F.lit(None).cast("string").alias("reason")), log_path)
    append(bs.mark_completed(done), log_path)
    lost = todo.join(done, FK, "left_anti").withColumn("reason", F.lit("no depth"))
    append(bs.mark_failed(lost), log_path)
    return bs.batch_report(tasks, read_log(spark, log_path))
