"""Resume and retry state of a batch, from an append-only frame log.

``log``: scene_id, frame_id, state, reason, output_slot, ts, event_id. State is a mark
(running, completed, failed, cleared) or ``output`` (a core output was written). Nothing
is updated in place; the current state is the latest mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenesift.functions.names import CORE_OUTPUTS
from scenesift.operators.points import FK

ALL_SLOTS = (1 << len(CORE_OUTPUTS)) - 1

# Fixed value: reason given to frames found running without all outputs.
KILLED_REASON = "Process killed (OOM or interrupted)"


def frame_status(log: DataFrame) -> DataFrame:
    """Latest mark and completeness per frame, in one combining aggregation."""
    is_mark = F.col("state") != "output"
    slot = F.when(F.col("state") == "output", F.call_function("shiftleft", F.lit(1), F.col("output_slot").cast("int")))
    rows = log.groupBy(*FK).agg(
        F.max(F.when(is_mark, F.struct("ts", "event_id", "state", "reason"))).alias("mark"),
        F.coalesce(F.bit_or(slot), F.lit(0)).alias("slots"),
    )
    return rows.select(
        *FK, F.col("mark.state").alias("state"), F.col("mark.reason").alias("reason"),
        (F.col("slots").bitwiseAND(F.lit(ALL_SLOTS)) == ALL_SLOTS).alias("is_complete"),
        F.bit_count("slots").cast("int").alias("n_outputs"),
    )


def frame_complete(log: DataFrame) -> DataFrame:
    return frame_status(log).select(*FK, "n_outputs", "is_complete")


def completed_frames(log: DataFrame) -> DataFrame:
    """Complete frames that have a placements output (slot 0 is one of the six)."""
    return frame_status(log).filter("is_complete").select(*FK)


def frame_flags(log: DataFrame) -> DataFrame:
    status = frame_status(log)
    mark = F.coalesce("state", F.lit("cleared"))
    return status.select(
        *FK, (mark == "failed").alias("is_failed"), F.col("is_complete").alias("is_completed"), (mark == "running").alias("is_running")
    )


def should_process(log: DataFrame, force: bool = False, retry_failed: bool = False) -> DataFrame:
    """Decision per frame: force, complete, running, failed, in this order."""
    flags = frame_flags(log)
    decision = (
        F.when(F.lit(force), F.lit(True)).when(F.col("is_completed"), F.lit(False)).when(F.col("is_running"), F.lit(False))
        .when(F.col("is_failed"), F.lit(retry_failed)).otherwise(F.lit(True))
    )
    return flags.select("*", decision.alias("should_process"))


def skip_counts(log: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Skipped as completed, skipped as failed, remaining. Running frames count as completed."""
    rows = should_process(log, retry_failed=retry_failed)
    skipped = ~F.col("should_process")
    failed = skipped & ~F.col("is_completed") & F.col("is_failed")
    return rows.agg(
        F.count_if(skipped & ~failed).alias("skipped_completed"), F.count_if(failed).alias("skipped_failed"),
        F.count_if("should_process").alias("remaining"),
    )


def failed_frames(log: DataFrame) -> DataFrame:
    status = frame_status(log).filter(F.col("state") == "failed")
    return status.select(*FK, F.coalesce("reason", F.lit("")).alias("reason")).orderBy(*FK)


def status_summary(log: DataFrame) -> DataFrame:
    """A complete frame with a failed mark counts in both."""
    return frame_flags(log).agg(
        F.count_if("is_running").alias("processing"), F.count_if("is_completed").alias("completed"), F.count_if("is_failed").alias("failed")
    )


def _marks(frames: DataFrame, state: str, reason=None) -> DataFrame:
    why = F.lit(None).cast("string") if reason is None else reason
    return frames.select(*FK, F.lit(state).alias("state"), why.alias("reason"))


def mark_running(frames: DataFrame) -> DataFrame:
    """Log rows to append; a later running mark replaces a failed one."""
    return _marks(frames, "running")


def mark_completed(frames: DataFrame) -> DataFrame:
    return _marks(frames, "completed")


def mark_failed(frames: DataFrame) -> DataFrame:
    """``frames`` carries its reason."""
    return _marks(frames, "failed", F.col("reason"))


def recover_stale(log: DataFrame) -> DataFrame:
    """Log rows that settle frames left running: complete ones are cleared, others fail."""
    stale = frame_status(log).filter(F.col("state") == "running")
    return stale.select(
        *FK, F.when(F.col("is_complete"), "cleared").otherwise("failed").alias("state"),
        F.when(~F.col("is_complete"), F.lit(KILLED_REASON)).alias("reason"),
    )


def clear_failed(log: DataFrame, scene_id: str | None = None, frame_id: str | None = None) -> DataFrame:
    """Log rows that clear failed marks: all, of a scene, or of a frame. Their count is the result count."""
    rows = frame_status(log).filter(F.col("state") == "failed")
    if scene_id is not None:
        rows = rows.filter(F.col("scene_id") == scene_id)
    if frame_id is not None:
        rows = rows.filter(F.col("frame_id") == frame_id)
    return _marks(rows, "cleared")


def append_marks(log: DataFrame, marks: DataFrame, ts, first_event_id: int) -> DataFrame:
    """Log with new marks behind it; one batch of marks shares a time, at most one mark per frame."""
    stamped = marks.select(
        F.lit(first_event_id).cast("long").alias("event_id"), F.lit(ts).cast(log.schema["ts"].dataType).alias("ts"), *FK, "state", "reason",
        F.lit(None).cast("int").alias("output_slot"),
    )
    return log.unionByName(stamped)


def batch_report(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """Success, failed and total of the tasks of a run."""
    status = frame_status(log).select(*FK, "state", "is_complete")
    rows = tasks.join(status, FK, "left")
    done = F.coalesce("is_complete", F.lit(False)) & (F.coalesce("state", F.lit("")) != "failed")
    return rows.agg(
        F.count_if(done).alias("success"), F.count_if(F.coalesce(F.col("state") == "failed", F.lit(False))).alias("failed"), F.count(F.lit(1)).alias("total")
    )


def expand_tasks(scenes: DataFrame) -> DataFrame:
    """(scene_id, frame_ids array) to one row per frame."""
    return scenes.select("scene_id", F.explode("frame_ids").alias("frame_id"))


# Entries that skip a whole scene.
SKIP_ALL = ("all", "*")


def skip_frames(tasks: DataFrame, skips: DataFrame) -> DataFrame:
    """Tasks without the listed (scene_id, frame_id); a wildcard entry drops the scene."""
    whole = skips.filter(F.col("frame_id").isin(*SKIP_ALL)).select("scene_id").distinct()
    single = skips.filter(~F.col("frame_id").isin(*SKIP_ALL)).select(*FK).distinct()
    return tasks.join(whole, "scene_id", "left_anti").join(single, FK, "left_anti")


def list_frames(listing: DataFrame, required: list[str], frame_step: int) -> DataFrame:
    """Frames that have every required kind of file and lie on the step.

    ``listing``: scene_id, frame_id, kind. Scenes without frames drop out by themselves.
    """
    rows = listing.filter(F.col("kind").isin(*required))
    if frame_step > 1:
        rows = rows.filter(F.col("frame_id").cast("int") % frame_step == 0)
    kinds = F.array(*[F.lit(k) for k in required])
    number = F.array_position(kinds, F.col("kind")).cast("int") - 1
    have = rows.groupBy(*FK).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), number)).alias("have"))
    return have.filter(F.col("have") == (1 << len(required)) - 1).select(*FK)
