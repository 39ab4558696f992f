"""A batch run, its resume and its retry on the smallest data set."""

from pyspark.sql import functions as F

from catalog.scene import CONFIG, Scene
from scenesift.operators import batch_state as bs
from scenesift.operators.points import FK
from scenesift.plans.batch import append, read_log, run_batch
from scenesift.sources import samples as src

SF = "/root/testdata/sf0.001"


def test_resume(spark, tmp_path):
    scene = Scene(spark, SF)
    frames = sorted(tuple(r) for r in scene.camera.select(*FK).collect())
    out = str(tmp_path / "out")
    tasks = spark.createDataFrame([*frames, ("scene_9999", "0000"), ("scene_9998", "0000")], "scene_id string, frame_id string")
    skips = spark.createDataFrame([("scene_9998", "*")], "scene_id string, frame_id string")
    # A run before died while it had the first frame, and one without a single pixel failed.
    append(bs.mark_running(spark.createDataFrame(frames[:1], "scene_id string, frame_id string")), out + "/frame_log")
    report = run_batch(scene.depth, scene.camera, scene.objects, tasks, out, CONFIG, skips=skips).first()
    assert (report.success, report.failed, report.total) == (len(frames) - 1, 2, len(frames) + 2)
    log = read_log(spark, out + "/frame_log")
    reasons = {(r.scene_id, r.frame_id): r.reason for r in bs.failed_frames(log).collect()}
    assert reasons == {frames[0]: bs.KILLED_REASON, ("scene_9999", "0000"): "no depth"}
    again = run_batch(scene.depth, scene.camera, scene.objects, tasks, out, CONFIG, skips=skips).first()
    assert again == report and read_log(spark, out + "/frame_log").filter("state = 'running'").count() == len(frames) + 1
    retried = run_batch(scene.depth, scene.camera, scene.objects, tasks, out, CONFIG, skips=skips, retry_failed=True).first()
    assert (retried.success, retried.failed) == (len(frames), 1)
    documents = src.parse_documents(spark.read.text(out + "/samples/*/*.json").withColumns({"path": F.lit("p"), "source_dir": F.lit("out"), "stem": F.lit("s")}))
    assert {(r.scene_id, r.frame_id) for r in documents.select(*FK).collect()} <= set(frames) and documents.count() > 0
