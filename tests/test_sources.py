import json

import pytest
from pyspark.sql import functions as F

from scenesift.sources import datasets as ds

EYE = [[float(i == j) for j in range(4)] for i in range(4)]


def test_json_annotations_and_mesh_boxes(spark, tmp_path):
    scene = tmp_path / "scene_0001"
    scene.mkdir()
    view = [row[:] for row in EYE]
    view[2][3] = 1.5
    place = [row[:] for row in EYE]
    place[0][3] = 7.0
    doc = {"camera": {"intrinsics": [[500.0, 0, 320.0], [0, 510.0, 240.0], [0, 0, 1]], "extrinsics": view},
           "objects": [{"class": "Butter", "pose": place}, {"class": "Milk", "pose": EYE, "bbox3d": [0.0, 0, 0, 1, 2, 3]}]}
    (scene / "0005.json").write_text(json.dumps(doc))
    (scene / "0005_rgb.jpg").write_text("x")
    (scene / "0007_rgb.jpg").write_text("x")
    (tmp_path / "Butter.obj").write_text("# mesh\nv 10 20 30\nv -10 0 5\nvn 0 0 1\n")
    sizes = ds.mesh_bbox(spark, str(tmp_path / "*.obj"))
    camera, objects = ds.scan_hope_annotations(spark, str(tmp_path), sizes)
    cam = camera.first()
    assert (cam.scene_id, cam.frame_id, cam.fx, cam.cy) == ("scene_0001", "0005", 500.0, 240.0)
    assert cam.pose[11] == pytest.approx(-150.0)
    rows = {r.obj_id: r for r in objects.collect()}
    assert rows["obj_0"].aabb == pytest.approx([-1.0, 0.0, 0.5, 1.0, 2.0, 3.0])
    assert rows["obj_0"].pose[3] == pytest.approx(7.0) and rows["obj_0"].pose[11] == pytest.approx(-150.0)
    assert rows["obj_1"].aabb == [0.0, 0.0, 0.0, 1.0, 2.0, 3.0]
    frames = ds.list_dataset_frames(spark, str(tmp_path), "hope", 5).collect()
    assert [(r.scene_id, r.frame_id) for r in frames] == [("scene_0001", "0005")]


def test_text_poses_and_labels(spark, tmp_path):
    scene = tmp_path / "scene01"
    for part in ("camera_pose", "rgb", "depth", "labels"):
        (scene / part).mkdir(parents=True)
    (scene / "intrinsics.txt").write_text("600 0 320\n0 610 240\n0 0 1\n")
    (scene / "camera_pose" / "000010.txt").write_text("1 0 0 0.5\n0 1 0 0\n0 0 1 2\n0 0 0 1\n")
    for part, name in (("rgb", "000010.png"), ("depth", "000010.png"), ("labels", "000010_label.pkl"), ("rgb", "000020.png")):
        (scene / part / name).write_text("x")
    camera = ds.scan_housecat_text(spark, str(tmp_path))
    cam = camera.first()
    assert (cam.fx, cam.fy, cam.cx, cam.cy) == (600.0, 610.0, 320.0, 240.0) and cam.pose[3] == 50.0 and cam.pose[11] == 200.0
    eye = [row[:3] for row in EYE[:3]]
    schema = "scene_id string, frame_id string, model_list array<string>, instance_ids array<bigint>, rotations array<array<array<double>>>, translations array<array<double>>, gt_scales array<array<double>>"
    good = spark.createDataFrame([("scene01", "000010", ["cup-a", "can"], [7], [eye, eye], [[0.1, 0.0, 0.0], [0.0, 0.0, 1.0]], [[0.1, 0.2, 0.3]] * 2)], schema)
    rows = {r.class_name: r for r in ds.housecat_objects(good, camera).collect()}
    assert rows["cup-a"].obj_id == "obj_7" and rows["can"].obj_id == "obj_1"
    assert rows["cup-a"].aabb == pytest.approx([-5, -10, -15, 5, 10, 15]) and rows["cup-a"].pose[3] == pytest.approx(60.0)
    bad = good.withColumn("gt_scales", F.slice("gt_scales", 1, 1))
    with pytest.raises(Exception, match="incomplete labels"):
        ds.housecat_objects(bad, camera).collect()
    frames = ds.list_dataset_frames(spark, str(tmp_path), "housecat6d", 10).collect()
    assert [(r.scene_id, r.frame_id) for r in frames] == [("scene01", "000010")]


def test_dense_depth_matches_pixels(spark):
    from scenesift.operators.points import explode_depth, stride_sample

    frame = spark.createDataFrame([("s", "f", 3, [1.0, 0.0, 2.0, 3.0, 4.0, 5.0])], "scene_id string, frame_id string, w int, depth array<float>")
    got = {(r.u, r.v): r.d for r in stride_sample(explode_depth(frame), 2).collect()}
    assert got == {(0, 0): 1.0, (2, 0): 2.0}
