"""Crops of one pass with caps, digests and checks of change, and their regrouping."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.functions import hashing
from cloudstrata.operators import crops
from cloudstrata.sources import las
from tests.test_operators import cloud, las_points

BOXES = {"one": {"x": (6.0, 8.0), "y": (5.0, 9.0), "z": (5.0, 12.0)}, "two": {"x": (7.0, 9.0), "y": (6.0, 14.0), "z": (6.0, 9.0)}, "none": {"x": (90.0, 91.0), "y": (0.0, 1.0), "z": (0.0, 1.0)}}


@pytest.fixture
def file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crops, "LEAF", 300)
    monkeypatch.setattr(crops, "LEAVES", 2)
    path = str(tmp_path / "run.las")
    las.write_las(las_points(spark, 2500), path, (0.01,) * 3, (5.0,) * 3)
    return path


def test_scan(spark, tmp_path, file):
    rows = las_points(spark, 2500)
    folder = f"file://{tmp_path}/run"
    with pytest.raises(FileNotFoundError):
        crops.scan_crops(spark, file, BOXES, folder, 0.5)
    seeds = rows.filter("x between 6.5 and 7 and y between 5 and 9 and z between 5 and 12").select(F.lit("one").alias("box"), "raw_x", "raw_y", "raw_z", "gps_time")
    manifest = crops.scan_crops(spark, file, BOXES, folder, 0.5, allow_scan=True, seeds=seeds, seed_columns=["raw_x", "raw_y", "raw_z", "gps_time"])
    for name, b in BOXES.items():
        want = rows.filter(" and ".join(f"{a} >= {lo - 0.5 * (a != 'z')} and {a} <= {hi + 0.5 * (a != 'z')}" for a, (lo, hi) in b.items()))
        got = spark.read.parquet(manifest["crops"][name]["path"])
        assert sorted(map(tuple, got.select("row_id", "raw_x", "red").collect())) == sorted(map(tuple, want.select("row_id", "raw_x", "red").collect()))
        assert manifest["crops"][name]["points"] == want.count()
    assert manifest["crops"]["one"]["seeds_recovered"] == seeds.count() > 0 and manifest["records"] == 2500
    with open(file, "rb") as f:
        raw = f.read()[375:]
    leaves = [hashlib.sha256(raw[k : k + 300 * 36]).digest() for k in range(0, len(raw), 300 * 36)]
    assert manifest["record_digest"] == hashlib.sha256(b"".join(leaves)).hexdigest()
    again = crops.scan_crops(spark, file, BOXES, folder, 0.5)
    assert again["cache_hit"] and again["crops"] == manifest["crops"]
    with pytest.raises(ValueError, match="changed"):
        crops.scan_crops(spark, file, BOXES, folder, 0.6)
    os.utime(file, (1, 1))
    with pytest.raises(ValueError, match="changed"):
        crops.scan_crops(spark, file, BOXES, folder, 0.5)


def test_refusals(spark, tmp_path, file, monkeypatch):
    with pytest.raises(Exception, match="more than 40 points"):
        crops.scan_crops(spark, file, BOXES, f"{tmp_path}/cap", 0.5, most=40, allow_scan=True)
    with pytest.raises(ValueError, match="begun here before"):
        crops.scan_crops(spark, file, BOXES, f"{tmp_path}/cap", 0.5, most=40, allow_scan=True)
    lost = las_points(spark, 3).select(F.lit("one").alias("box"), (F.col("raw_x") + 777).alias("raw_x"))
    with pytest.raises(ValueError, match="seeds"):
        crops.scan_crops(spark, file, BOXES, f"{tmp_path}/seeds", 0.5, allow_scan=True, seeds=lost, seed_columns=["raw_x"])
    for boxes, margin in (({}, 1.0), ({str(k): BOXES["one"] for k in range(4)}, 1.0), (BOXES, 0.0)):
        with pytest.raises(ValueError):
            crops.scan_crops(spark, file, boxes, f"{tmp_path}/x", margin, allow_scan=True)
    states = iter([{"bytes": 1, "mtime_ns": 1}, {"bytes": 1, "mtime_ns": 2}])
    monkeypatch.setattr(crops, "file_state", lambda path: next(states))
    with pytest.raises(ValueError, match="while it was read"):
        crops.scan_crops(spark, file, BOXES, f"{tmp_path}/moved", 0.5, allow_scan=True)
    assert not os.path.exists(f"{tmp_path}/moved/manifest.json")


def test_digests(spark, monkeypatch):
    monkeypatch.setattr(hashing, "LEAF", 7)
    monkeypatch.setattr(hashing, "FAN", 3)
    rows = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    one = hashing.table_digest(rows, ["row_id"], ["v", "w"])
    assert one == hashing.table_digest(rows.repartition(7, "v"), ["row_id"], ["v", "w"])
    changes = [rows.withColumn("w", F.coalesce("w", F.lit(0))), rows.filter("row_id < 99"), rows.withColumn("v", F.when(F.col("row_id") == 50, 1).otherwise(F.col("v"))), rows.withColumn("row_id", 99 - F.col("row_id"))]
    assert len({one, *(hashing.table_digest(c, ["row_id"], ["v", "w"]) for c in changes)}) == 5
    assert hashing.table_digest(rows.limit(0), ["row_id"], ["v"]) is None


def test_dense_crop(spark):
    """A pole and a bush on a floor: the pole, where the seeds are, is chosen whole."""
    r = np.random.default_rng(7)
    floor = np.column_stack([r.random((1500, 2)) * 6, r.random(1500) * 0.02])
    pole = np.column_stack([3 + 0.04 * r.random((500, 2)), 0.9 + 2 * r.random(500)])
    bush = np.column_stack([1 + 0.5 * r.random((300, 2)), 1 + 0.5 * r.random(300)])
    crop = cloud(spark, np.concatenate([floor, pole, bush]))
    seeds = cloud(spark, pole[::50] + 0.01)
    box = {"x": (0.0, 6.0), "y": (0.0, 6.0)}
    cloth = {"resolution": 0.5, "threshold": 0.5, "rigidness": 3, "iterations": 200}
    points, components, facts = crops.group_dense_crop(crop, seeds, box, **cloth)
    chosen = {x["row_id"] for x in points.filter("chosen").collect()}
    assert chosen == set(range(1500, 2000)) and facts["points"] == 500 and facts["support"] == 10 and not facts["touches_crop_boundary"]
    assert 0.06 <= facts["voxel"] <= 0.18 and facts["eps"] == 3 * facts["voxel"] and facts["ground_points"] == 1500 and components.count() == facts["components"] >= 2
    assert points.filter("ground and chosen").count() == 0
    assert crops.group_dense_crop(crop, seeds, {"x": (2.99, 6.0), "y": (0.0, 6.0)}, **cloth)[2]["touches_crop_boundary"]
    with pytest.raises(ValueError, match="near a seed"):
        crops.group_dense_crop(crop, cloud(spark, [[-50.0, 0.0, 0.0]]), box, **cloth)
    with pytest.raises(ValueError, match="three points"):
        crops.group_dense_crop(cloud(spark, floor), seeds, box, **cloth)
