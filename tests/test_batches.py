"""Batches, caches, checks of memberships and streams."""

import pytest
from pyspark.sql import functions as F

from cloudstrata.operators import batches, profile
from cloudstrata.streaming.profile import running_statistics


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for want in (False, True):
        df, there = batches.cached(spark, str(tmp_path), {"eps": 1.0, "file": "a"}, make)
        assert there is want and df.count() == 3
    assert batches.cached(spark, str(tmp_path), {"eps": 1.1, "file": "a"}, make)[1] is False and len(made) == 2


def test_check_members(spark):
    crop = spark.createDataFrame([(k, float(k)) for k in range(5)], "row_id long, x double")
    batches.check_members(crop, crop.filter("row_id < 3"), ["x"])
    for bad in (crop.limit(0), crop.unionByName(crop), crop.withColumn("x", F.col("x") + 1), crop.withColumn("row_id", F.col("row_id") + 3)):
        with pytest.raises(ValueError):
            batches.check_members(crop, bad, ["x"])


def test_check_batch(spark):
    df = spark.createDataFrame([("a", 1, ["old"]), ("b", 1, None)], "candidate_id string, schema_version int, legacy_ids array<string>")
    assert batches.check_batch(df, 1) is df
    assert batches.candidate_record(df, "old").first()["candidate_id"] == "a"
    for call in (lambda: batches.check_batch(df, 2), lambda: batches.check_batch(df.unionByName(df), 1), lambda: batches.candidate_record(df, "c")):
        with pytest.raises(ValueError):
            call()


def test_fingerprint(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"), F.lit(1).alias("g"))
    one = batches.region_fingerprint(df, ["x"], ["g"]).first()
    assert one == batches.region_fingerprint(df.repartition(5, "x"), ["x"], ["g"]).first()
    assert one["fingerprint"] != batches.region_fingerprint(df.withColumn("x", F.col("x") + 1), ["x"], ["g"]).first()["fingerprint"]


def test_experiment(spark):
    pts = spark.range(400).select(F.col("id").alias("row_id"), F.lit("left").alias("side"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"), F.when(F.col("id") == 210, 9.0).otherwise(0.0).alias("z"))
    both, rows = batches.run_experiment(pts, ["side"], 2.0, 0.3, {"iterations": 100})
    assert both.filter("row_id = 210 and not baseline and not cloth").count() == 1
    assert {r["method"] for r in rows.collect()} == {"baseline", "cloth"}
    with pytest.raises(ValueError, match="cover"):
        batches.comparison_rows(both.withColumn("cloth", F.when(F.col("row_id") > 3, F.col("cloth"))), {"cloth": {}}, ["side"])


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(100).select(F.col("id").cast("double").alias("x")).write.parquet(folder)
    stream = running_statistics(spark.readStream.schema("x double").parquet(folder), ["x"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        r = spark.table("running").first()
        assert (r["count"], r["min"], r["max"]) == (100, 0.0, 99.0)
    finally:
        q.stop()


def test_empty_dimension(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    r = profile.statistics(df, ["x"]).first()
    assert (r["available"], r["count"], r["mean"]) == (False, 0, None)
