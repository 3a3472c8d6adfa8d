"""Point views over tables that aren't point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 0.0001


def event_points(events: DataFrame) -> DataFrame:
    """Events as points: hours since 2024-01-01 by user by value, with fixed-point and decoded coordinates; even users are the left side."""
    raw = events.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("side"),
        F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 360000").alias("raw_x"),
        (F.col("user_id") * 10000).alias("raw_y"),
        F.round(F.col("value") * 10000).cast("long").alias("raw_z"),
        F.col("event_type").alias("classification"),
        "user_id",
    )
    return raw.select("row_id", "side", "raw_x", "raw_y", "raw_z", *[(F.col(f"raw_{a}") * F.lit(SCALE)).alias(a) for a in "xyz"], "classification", "user_id")


#: The same view for other SQL engines.
EVENT_POINTS_SQL = """pts AS (
  SELECT row_id, side, raw_x, raw_y, raw_z, CAST(raw_x AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS x, CAST(raw_y AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS y,
         CAST(raw_z AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS z, classification, user_id
  FROM (SELECT event_id AS row_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, (epoch_us(ts) - 1704067200000000) // 360000 AS raw_x, user_id * 10000 AS raw_y,
               CAST(round(value * 10000) AS BIGINT) AS raw_z, event_type AS classification, user_id FROM events))"""
