"""Equi-joins with keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many rows of one key are no burden to a task.
FEW_ROWS = 50_000
SALT = "__salt"


def hot_keys(rows: DataFrame, on: list[str], counts: DataFrame | None = None, total: int | None = None) -> DataFrame | None:
    """The keys that more than one of `spark.sql.shuffle.partitions` parts of the rows share, or None; by definition there are fewer than partitions.

    counts: columns `on` and count, where the caller has them already.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count() if total is None else total
    if total <= FEW_ROWS:
        return None
    counts = rows.groupBy(*on).count() if counts is None else counts
    known = counts.filter(" and ".join(f"`{c}` is not null" for c in on))
    found = known.filter(F.col("count") > F.lit(max(FEW_ROWS // parts, total // parts))).select(*on).collect()
    return spark.createDataFrame(found, counts.select(*on).schema) if found else None


def dealt(rows: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """rows with a salt: those of hot keys are dealt over as many salts as there are partitions. Rows are dealt by their place, so they should come from files."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")  # fewer keys than partitions
    return marked.withColumn(SALT, F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0).cast("long")).drop("__hot")


def copied(rows: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """rows with a salt: those of hot keys once for each salt."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")  # fewer keys than partitions
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return marked.withColumn(SALT, F.explode(salts)).drop("__hot")


def join_hot(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """big joined with small, inner, left or left semi, without a task that gets all rows of a frequent key of big."""
    hot = hot_keys(big, on, counts, total)
    if hot is None:
        return big.join(small, on, how)
    return dealt(big, on, hot).join(copied(small, on, hot), [*on, SALT], how).drop(SALT)
