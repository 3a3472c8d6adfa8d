"""Numbers of rows in a global order without a task that holds all rows or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.session import cut


def placed(rows: DataFrame, order: list[str | Column], out: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in an order.

    Ranges of the order are numbered apart and moved by the counts of the ranges
    before them; only a count for each range comes to the driver. Rows that are
    equal in the order are numbered in any order, so it should be a full one.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "placed")
    counts = sorted((r["__part"], r["n"]) for r in parted.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, count in counts:
        before[part] = total
        total += count
    first = F.lit(0).cast("long")
    if before:
        first = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv]), F.col("__part").cast("long"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parted.withColumn(out, first + within - 1).drop("__part")


def placed_in_groups(rows: DataFrame, by: list[str], order: list[str | Column], place: str = "place", size: str = "group_size") -> DataFrame:
    """Adds the place of each row within its group, from 0, and the group's size; groups may be of any size."""
    numbered = placed(rows, [*by, *order], "__place")
    groups = numbered.groupBy(*by).agg(F.min("__place").alias("__first"), F.count("*").alias(size))
    if not by:
        joined = numbered.crossJoin(groups)  # one row
    else:
        groups = groups.withColumnsRenamed({b: f"__{b}" for b in by})
        on = [numbered[b].eqNullSafe(groups[f"__{b}"]) for b in by]
        joined = numbered.join(groups, on).drop(*[f"__{b}" for b in by])
    return joined.withColumn(place, F.col("__place") - F.col("__first")).drop("__place", "__first")


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by and quantiles: exact ones with linear interpolation of the values that aren't null, of each group, at any size: values are counted, numbered by ranges, and only those beside a wanted place are brought together."""
    by = by or []
    distinct = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    # how many values of the whole order come before each distinct one: running sums by range
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(distinct.repartitionByRange(n, *by, value).withColumn("__part", F.spark_partition_id()), "quantiles")
    sums = sorted((r["__part"], r["n"]) for r in parted.groupBy("__part").agg(F.sum("__n").alias("n")).collect())
    before, total = {}, 0
    for part, count in sums:
        before[part] = total
        total += count
    first = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv]), F.col("__part").cast("long")) if before else F.lit(0).cast("long")
    within = W.partitionBy("__part").orderBy(*by, value).rowsBetween(W.unboundedPreceding, 0)
    ends = parted.withColumn("__end", first + F.sum("__n").over(within)).withColumn("__begin", F.col("__end") - F.col("__n"))
    groups = ends.groupBy(*by).agg(F.min("__begin").alias("__first"), F.sum("__n").alias("__all"))
    if by:
        other = groups.withColumnsRenamed({b: f"__by_{b}" for b in by})
        ends = ends.join(other, [ends[b].eqNullSafe(other[f"__by_{b}"]) for b in by]).drop(*[f"__by_{b}" for b in by])
    else:
        ends = ends.crossJoin(groups)  # one row
    place = [F.lit(float(s)) * (F.col("__all") - 1).cast("double") for s in shares]
    holds = lambda at: (F.col("__begin") - F.col("__first") <= at) & (at < F.col("__end") - F.col("__first"))
    beside = [F.max(F.when(holds(f(p)), F.col(value))) for p in place for f in (F.floor, F.ceil)]
    share = [F.max(p - F.floor(p)) for p in place]
    found = [beside[2 * k] + (beside[2 * k + 1] - beside[2 * k]) * share[k] for k in range(len(shares))]
    return ends.groupBy(*by).agg(F.array(*found).alias("quantiles"))
