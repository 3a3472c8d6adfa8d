"""Profiles of point tables: statistics, counts, cross tables, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.numbering import quantiles

PERCENTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
AXES = ("x", "y", "z")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def unpivoted(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension and value, one row for each dimension of each row."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in dimensions])
    return df.select(F.inline(pairs))


def statistics(df: DataFrame, dimensions: list[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Count, least, greatest, mean, population deviation and percentiles of each dimension's finite values.

    Exact percentiles are found by counting and numbering values in ranges, so no task
    holds a dimension; without exact a sketch of bounded size answers, as streams need.
    A dimension without finite values is there with available = false.
    """
    v = F.when(finite(F.col("value")), F.col("value"))
    basic = [(F.count(v) > 0).alias("available"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("standard_deviation")]
    rows = unpivoted(df, dimensions)
    if not exact:
        return rows.groupBy("dimension").agg(*basic, *[F.percentile_approx(v, p, accuracy).alias(n) for n, p in PERCENTILES.items()])
    found = quantiles(rows.withColumn("value", v), "value", [*PERCENTILES.values()], ["dimension"])
    out = rows.groupBy("dimension").agg(*basic).join(found, "dimension", "left")
    return out.select("dimension", "available", "count", "min", "max", "mean", "standard_deviation", *[F.col("quantiles")[k].alias(n) for k, n in enumerate(PERCENTILES)])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value as text, count. Numbers are written as doubles are."""
    kinds = dict(df.dtypes)
    as_text = lambda c: F.col(c) if kinds[c] == "string" else F.col(c).cast("double").cast("string")
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), as_text(c).alias("value")) for c in columns])))
    return rows.filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("count"))


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """key "a x b" and count."""
    return df.groupBy(a, b).agg(F.count("*").alias("count")).select(F.concat_ws(" x ", F.col(a).cast("string"), F.col(b).cast("string")).alias("key"), "count")


def boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """Count and bounds of each group."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def compare_sides(points: DataFrame, side: str = "side") -> DataFrame:
    """One row: extents of the intersection of both sides' boxes (0 at least), its volume, and each side's points per unit of its own box (null without volume)."""
    b = boxes(points, [side])
    pick = lambda s: b.filter(F.col(side) == s).select(*[F.col(c).alias(f"{s}_{c}") for c in b.columns if c != side])
    row = pick("left").crossJoin(pick("right"))  # two rows at most: one for each side
    extent = {a: F.greatest(F.lit(0.0), F.least(f"left_max_{a}", f"right_max_{a}") - F.greatest(f"left_min_{a}", f"right_min_{a}")) for a in AXES}
    volume = {s: (F.col(f"{s}_max_x") - F.col(f"{s}_min_x")) * (F.col(f"{s}_max_y") - F.col(f"{s}_min_y")) * (F.col(f"{s}_max_z") - F.col(f"{s}_min_z")) for s in ("left", "right")}
    return row.select(
        "left_points", "right_points", *[e.alias(f"extent_{a}") for a, e in extent.items()], (extent["x"] * extent["y"] * extent["z"]).alias("volume"),
        *[F.when(v > 0, F.col(f"{s}_points") / v).alias(f"{s}_density") for s, v in volume.items()],
    )


def density_multiplier(dense: DataFrame, sparse: DataFrame, box: Column) -> DataFrame:
    """One row: points of both in the same box, and how many dense ones there are for each sparse one; null without any."""
    counts = dense.filter(box).agg(F.count("*").alias("dense_points")).crossJoin(sparse.filter(box).agg(F.count("*").alias("sparse_points")))  # single rows
    return counts.withColumn("multiplier", F.when(F.col("sparse_points") > 0, F.col("dense_points") / F.col("sparse_points")))


def sides_of_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """side and path of the first file, in the order of paths, whose name without ending contains left or right in any case; a side without one isn't there."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    each = paths.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*[F.when(stem.contains(s), F.lit(s)) for s in ("left", "right")]))).alias("side"))
    return each.groupBy("side").agg(F.min("path").alias("path"))


def shared_region(points: DataFrame, side: str = "side") -> DataFrame:
    """axis, low, high of the intersection of the sides' boxes, and whether it is empty."""
    b = boxes(points, [side])
    row = b.agg(*[f.alias(n) for a in AXES for n, f in ((f"low_{a}", F.max(f"min_{a}")), (f"high_{a}", F.min(f"max_{a}")))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"low_{a}").alias("low"), F.col(f"high_{a}").alias("high"), (F.col(f"low_{a}") >= F.col(f"high_{a}")).alias("empty")) for a in AXES])))


def text_report(stats: list, counts: list) -> str:
    """A profile for people: a line for each dimension and each counted value."""
    lines = [f"{r['dimension']}: n={r['count']} " + " ".join(f"{k}={r[k]:.6g}" for k in ("min", "p01", "median", "p99", "max", "mean", "standard_deviation")) if r["available"] else f"{r['dimension']}: not available" for r in sorted(stats, key=lambda r: r["dimension"])]
    return "\n".join(lines + [f"{r['dimension']}={r['value']}: {r['count']}" for r in sorted(counts, key=lambda r: (r["dimension"], -r["count"], r["value"]))]) + "\n"


def json_profile(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """One JSON document of a profile: dimensions by name, and counts by dimension and value."""
    one = stats.agg(F.sort_array(F.collect_list(F.struct(*stats.columns))).alias("dimensions"))  # a row for each dimension
    two = counts.agg(F.sort_array(F.collect_list(F.struct(*counts.columns))).alias("counts"))  # a row for each counted value
    return one.crossJoin(two).select(F.to_json(F.struct("dimensions", "counts")).alias("profile"))  # single rows


def same_schema(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same dimensions in the same order."""
    return left.columns == right.columns
