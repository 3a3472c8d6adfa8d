"""PCA shape features of groups and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.linalg import COVARIANCE, eigenvalues, vertical_part
from cloudstrata.functions.numbering import placed_in_groups, quantiles
from cloudstrata.operators.neighbours import nodes, radius_join
from cloudstrata.operators.profile import AXES

#: Fixed before any analysis: neighbours, gaps and floors of defined features, and descriptive bins.
LEAST_NEIGHBOURS, GAP, FLOOR = 6, 1e-6, 1e-20
BINS = {"linear": "linearity >= 0.6", "planar": "planarity >= 0.6", "scattered": "scattering >= 0.25", "vertical_linear": "linearity >= 0.6 and axis_alignment >= 0.9"}
PAIRED = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
NAMES = ("linearity", "planarity", "scattering", "axis_alignment", "normal_alignment", "surface_verticality")


def shape_features(points: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """count, status, population covariance, eigenvalues, extents and features of each group. Features that aren't defined are null."""
    c = {n: f"{prefix}{n}" for n in AXES}
    df = points.groupBy(*by).agg(
        F.count("*").alias("count"), *[F.covar_pop(c[a], c[b]).alias(n) for n, (a, b) in zip(COVARIANCE, PAIRED, strict=True)], *[(F.max(c[a]) - F.min(c[a])).alias(f"extent_{a}") for a in AXES]
    )
    return _features(df, by)


def _features(df: DataFrame, by: list[str]) -> DataFrame:
    """What follows from count, covariance and extents."""
    df = eigenvalues(df)
    df = vertical_part(vertical_part(df, "l1", "v1z"), "l3", "v3z")
    status = F.when(F.col("count") < LEAST_NEIGHBOURS, "insufficient_neighbors").when(F.col("l1") <= FLOOR, "zero_variance").otherwise("valid")
    df = df.withColumn("status", status)
    ok = F.col("status") == "valid"
    df = df.withColumns({"linearity": F.when(ok, (F.col("l1") - F.col("l2")) / F.col("l1")), "planarity": F.when(ok, (F.col("l2") - F.col("l3")) / F.col("l1")), "scattering": F.when(ok, F.col("l3") / F.col("l1"))})
    df = df.withColumns({"axis_alignment": F.when(F.col("linearity") > GAP, F.least(F.lit(1.0), "v1z")), "normal_alignment": F.when(F.col("planarity") > GAP, F.least(F.lit(1.0), "v3z"))})
    df = df.withColumn("surface_verticality", 1 - F.col("normal_alignment"))
    enough = F.col("count") >= LEAST_NEIGHBOURS
    return df.select(*by, "count", "status", *[F.when(enough, F.col(k)).alias(k) for k in (*COVARIANCE, "l1", "l2", "l3")], *[f"extent_{a}" for a in AXES], *NAMES)


def query_points(points: DataFrame, by: list[str], most: int = 512, seed: int = 20260911) -> DataFrame:
    """At most `most` points of each group: those of the least hash of row_id."""
    h = F.xxhash64("row_id", F.lit(seed))
    return points.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(h, "row_id"))).filter(F.col("__k") <= most).drop("__k")


def local_features(queries: DataFrame, points: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """Features of the neighbourhood of each query among all points of its group, itself included.

    Coincident points are met once, with their number; moments are taken about the query, so no offset of the coordinates harms them.
    """
    pairs = radius_join(queries.select(*by, "row_id", *AXES), nodes(points, by).select(*by, *AXES, "weight"), radius, by)
    w = F.col("weight")
    pairs = pairs.select(*by, F.col("q.row_id").alias("row_id"), F.col("p.weight").alias("weight"), *[(F.col(f"p.{a}") - F.col(f"q.{a}")).alias(a) for a in AXES])
    sums = [*[F.sum(w * F.col(a)).alias(f"__{a}") for a in AXES], *[F.sum(w * F.col(a) * F.col(b)).alias(n) for n, (a, b) in zip(COVARIANCE, PAIRED, strict=True)]]
    df = pairs.groupBy(*by, "row_id").agg(F.sum("weight").alias("count"), *sums, *[(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in AXES])
    flat = lambda a, b: (F.col(f"extent_{a}") == 0) | (F.col(f"extent_{b}") == 0)
    about = {n: F.when(flat(a, b), 0.0).otherwise(F.col(n) / F.col("count") - F.col(f"__{a}") / F.col("count") * (F.col(f"__{b}") / F.col("count"))) for n, (a, b) in zip(COVARIANCE, PAIRED, strict=True)}
    return _features(df.withColumns(about), [*by, "row_id"])


def summarise_local(features: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, quantiles of neighbours and of defined features, and shares of valid queries in the descriptive bins."""
    valid = F.col("status") == "valid"
    out = [F.count("*").alias("queries"), *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "insufficient_neighbors", "zero_variance")]]
    out += [F.count(F.when(valid, F.col(n))).alias(f"{n}_defined") for n in NAMES]
    out += [(F.count_if(valid & F.coalesce(F.expr(e), F.lit(False))) / F.nullif(F.count_if(valid), F.lit(0))).alias(f"{n}_share") for n, e in BINS.items()]
    # exact quantiles of all columns by ranges of their values, so no task holds a group
    columns = [F.struct(F.lit("neighbour").alias("__name"), F.col("count").cast("double").alias("__v")), *[F.struct(F.lit(n).alias("__name"), F.when(valid, F.col(n)).alias("__v")) for n in NAMES]]
    found = quantiles(features.select(*by, F.inline(F.array(*columns))), "__v", [0.1, 0.5, 0.9], [*by, "__name"])
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col("quantiles"))).alias(f"{n}_quantiles") for n in ("neighbour", *NAMES)])
    wide = wide.withColumnsRenamed({b: f"__by_{b}" for b in by})
    counts = features.groupBy(*by).agg(*out)
    same = F.lit(True)
    for b in by:
        same = same & counts[b].eqNullSafe(wide[f"__by_{b}"])
    return counts.join(wide, same, "left").drop(*[f"__by_{b}" for b in by])


def ecdf(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each value with its place in order over the number of values."""
    numbered = placed_in_groups(rows.filter(F.col(value).isNotNull()).select(*by, value), by, [value])
    return numbered.select(*by, value, ((F.col("place") + 1) / F.col("group_size")).alias("fraction"))
