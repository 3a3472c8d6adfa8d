"""Density clusters as set algebra, and what follows from their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.graph import connected_components
from cloudstrata.functions.numbering import placed
from cloudstrata.operators.neighbours import k_nearest, nodes, radius_join
from cloudstrata.operators.parameters import checked_parameters
from cloudstrata.operators.profile import AXES
from cloudstrata.operators.regions import first_of_voxels
from cloudstrata.session import cut


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """points with core and label: -1 for noise, clusters from 0 in the order of their least core row_id.

    A point is core with min_samples points, itself included, within eps. Clusters
    are components of core points; a border point takes the least label among the
    core points within eps, as a search that finishes clusters in order would give it.
    """
    checked_parameters(eps=eps, min_samples=min_samples)
    places = cut(nodes(points).select(F.col("row_id").alias("node"), *AXES, "weight"), "places")
    pairs = cut(radius_join(places, places, eps).select(F.col("q.node").alias("a"), F.col("p.node").alias("b"), F.col("p.weight").alias("w")), "radius-pairs")
    core = cut(pairs.groupBy("a").agg(F.sum("w").alias("near")).filter(F.col("near") >= min_samples).select(F.col("a").alias("node")), "core")
    # core points of a cell whose diagonal is at most eps are within eps of one another: the least stands for them
    cell = [F.floor(F.col(a) / F.lit(eps / 3**0.5 * (1 - 1e-9))).alias(f"__c{a}") for a in AXES]
    at = core.join(places, "node").select("node", *cell)
    first = at.groupBy(*[f"__c{a}" for a in AXES]).agg(F.min("node").alias("first"))
    stands = cut(at.join(first, [f"__c{a}" for a in AXES]).select("node", "first"), "core-cells")
    from_core = pairs.filter("a <= b").join(stands.select(F.col("node").alias("a"), F.col("first").alias("fa")), "a")
    edges = from_core.join(stands.select(F.col("node").alias("b"), F.col("first").alias("fb")), "b").select("fa", "fb").distinct()
    joined = connected_components(edges, "fa", "fb").withColumnRenamed("node", "first")  # a core point pairs with itself, so none is left out
    found = cut(stands.join(joined, "first").select("node", "component"), "clusters")
    first = found.groupBy("component").agg(F.min("node").alias("first"))
    numbers = placed(first, ["first"], "label").select("component", "label")
    labels = found.join(numbers, "component").select("node", "label")
    border = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near_label"))
    all_labels = places.join(labels, "node", "left").join(border.withColumnRenamed("a", "node"), "node", "left")
    all_labels = all_labels.select(*AXES, F.col("label").isNotNull().alias("core"), F.coalesce("label", "near_label", F.lit(-1)).cast("int").alias("label"))
    return points.join(all_labels, [*AXES]).select(*points.columns, "core", "label")


def cluster_table(labelled: DataFrame, min_points: int, most: int, roi: tuple[float, float, float, float] | None = None, eps: float = 0.0, key: str = "0" * 16) -> DataFrame:
    """A row for each cluster, largest first: identity, bounds, extent, whether it touches the region, status, and the index in the review batch of the first `most` that aren't too small."""
    checked_parameters(min_cluster_points=min_points, max_candidates=most)
    box = labelled.filter("label >= 0").groupBy("label").agg(F.count("*").alias("point_count"), *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    box = box.withColumn("tiny", F.col("point_count") < min_points)
    box = cut(box, "cluster-boxes")
    batch = box.filter("not tiny").orderBy(F.desc("point_count"), "label").limit(most)  # a review's few rows are numbered
    batch = batch.select("label", (F.row_number().over(W.orderBy(F.desc("point_count"), "label")) - 1).alias("__k"))
    box, index = box.join(batch, "label", "left"), F.col("__k")
    touch = F.lit(False)
    if roi is not None:
        touch = (F.col("min_x") - roi[0] <= eps) | (F.lit(roi[1]) - F.col("max_x") <= eps) | (F.col("min_y") - roi[2] <= eps) | (F.lit(roi[3]) - F.col("max_y") <= eps)
    status = F.when(F.col("tiny"), "below_min_cluster_points").when(index.isNotNull(), "in_review_batch").otherwise("outside_review_batch")
    return box.select(
        F.format_string("%s_%05d", F.lit(key[:16]), "label").alias("candidate_id"), "label", "point_count", *[f"{n}_{a}" for n in ("min", "max") for a in AXES],
        *[(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"extent_{a}") for a in AXES], touch.alias("touches_region_boundary"), status.alias("status"), index.cast("int").alias("candidate_index"),
    )


def cluster_summary(labelled: DataFrame, table: DataFrame) -> DataFrame:
    """One row: points of noise, too small and kept clusters, and numbers of clusters."""
    noise = labelled.agg(F.count("*").alias("points"), F.count_if(F.col("label") < 0).alias("noise_points"))
    tiny = F.col("status") == "below_min_cluster_points"
    sizes = table.agg(
        F.coalesce(F.sum(F.when(tiny, F.col("point_count"))), F.lit(0)).alias("rejected_points"), F.coalesce(F.sum(F.when(~tiny, F.col("point_count"))), F.lit(0)).alias("kept_points"),
        F.count("*").alias("clusters"), F.count_if(~tiny).alias("kept_clusters"), F.count_if(F.col("status") == "in_review_batch").alias("batch_clusters"),
    )
    return noise.crossJoin(sizes)  # two single rows


def seed_support(dense: DataFrame, seeds: DataFrame, within: float) -> DataFrame:
    """For each label of dense points: its points, and the seeds whose nearest dense point has the label and is within a distance; place 1 is the best by support, points, label."""
    near = k_nearest(seeds, dense, 1)
    of = near.join(dense.select(F.col("row_id").alias("neighbour"), "label"), "neighbour").filter(F.col("distance") <= within).groupBy("label").agg(F.count("*").alias("support"))
    out = dense.filter("label >= 0").groupBy("label").agg(F.count("*").alias("points")).join(of, "label", "left").select("label", "points", F.coalesce("support", F.lit(0)).alias("support"))
    return placed(out, [F.desc("support"), F.desc("points"), "label"]).withColumn("place", (F.col("place") + 1).cast("int"))


def regroup_dense(points: DataFrame, seeds: DataFrame, voxel: float, min_samples: int = 3, within: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Clusters of a dense crop: representatives of voxels are clustered with a radius of three voxels, labels go back to all points of the voxel. Returns labelled points and the components by seed support."""
    low = points.agg(*[F.min(a).alias(f"__o{a}") for a in AXES])
    cells = {f"__c{a}": F.floor((F.col(a) - F.col(f"__o{a}")) / F.lit(voxel)) for a in AXES}
    celled = points.crossJoin(low).withColumns(cells)  # low is one row
    chosen = first_of_voxels(points, voxel, "least")
    labels = dbscan(chosen, 3 * voxel, min_samples).crossJoin(low).withColumns(cells).select(*cells, "label")
    labelled = cut(celled.join(labels, [*cells]).select(*points.columns, "label"), "regrouped")
    return labelled, seed_support(labelled, seeds, within)
