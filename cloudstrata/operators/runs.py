"""Saved runs: checked parameters, folders of their own, masks, reloading, and sources with their identity."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import content_key
from cloudstrata.operators.batches import cached, file_hashes, region_fingerprint
from cloudstrata.operators.clusters import cluster_summary, cluster_table, dbscan
from cloudstrata.operators.parameters import MOST_ELIGIBLE, MOST_REGION_AREA, MOST_REGION_POINTS, checked_parameters
from cloudstrata.operators.records import label_by_partition
from cloudstrata.operators.regions import region
from cloudstrata.sources.documents import json_text, plain

def guarded_region(points: DataFrame, x: tuple[float, float], y: tuple[float, float], padding: float = 10.0, most_points: int = MOST_REGION_POINTS, most_area: float = MOST_REGION_AREA) -> DataFrame:
    """A padded region with core; an error instead of a cut beyond the greatest area or number of points."""
    checked_parameters(padding=padding)
    if not (x[0] < x[1] and y[0] < y[1]):
        raise ValueError("a region has a width and a depth")
    if (x[1] - x[0] + 2 * padding) * (y[1] - y[0] + 2 * padding) > most_area:
        raise ValueError(f"the region is larger than {most_area}")
    return region(points, x, y, padding, most_points)


def mask_part(ground: Column, covered: Column) -> Column:
    """ground, non_ground or uncovered: the three parts that a result divides points into."""
    return F.when(~F.coalesce(covered, F.lit(False)), "uncovered").when(ground, "ground").otherwise("non_ground")


def complementary(whole: DataFrame, parts: list[DataFrame], key: str = "row_id") -> None:
    """ValueError unless every row of whole is in exactly one part, and parts hold nothing else."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionByName(p.select(key))
    n = union.groupBy(key).agg(F.count("*").alias("__n")).withColumnRenamed(key, "__key")
    both = whole.select(key).join(n, whole[key] == n["__key"], "full")
    bad = both.filter(F.col(key).isNull() | F.coalesce("__n", F.lit(0)).__ne__(1))
    if bad.limit(1).count():
        raise ValueError("the parts don't divide the whole")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each key: its last in order, with `first`, the place where the key came first; aggregated before the shuffle."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("__r"), F.min(order).alias("first"))
    return last.select("__r.*", "first")


def run_folder(root: str, kind: str) -> str:
    """A new folder on the driver, named by kind, UTC time and eight digits by chance."""
    path = os.path.join(root, f"{kind}_{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}")
    os.makedirs(path, exist_ok=False)
    return path


def create_json(path: str, value: object) -> None:
    """A new JSON document on the driver; an error if it is there already."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json_text(value))


def save_run(points: DataFrame, folder: str, facts: dict, columns: list[str], mask: str = "ground") -> dict:
    """The mask of a run as a table in folder, and a manifest of what it depends on: the facts, the fingerprint of the points and its counts. The folder's mask must not be there."""
    points.select("row_id", mask).write.mode("errorifexists").parquet(f"{folder}/mask")
    manifest = facts | _state(points, columns, mask)
    create_json(f"{folder}/manifest.json", manifest)
    return manifest


def _state(points: DataFrame, columns: list[str], mask: str) -> dict:
    counts = points.agg(F.count("*").alias("points"), F.count_if(F.col(mask)).alias("ground_points")).first()
    print_ = region_fingerprint(points.withColumn("__all", F.lit(1)), columns, ["__all"]).first()
    return {"points": counts["points"], "ground_points": counts["ground_points"], "fingerprint": print_["fingerprint"] if print_ else None}


def same_fingerprint(saved: dict, current: dict) -> None:
    if saved.get("fingerprint") != current.get("fingerprint"):
        raise ValueError("the result is of other points")


def reload_run(spark: SparkSession, folder: str, points: DataFrame, facts: dict, columns: list[str], mask: str = "ground") -> DataFrame:
    """points with a saved mask, if everything it depends on is as it was: facts, fingerprint, coverage and counts; ValueError otherwise."""
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        saved = json.load(f)
    other = [k for k, v in plain(facts).items() if saved.get(k) != v]
    if other:
        raise ValueError(f"saved with another {', '.join(other)}")
    joined = points.join(spark.read.parquet(f"{folder}/mask"), "row_id", "left")
    if joined.filter(F.col(mask).isNull()).limit(1).count():
        raise ValueError("the saved mask doesn't cover all points")
    current = _state(joined, columns, mask)
    same_fingerprint(saved, current)
    if saved["points"] != current["points"] or saved["ground_points"] != current["ground_points"]:
        raise ValueError("the saved counts are others")
    return joined


def source_identity(spark: SparkSession, paths: list[str], facts: dict) -> dict:
    """What a source is: the SHA-256 of its files and the facts it was cut out by."""
    files = sorted((r["path"].rsplit("/", 1)[-1], r["length"], r["sha256"]) for r in file_hashes(spark, paths).collect())  # a row for each file
    return {"files": files, **facts}


def load_source(spark: SparkSession, root: str, identity: dict, load: Callable[[], DataFrame], parts: dict[str, DataFrame], columns: list[str], most: int = MOST_ELIGIBLE) -> tuple[DataFrame, bool]:
    """A region with its ground labels, colours and `eligible` (core and not ground), from the cache under root if its identity was loaded before.

    load gives the region's points with core, red, green and blue; parts the saved
    ground and other records, which must be the region's, each once. ValueError without colours or with more
    eligible points than `most`.
    """

    def make() -> DataFrame:
        points = label_by_partition(load(), parts, columns)
        return points.withColumn("eligible", F.col("core") & (F.col("label") != "ground"))

    out, there = cached(spark, root, identity, make)
    if not {"red", "green", "blue"} <= set(out.columns) or out.filter("red is null or green is null or blue is null").limit(1).count():
        raise ValueError("the source has no colours")
    if out.filter("eligible").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points are eligible")
    return out, there


def extract_candidates(
    source: DataFrame, root: str, identity: dict, eps: float, min_cluster_points: int, min_samples: int = 5, max_candidates: int = 8, roi: tuple[float, float, float, float] | None = None, most: int = MOST_ELIGIBLE
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Density clusters of a source's eligible points as one call: membership (row_id, raw_label, label), a row for each cluster, the counts, and whether they were in the cache under root.

    source: points with eligible; identity: what the source is. label is -1 for noise and for clusters under
    `min_cluster_points`, whose raw_label stays. `max_candidates` bounds the review batch alone. ValueError for a parameter
    out of its range or more eligible points than `most`; nothing is cut.
    """
    parameters = checked_parameters(eps=eps, min_cluster_points=min_cluster_points, min_samples=min_samples, max_candidates=max_candidates)
    eligible = source.filter("eligible")
    if eligible.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points are eligible")
    inputs = {"source": identity, "roi": roi, **parameters}
    key, spark = content_key(inputs), source.sparkSession

    def cluster() -> DataFrame:
        return dbscan(eligible.select("row_id", "x", "y", "z"), eps, min_samples)

    labelled, there = cached(spark, f"{root}/clusters", inputs, cluster)
    table, _ = cached(spark, f"{root}/tables", inputs, lambda: cluster_table(labelled, min_cluster_points, max_candidates, roi, eps, key))
    kept = table.filter("status <> 'below_min_cluster_points'").select("label", F.lit(True).alias("__kept"))
    members = labelled.withColumnRenamed("label", "raw_label").join(kept.withColumnRenamed("label", "raw_label"), "raw_label", "left")
    members = members.select("row_id", "raw_label", F.when(F.col("__kept"), F.col("raw_label")).otherwise(-1).alias("label"))
    return members, table, cluster_summary(labelled, table), there


def review_snapshot(folder: str, rows: DataFrame, observations: dict) -> str:
    """Comparison rows (a few for each method) and what people said of them, as one new document; nothing is computed again."""
    path = os.path.join(folder, f"review_{uuid.uuid4().hex[:8]}.json")
    create_json(path, {"saved_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "comparison_rows": [json.loads(r) for (r,) in rows.select(F.to_json(F.struct("*"))).collect()], "observations": observations})
    return path
