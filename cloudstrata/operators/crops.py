"""Dense crops: the records of a survey in a few boxes, found in one pass that also tells what was read, and their regrouping."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import LEAF, merkle_root
from cloudstrata.operators.batches import region_fingerprint
from cloudstrata.operators.clusters import regroup_dense
from cloudstrata.operators.ground import ground_by_cloth_tiles
from cloudstrata.operators.neighbours import sampled_spacing
from cloudstrata.operators.parameters import MOST_VOXELS, checked_parameters
from cloudstrata.operators.records import recovered
from cloudstrata.operators.regions import first_of_voxels
from cloudstrata.session import cut
from cloudstrata.sources.documents import create_text, exists, json_text, plain, read_json
from cloudstrata.sources.las import decode, open_file, read_header, record_type
from cloudstrata.types import POINT

#: Boxes of a pass, and points of a box, at most; leaves of the digest that a task reads in a row.
MOST_BOXES, MOST_CROP_POINTS, LEAVES = 3, 1_000_000, 20


def file_state(path: str) -> dict:
    """Length and time of change of a file, without reading it."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return {"bytes": info.size, "mtime_ns": info.mtime_ns}


def _pass(spark: SparkSession, path: str, header: dict, boxes: dict[str, dict[str, tuple[float, float]]], most: int) -> DataFrame:
    """Rows of two kinds from one read of a file: box and a point in it, or leaf, digest and records of each LEAF records."""
    names = [f.name for f in POINT.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = record_type(header)
        with open_file(path) as f:
            for part in (v for b in batches for v in b.column(0).to_pylist()):
                held = dict.fromkeys(boxes, 0)
                for leaf in range(part * LEAVES, (part + 1) * LEAVES):
                    n = min(LEAF, header["point_count"] - leaf * LEAF)
                    if n <= 0:
                        break
                    f.seek(header["data_offset"] + leaf * LEAF * kind.itemsize)
                    raw = f.read(n * kind.itemsize)
                    if len(raw) != n * kind.itemsize:
                        raise ValueError(f"{path} ends before its last record")
                    yield _rows(pa.array([None], pa.string()), [leaf], [hashlib.sha256(raw).hexdigest()], [n], None)
                    points = decode(np.frombuffer(raw, kind), header, np.arange(leaf * LEAF, leaf * LEAF + n))
                    xyz = {a: points.column(names.index(a)).to_numpy() for a in "xyz"}
                    for name, bounds in boxes.items():
                        there = np.flatnonzero(np.logical_and.reduce([(xyz[a] >= lo) & (xyz[a] <= hi) for a, (lo, hi) in bounds.items()]))
                        held[name] += len(there)
                        if held[name] > most:
                            raise ValueError(f"{name} has more than {most} points")
                        if len(there):
                            some = points.take(pa.array(there))
                            yield _rows(pa.array([name] * len(there), pa.string()), None, None, None, some)

    def _rows(box: pa.Array, leaf, digest, records, points: pa.RecordBatch | None) -> pa.RecordBatch:
        n = len(box)
        own = [box, pa.array(leaf or [None] * n, pa.int64()), pa.array(digest or [None] * n, pa.string()), pa.array(records or [None] * n, pa.int64())]
        rest = points.columns if points is not None else [pa.nulls(n, t) for t in types]
        return pa.RecordBatch.from_arrays([*own, *rest], names=["box", "leaf", "digest", "records", *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in POINT.fields]
    schema = ", ".join(["box string, leaf long, digest string, records long", *(f"{f.name} {f.dataType.simpleString()}" for f in POINT.fields)])
    parts = -(-header["point_count"] // (LEAF * LEAVES))
    return spark.range(0, parts, 1, max(1, min(parts, 10_000))).mapInArrow(run, schema)


def scan_crops(
    spark: SparkSession, path: str, boxes: dict[str, dict[str, tuple[float, float]]], folder: str, margin_xy: float = 5.0, most: int = MOST_CROP_POINTS, allow_scan: bool = False, seeds: DataFrame | None = None, seed_columns: list[str] | None = None
) -> dict:
    """The points of up to three boxes (bounds of x, y, z by name), widened by a margin in x and y, as tables in folder, and a manifest of what was read.

    One pass over the file finds the points and a digest of all records in order: SHA-256 of each LEAF
    records, joined as a tree, so ranges may be read anywhere. ValueError for more points of a box than `most`
    (nothing is cut), for a file that changed meanwhile, and for seeds (box and the columns of their
    records) that aren't all in their crop. With the manifest there, it is returned, with cache_hit, if the settings and the file's state are the
    same and the crops as they were saved; ValueError otherwise. Without it, the pass is only made
    when allowed, and once: a folder where one began and didn't end is refused.
    """
    if not 1 <= len(boxes) <= MOST_BOXES or not margin_xy > 0:
        raise ValueError(f"one to {MOST_BOXES} boxes, with a margin above zero")
    wide = {n: {a: (float(lo) - margin_xy * (a != "z"), float(hi) + margin_xy * (a != "z")) for a, (lo, hi) in b.items()} for n, b in boxes.items()}
    before = file_state(path)
    settings = plain({"path": path, "state": before, "boxes": wide, "margin_xy": margin_xy, "most": most})
    target = f"{folder.rstrip('/')}/manifest.json"
    if exists(spark, target):
        manifest = read_json(spark, target)
        if manifest["settings"] != settings:
            raise ValueError("the settings or the file have changed: use another folder")
        for name, crop in manifest["crops"].items():
            if _fingerprint(spark.read.parquet(crop["path"])) != crop["fingerprint"]:
                raise ValueError(f"the crop {name} isn't as it was saved")
        return manifest | {"cache_hit": True}
    if not allow_scan:
        raise FileNotFoundError("there are no crops yet, and a pass over the file isn't allowed")
    try:
        create_text(spark, f"{folder.rstrip('/')}/scan_started.json", json_text({"settings": settings, "started_utc": dt.datetime.now(dt.timezone.utc)}))
    except FileExistsError:
        raise ValueError("a pass was begun here before") from None
    header = read_header(path)
    found = cut(_pass(spark, path, header, wide, most), "crop-scan")
    leaves = found.filter("digest is not null")
    read = leaves.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if read != header["point_count"] or file_state(path) != before:
        raise ValueError("the file changed while it was read")
    points = found.filter("box is not null")
    counts = {r["box"]: r["count"] for r in points.groupBy("box").count().collect()}  # a row for each box
    crops = {}
    for name in boxes:
        if counts.get(name, 0) > most:
            raise ValueError(f"{name} has more than {most} points")
        where = f"{folder.rstrip('/')}/crops/{name}"
        crop = points.filter(F.col("box") == name).select(*[f.name for f in POINT.fields])
        crop.write.mode("errorifexists").parquet(where)
        crop = spark.read.parquet(where)
        kept = {"path": where, "points": counts.get(name, 0), "bounds": wide[name], "fingerprint": _fingerprint(crop)}
        if seeds is not None:
            r = recovered(seeds.filter(F.col("box") == name).select(*seed_columns), crop, seed_columns).first()
            if r["seeds"] != r["recovered"]:
                raise ValueError(f"{name}: {r['seeds'] - r['recovered']} seeds aren't in the crop")
            kept["seeds_recovered"] = r["recovered"]
        crops[name] = kept
    manifest = plain(
        {
            "settings": settings, "created_utc": dt.datetime.now(dt.timezone.utc), "records": read, "record_digest": merkle_root(leaves), "leaf_records": LEAF, "crops": crops, "scales": header["scales"], "offsets": header["offsets"],
            "point_format": header["point_format"], "las_version": header["las_version"],
        }
    )
    create_text(spark, target, json_text(manifest))
    return manifest | {"cache_hit": False}


def _fingerprint(crop: DataFrame) -> str | None:
    found = region_fingerprint(crop.withColumn("__all", F.lit(1)), ["raw_x", "raw_y", "raw_z", "intensity", "classification", "gps_time", "red", "green", "blue"], ["__all"]).first()
    return found["fingerprint"] if found else None


def group_dense_crop(crop: DataFrame, seeds: DataFrame, box: dict[str, tuple[float, float]], within: float = 0.8, **cloth) -> tuple[DataFrame, DataFrame, dict]:
    """The object of a dense crop that most seeds lie on: the crop's points with ground, label and chosen, a row for each component, and what was found.

    The voxel is twice the median spacing of the crop, 0.06 to 0.18; points that a cloth doesn't take for ground are
    clustered by voxels with a radius of three, and the component with most seeds within a distance (ties: more points, smaller label) is chosen.
    ValueError with fewer than three points above ground, more than MOST_VOXELS voxels, or no component near a seed.
    """
    checked_parameters(**cloth)
    spacing = sampled_spacing(crop).first()
    voxel = float(np.clip(2 * (spacing["median"] or 0.0), 0.06, 0.18))
    split = cut(ground_by_cloth_tiles(crop.withColumn("__crop", F.lit(0)), ["__crop"], **cloth).drop("__crop"), "dense-ground")
    above = split.filter("not ground")
    n = above.limit(3).count()
    if n < 3:
        raise ValueError("fewer than three points above ground")
    voxels = first_of_voxels(above.select("row_id", "x", "y", "z"), voxel, "least")
    if voxels.limit(MOST_VOXELS + 1).count() > MOST_VOXELS:
        raise ValueError(f"more than {MOST_VOXELS} voxels")
    labelled, components = regroup_dense(above.select("row_id", "x", "y", "z"), seeds, voxel, 3, within)
    components = cut(components, "dense-components")
    best = components.filter("place = 1").first()
    if best is None or not best["support"]:
        raise ValueError("no component lies near a seed")
    points = split.join(labelled.select("row_id", "label"), "row_id", "left").withColumn("chosen", F.coalesce(F.col("label") == best["label"], F.lit(False)))
    points = cut(points, "dense-points")
    bounds = points.filter("chosen").agg(F.count("*").alias("points"), *[f(a).alias(f"{e}_{a}") for a in "xyz" for e, f in (("min", F.min), ("max", F.max))]).first()
    eps = 3 * voxel
    touches = any(bounds[f"min_{a}"] - box[a][0] <= eps or box[a][1] - bounds[f"max_{a}"] <= eps for a in "xy")
    counts = points.agg(F.count("*").alias("crop_points"), F.count_if("ground").alias("ground_points"), F.count_if(F.col("label") < 0).alias("noise_points")).first()
    facts = {
        "voxel": voxel, "eps": eps, "label": best["label"], "points": bounds["points"], "support": best["support"], "support_fraction": best["support"] / seeds.count(), "touches_crop_boundary": touches, **counts.asDict(),
        "components": components.count(), "bounds": {e: [bounds[f"{e}_{a}"] for a in "xyz"] for e in ("min", "max")},
    }
    return points, components, facts
