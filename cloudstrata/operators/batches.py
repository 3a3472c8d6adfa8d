"""Experiments, caches, candidates with their context, and review batches."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import content_key, membership_id
from cloudstrata.functions.numbering import placed
from cloudstrata.operators.ground import ground_by_cell, ground_by_cloth
from cloudstrata.operators.parameters import checked_experiment
from cloudstrata.operators.profile import AXES
from cloudstrata.operators.records import crop_groups, interleaved, overlapping_boxes, shape_hint, shared_members
from cloudstrata.operators.selection import select_in_turn
from cloudstrata.session import cut
from cloudstrata.sources.documents import create_text, file_facts, is_folder, json_text, read_json, replace_text

#: Fixed by the formats of candidate names: sixteen hexadecimal digits and a label, or a name by membership.
CANDIDATE_ID = r"[0-9a-f]{16}_[0-9]{5,}"
CANDIDATE_NAME = re.compile(rf"{CANDIDATE_ID}|candidate_[0-9a-f]{{24}}")


def cached(spark: SparkSession, root: str, inputs: object, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table made from inputs, from root if it was made before: its folder is named by the hash of all it depends on. Also whether it was there."""
    path = f"{root.rstrip('/')}/{content_key(inputs)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and SHA-256 of files, read where the executors are; for documents and crops, not for whole surveys."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def region_fingerprint(points: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """A name of each region's records, whatever their order: count and sums of two hashes of every record with its row_id."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.sum(F.xxhash64(*columns, "row_id").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("row_id", *columns).cast("decimal(38,0)")).alias("b")).select(
        *by, "points", F.sha2(F.concat_ws(":", "points", "a", "b"), 256).alias("fingerprint")
    )


def run_experiment(region: DataFrame, by: list[str], cell: float = 1.0, tolerance: float = 0.35, cloth: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Both ground splits of one region: points with `baseline` and `cloth`, and a comparison row for each method and group."""
    cloth = {"resolution": 1.0, "threshold": 0.8, "rigidness": 3, "iterations": 500, "smooth": True, "time_step": 0.65} | (cloth or {})
    checked_experiment({"cell": cell, "tolerance": tolerance}, cloth)
    began = time.perf_counter()
    base = ground_by_cell(region, cell, tolerance, by).select(*by, "row_id", F.col("ground").alias("baseline"))
    other = ground_by_cloth(region.select(*by, "row_id", *AXES), by, **cloth).select(*by, "row_id", F.col("ground").alias("cloth"))
    both = region.join(base, [*by, "row_id"]).join(other, [*by, "row_id"])
    return both, comparison_rows(both, {"baseline": {"cell": cell, "tolerance": tolerance}, "cloth": cloth}, by, time.perf_counter() - began)


def comparison_rows(points: DataFrame, methods: dict[str, dict], by: list[str], seconds: float = 0.0) -> DataFrame:
    """A row for each method and group: points, ground, share, parameters. A method that leaves a point undecided raises an error."""
    if points.filter(" or ".join(f"`{m}` is null" for m in methods)).limit(1).count():
        raise ValueError("a method doesn't cover all points")
    out = None
    for name, parameters in methods.items():
        g = F.col(name)
        row = points.groupBy(*by).agg(F.count("*").alias("input_points"), F.count_if(g).alias("ground_points"), F.count_if(~g).alias("other_points"))
        kept = F.create_map(*[F.lit(str(v)) for kv in parameters.items() for v in kv]) if parameters else F.create_map().cast("map<string,string>")
        row = row.select(F.lit(name).alias("method"), *by, "input_points", "ground_points", "other_points", (F.col("ground_points") / F.col("input_points")).alias("ground_fraction"), kept.alias("parameters"), F.lit(seconds).alias("seconds"))
        out = row if out is None else out.unionByName(row)
    return out


def normal_parameters(manifest: dict) -> dict:
    """Parameter names without their units."""
    return {re.sub(r"_(m|ft|units)$", "", k): v for k, v in manifest.items()}


def candidate_context(points: DataFrame, members: DataFrame, padding: float) -> DataFrame:
    """Points around a candidate's box in x and y, with member; the candidate's bounds are one row."""
    box = members.agg(*[f(a).alias(f"__{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    near = points.crossJoin(box)
    for a in "xy":
        near = near.filter(F.col(a).between(F.col(f"__lo{a}") - padding, F.col(f"__hi{a}") + padding))
    marked = members.select("row_id").withColumn("__m", F.lit(True))
    return near.join(marked, "row_id", "left").select(*points.columns, F.col("__m").isNotNull().alias("member"))


def context_summary(loaded: DataFrame, members: DataFrame, padding: float, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row about a candidate's context: the box that is asked for in x and y, its points, whether it reaches beyond what is loaded (truncated), and a note that says so.

    region: least and greatest x, least and greatest y that were loaded; without it the bounds of the loaded points.
    """
    box = members.agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))])
    asked = box.select(*[e for a in "xy" for e in ((F.col(f"min_{a}") - padding).alias(f"low_{a}"), (F.col(f"max_{a}") + padding).alias(f"high_{a}"))])
    if region is None:
        there = loaded.agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))])
    else:
        there = box.select(*[F.lit(float(v)).alias(n) for n, v in zip(("min_x", "max_x", "min_y", "max_y"), region, strict=True)])
    points = candidate_context(loaded, members, padding).agg(F.count("*").alias("points"), F.count_if("member").alias("members"))
    row = asked.crossJoin(there).crossJoin(points)  # single rows
    beyond = F.lit(False)
    for a in "xy":
        beyond = beyond | (F.col(f"low_{a}") < F.col(f"min_{a}")) | (F.col(f"high_{a}") > F.col(f"max_{a}"))
    note = F.when(F.col("truncated"), "The context ends where the loaded region ends.").otherwise("The context lies within the loaded region.")
    return row.withColumn("truncated", F.coalesce(beyond, F.lit(False))).select("low_x", "high_x", "low_y", "high_y", "points", "members", "truncated", note.alias("note"))


def known_candidate(batch: DataFrame, name: str) -> str:
    """The name, if it has the form of a candidate's and is in the batch; ValueError otherwise."""
    if not CANDIDATE_NAME.fullmatch(name):
        raise ValueError(f"{name} isn't a candidate's name")
    if not batch.filter(F.col("candidate_id") == name).limit(1).count():
        raise ValueError(f"{name} isn't in the batch")
    return name


def check_members(crop: DataFrame, members: DataFrame, columns: list[str]) -> None:
    """Members are some, each once, in the crop, with the crop's values; ValueError otherwise."""
    counts = members.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).first()
    if not counts["n"] or counts["n"] != counts["d"]:
        raise ValueError("members are missing or repeated")
    other = crop.select("row_id", *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = members.join(other, "row_id").agg(F.count("*").alias("n"), F.count_if(same).alias("same")).first()
    if found["n"] != counts["n"] or found["same"] != counts["n"]:
        raise ValueError("members aren't in the crop as they are saved")


def check_batch(batch: DataFrame, version: int, key: str = "candidate_id") -> DataFrame:
    """batch, if all rows have the schema version and every candidate is there once; ValueError otherwise."""
    r = batch.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.count_if(~F.col("schema_version").eqNullSafe(version)).alias("old")).first()
    if r["old"] or r["n"] != r["d"]:
        raise ValueError("another schema version, or a candidate more than once")
    return batch


def resolved(batch: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """name, candidate_id and matches of the names that are an id or a former id of exactly one candidate."""
    known = batch.select("candidate_id", F.explode(F.concat(F.array("candidate_id"), F.coalesce("legacy_ids", F.array().cast("array<string>")))).alias(name)).distinct()
    met = known.join(names.select(name).distinct(), name).groupBy(name).agg(F.count("*").alias("matches"), F.min("candidate_id").alias("candidate_id"))
    return met.filter("matches = 1").select(name, "candidate_id", "matches")


def candidate_record(batch: DataFrame, name: str) -> DataFrame:
    """The one row whose id or former id is a name; ValueError unless it is one."""
    found = batch.join(resolved(batch, batch.sparkSession.createDataFrame([(name,)], "name string")).select("candidate_id"), "candidate_id", "left_semi")
    if found.limit(2).count() != 1:
        raise ValueError(f"{name} isn't one candidate")
    return found


def batch_counts(candidates: DataFrame, parent: str = "is_parent", region: str = "region", group: str = "group") -> DataFrame:
    """One row: candidates, parents among them, additions, and distinct regions and evaluation groups."""
    p = F.col(parent)
    return candidates.agg(F.count("*").alias("candidates"), F.count_if(p).alias("parents"), F.count_if(~p).alias("additions"), F.countDistinct(region).alias("regions"), F.countDistinct(group).alias("groups"))


def pair_evidence(membership: DataFrame, boxes: DataFrame, group: str = "candidate_id", row: str = "row_id", source: str = "source") -> DataFrame:
    """Pairs of candidates of a source that share rows or whose boxes overlap: shared rows, their share of the smaller, and whether boxes overlap."""
    shared = shared_members(membership, group, row, source)
    meet = overlapping_boxes(boxes, group, source).select("a", "b", F.lit(True).alias("boxes_overlap"))
    out = shared.join(meet, ["a", "b"], "full")
    return out.select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("smaller_share", F.lit(0.0)).alias("smaller_share"), F.coalesce("boxes_overlap", F.lit(False)).alias("boxes_overlap"))


#: The version of saved review batches, and the share of the smaller membership from which two are alike.
BATCH_VERSION, ALIKE = 1, 0.8


@dataclass
class ReviewBatch:
    """candidates (place, candidate_id, source, crop, label, is_parent, point_count, bounds, clearance, hint, region, group, aliases), their memberships (candidate_id, row_id), evidence of pairs, and groups of crops."""

    candidates: DataFrame
    memberships: DataFrame
    evidence: DataFrame
    groups: DataFrame
    policy: dict


def prepare_batch(components: DataFrame, membership: DataFrame, target: int = 20, minimum: int = 100, near_boundary: float = 0.0) -> ReviewBatch:
    """A review batch: parents, and components chosen from crops in turn until there are `target`.

    components: source, crop, region, label, is_parent, point_count, clearance and bounds; membership: source, crop,
    label, row_id. Only components of `minimum` points beyond `near_boundary` from the crop's
    edge are added, in turns of shapes by size; one that shares 80 % of the smaller membership with
    a chosen one is its alias. Crops of one source and region, or with boxes that overlap, are one group.
    """
    at = ["source", "crop", "label"]
    keyed = components.withColumn("key", F.concat_ws("|", *at)).withColumn("hint", shape_hint(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]))
    keyed = cut(keyed, "components")
    rows = cut(membership.select(F.concat_ws("|", *at).alias("key"), "source", "row_id").distinct(), "memberships")
    names = membership_id(rows, ["key", "source"], F.col("source")).select("key", "candidate_id")
    pool = keyed.filter(~F.col("is_parent") & (F.col("point_count") >= minimum) & (F.col("clearance") > near_boundary))
    pool = interleaved(pool, "crop", "hint", [F.desc("point_count"), F.desc("clearance"), "source", "label"])
    anchors = placed(keyed.filter("is_parent").select("key", *at), [*at])
    shared = cut(shared_members(rows, "key", "row_id", "source"), "shared-members")
    chosen, aliases = select_in_turn(anchors, pool.select("key", F.col("crop").alias("group"), "turn"), shared.filter(F.col("smaller_share") >= ALIKE), target)
    aliases = aliases.join(names, "key").groupBy(F.col("of").alias("key")).agg(F.sort_array(F.collect_set("candidate_id")).alias("aliases"))  # of `target` candidates
    crops = components.groupBy("source", "crop", "region").agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    crops = crops.withColumn("crop", F.concat_ws("|", "source", "crop"))
    groups = cut(crop_groups(crops, "crop"), "crop-groups")
    group_of = groups.select(F.col("crop").alias("__crop"), F.col("group_id").alias("group"))
    candidates = chosen.join(keyed, "key").join(names, "key").join(aliases, "key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    candidates = cut(candidates.join(group_of, F.concat_ws("|", "source", "crop") == F.col("__crop")).drop("__crop"), "candidates")
    members = cut(rows.join(candidates.select("key", "candidate_id"), "key").select("candidate_id", "source", "row_id"), "candidate-members")
    boxes = candidates.select("candidate_id", "source", *[f"{n}_{a}" for a in AXES for n in ("min", "max")])
    evidence = pair_evidence(members, boxes)
    policy = {"target": target, "minimum_points": minimum, "near_boundary": near_boundary, "alike": ALIKE}
    return ReviewBatch(candidates.drop("key"), members, evidence, groups, policy)


def save_batch(batch: ReviewBatch, root: str, now: dt.datetime | None = None) -> dict:
    """The batch's tables and manifest in a new folder under root, and root/active_batch.json pointing there. Returns the manifest.

    The manifest has the candidates (as many as were wanted), counts, the policy of the selection and
    a fingerprint of each membership, which is checked when it is loaded.
    """
    spark = batch.candidates.sparkSession
    now = now or dt.datetime.now(dt.timezone.utc)
    folder = f"{root.rstrip('/')}/{now:%Y%m%dT%H%M%S_%fZ}_{uuid.uuid4().hex[:8]}"
    prints = {r["candidate_id"]: r["fingerprint"] for r in region_fingerprint(batch.memberships, ["source"], ["candidate_id"]).collect()}  # a row for each candidate
    if len(prints) != batch.candidates.count():
        raise ValueError("two candidates have the same membership")
    for name in ("candidates", "memberships", "evidence", "groups"):
        getattr(batch, name).write.mode("errorifexists").parquet(f"{folder}/{name}")
    rows = [json.loads(r["j"]) for r in batch.candidates.orderBy("place").select(F.to_json(F.struct("*")).alias("j")).collect()]
    counts = batch_counts(batch.candidates).first().asDict()
    manifest = {
        "schema_version": BATCH_VERSION, "batch_id": folder.rsplit("/", 1)[-1], "batch_path": f"{folder}/batch.json", "created_utc": now.isoformat(), "counts": counts, "policy": batch.policy,
        "candidates": [r | {"legacy_ids": r.get("legacy_ids") or [], "membership_fingerprint": prints[r["candidate_id"]]} for r in rows],
    }
    create_text(spark, manifest["batch_path"], json_text(manifest))
    replace_text(spark, f"{root.rstrip('/')}/active_batch.json", json_text({"batch_path": manifest["batch_path"]}))
    return manifest


def load_batch(spark: SparkSession, path: str) -> dict:
    """The manifest of a saved batch by its file, its folder or a pointer to it; ValueError for another version or a candidate that is there twice."""
    manifest = read_json(spark, f"{path.rstrip('/')}/batch.json" if is_folder(spark, path) else path)
    if "candidates" not in manifest and "batch_path" in manifest:
        manifest = read_json(spark, manifest["batch_path"])
    if manifest.get("schema_version") != BATCH_VERSION:
        raise ValueError("another version of saved batches")
    ids = [c["candidate_id"] for c in manifest["candidates"]]
    if len(ids) != len(set(ids)):
        raise ValueError("a candidate is there more than once")
    return manifest


def load_candidate(spark: SparkSession, path: str, name: str, crop: DataFrame, columns: list[str] | None = None, context: bool = True) -> tuple[dict, DataFrame]:
    """A saved candidate's record and its points of a crop, with member; without context its members only.

    ValueError unless the name is the id or a former id of one candidate, its membership is as it was saved, gives the id
    again, and lies in the crop, with the values of `columns` if membership has them.
    """
    manifest = load_batch(spark, path)
    found = [c for c in manifest["candidates"] if name == c["candidate_id"] or name in c["legacy_ids"]]
    if len(found) != 1:
        raise ValueError(f"{name} isn't one candidate")
    record, folder = found[0], manifest["batch_path"].rsplit("/", 1)[0]
    if not CANDIDATE_NAME.fullmatch(record["candidate_id"]):
        raise ValueError("a candidate's id is malformed")
    members = spark.read.parquet(f"{folder}/memberships").filter(F.col("candidate_id") == record["candidate_id"])
    print_ = region_fingerprint(members, ["source"], ["candidate_id"]).first()
    if print_ is None or print_["fingerprint"] != record["membership_fingerprint"]:
        raise ValueError("the membership isn't as it was saved")
    if membership_id(members.drop("candidate_id"), ["source"], F.col("source")).first()["candidate_id"] != record["candidate_id"]:
        raise ValueError("the membership doesn't give the candidate's id")
    check_members(crop, members.select("row_id", *(columns or [])), columns or [])
    marked = crop.join(members.select("row_id").distinct().withColumn("__m", F.lit(True)), "row_id", "left").withColumn("member", F.col("__m").isNotNull()).drop("__m")
    return record, marked if context else marked.filter("member")


def original_candidate(membership: DataFrame, crop: DataFrame, name: str, columns: list[str], key: str = "candidate_id") -> DataFrame:
    """The crop's points of a saved candidate, without clustering again; ValueError unless they are there as saved."""
    rows = membership.filter(F.col(key) == name).drop(key)
    check_members(crop, rows, columns)
    return crop.join(rows.select("row_id"), "row_id", "left_semi")


def observations(reports: DataFrame, expected: int | None = None) -> DataFrame:
    """A row for each crop of the latest report of each kind (kind, path, crops array<struct>): its report and the crop's fields. expected: an error for another number of crops."""
    last = reports.groupBy("kind").agg(F.max_by(F.struct("path", "crops"), "path").alias("r"))
    out = last.select("kind", F.col("r.path").alias("path"), F.inline("r.crops"))
    if expected is not None and out.count() != expected:
        raise ValueError(f"not {expected} crops")
    return out


def collect_observations(spark: SparkSession, reports: DataFrame, features: str | None = None, expected: int | None = None) -> DataFrame:
    """A row for each item of the latest report of each kind: candidate, report, region and its id, crop, membership, and where its features are.

    reports: kind, path of JSON documents with source_identity and items (candidate_id, region, region_roi, crop and membership, each path and sha256). Crops and
    memberships are hashed by tasks, a piece at a time; ValueError for one that is missing or isn't as its report says, and for
    another number of items than expected. features: a document with entries (id); candidates without one have no reference.
    """
    latest = reports.groupBy("kind").agg(F.max("path").alias("path"))
    rows = []
    for r in file_facts(latest, text=True).orderBy("kind").collect():  # a row for each kind
        if r["error"]:
            raise ValueError(f"{r['path']}: {r['error']}")
        report = json.loads(r["text"])
        for item in report["items"]:
            region_id = f"region_{content_key({'source_identity': report['source_identity'], 'roi': item['region_roi']})[:16]}"
            rows.append((r["kind"], item["candidate_id"], r["path"], report["source_identity"], item["region"], region_id, *(item[k][v] for k in ("crop", "membership") for v in ("path", "sha256"))))
    known = {e["id"] for e in read_json(spark, features)["entries"]} if features else set()
    columns = "kind string, candidate_id string, report_path string, source_identity string, region string, region_id string, crop_path string, crop_sha256 string, membership_path string, membership_sha256 string, feature_reference string"
    found = spark.createDataFrame([(*row, features if row[1] in known else None) for row in rows], columns)
    if expected is not None and len(rows) != expected:
        raise ValueError(f"{len(rows)} items, not {expected}")
    files = found.select(F.inline(F.array(*[F.struct(F.col(f"{k}_path").alias("path"), F.col(f"{k}_sha256").alias("said")) for k in ("crop", "membership")]))).distinct()
    wrong = file_facts(files).filter("error is not null or sha256 <> said").orderBy("path").first()
    if wrong is not None:
        raise ValueError(f"{wrong['path']}: {wrong['error'] or 'not as its report says'}")
    return found
