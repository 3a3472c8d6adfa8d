"""Human reviews: an append-only history with optimistic revisions, exposures, progress and reference rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.sources.documents import atomic_json, create_text, exists, json_text

#: Fixed vocabularies. Version 1 has "complete object", version 2 "usable single object".
QUALITIES = {
    1: ("complete object", "incomplete object", "multiple objects", "ground contamination", "unclear"),
    2: ("usable single object", "incomplete object", "multiple objects", "ground contamination", "unclear"),
}
DECISIONS = ("accept", "correct", "unlabeled")
CLASSES = ("Vegetation", "Utility pole", "Streetlight", "Traffic sign", "Fence or railing", "Building / wall", "Vehicle", "Bicycle", "Debris")
UNKNOWN = ("", "unknown", "unknown/uncertain", "unknown / uncertain")
USABLE = "usable single object"
LABEL_CHARS, NOTE_CHARS = 160, 10_000
REVIEW = (
    "candidate_id string, revision int, saved_utc timestamp, human_class string, crop_quality string, notes string, reviewer_name string, shared_object_group string, vocabulary int, "
    "suggestions_revealed boolean, reveal_event_count long"
)
POSITION = "candidate_id string, at_utc timestamp, reviewer_name string"
EXPOSURE = "candidate_id string, at_utc timestamp, reviewer_name string, suggestions_available boolean"


def normal_label(c: Column) -> Column:
    """A trimmed class; null for what says unknown."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*UNKNOWN), t)


def latest(history: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the greatest revision of each key; aggregated before the shuffle."""
    columns = history.columns
    return history.groupBy(key).agg(F.max_by(F.struct(*columns), revision).alias("__r")).select("__r.*")


def progress(candidates: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """One row: reviewed and all candidates."""
    done = reviews.select(key).distinct().withColumn("__done", F.lit(True))
    return candidates.join(done, key, "left").agg(F.count("__done").alias("reviewed"), F.count("*").alias("total"))


def next_unreviewed(candidates: DataFrame, reviewed: Column, order: str, current: int) -> DataFrame:
    """One row: the first candidate without a review after `current` in order, around the end; `current` itself if none is left."""
    after = F.when(F.col(order) > current, 0).otherwise(1)
    open_ones = candidates.filter(~reviewed & (F.col(order) != current)).agg(F.min(F.struct(after.alias("lap"), F.col(order).alias("at"))).alias("n"))
    return open_ones.select(F.coalesce(F.col("n.at"), F.lit(current).cast("long")).alias("next"))


def eligible(label: Column, quality: Column) -> Column:
    """May be used for classification later: has a class and is a usable single object."""
    return label.isNotNull() & F.coalesce(quality == USABLE, F.lit(False))


def exposure_summary(events: DataFrame, key: str) -> DataFrame:
    """Whether suggestions were seen, events, and the last of them."""
    return events.groupBy(key).agg(F.bool_or("suggestions_available").alias("suggestions_revealed"), F.count("*").alias("reveal_event_count"), F.max("at_utc").alias("last_reveal_utc"))


def reference_rows(candidates: DataFrame, reviews: DataFrame, groups: DataFrame, exposures: DataFrame | None = None, key: str = "candidate_id", predictions: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Every candidate with its latest review, evaluation group and eligibility; unreviewed labels stay null.

    predictions (key, prediction_path, context_prediction_path) and features (key, feature_reference) are references only, null where there are none.
    """
    last = latest(reviews, key, "revision")
    out = candidates.join(last, key, "left").join(groups.select(key, F.col("group").alias("evaluation_group")), key, "left")
    if exposures is not None:
        out = out.join(exposure_summary(exposures, key).withColumnsRenamed({"suggestions_revealed": "exposed", "reveal_event_count": "exposures"}), key, "left")
    for given in (predictions, features):
        if given is not None:
            out = out.join(given, key, "left")
    return out.withColumns({"reviewed": F.col("revision").isNotNull(), "eligible_for_later_classification": eligible(F.col("human_class"), F.col("crop_quality"))})


#: Columns that tell what a model said: no reviewer sees them before asking.
SUGGESTIONS = ("predictions", "prediction_snapshot", "evidence_references", "evidence_report", "scores", "top1", "disagreement", "feature_reference")


def public_view(candidates: DataFrame) -> DataFrame:
    """Candidates without what models said of them."""
    return candidates.drop(*SUGGESTIONS)


def evidence_references(candidates: DataFrame, evidence: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key and references: an array of report path, model and prompts for each saved piece of evidence (key, path, model, prompts), in the order of paths; empty without any."""
    found = evidence.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", "model", "prompts"))).alias("references"))
    none = F.array().cast("array<struct<path:string,model:string,prompts:array<string>>>")
    return candidates.select(key).join(found, key, "left").select(key, F.coalesce("references", none).alias("references"))


class RevisionConflict(ValueError):
    """The review was changed by someone else since it was read."""


class ReviewStore:
    """Reviews and exposures in one folder, by any number of writers; earlier revisions are never touched.

    A revision is a document of its own under its candidate and number, created exclusively: of two
    writers that both saw revision n, one gets n + 1 and the other a RevisionConflict.
    """

    def __init__(self, spark: SparkSession, folder: str, candidates: DataFrame, vocabulary: int = 2):
        self.spark, self.folder, self.candidates, self.vocabulary = spark, folder, candidates, vocabulary

    @property
    def classes(self) -> list[str]:
        """The given classes, then those that reviews have added, in the order of their first use: they outlive a restart."""
        used = self.reviews.filter(F.col("human_class").isNotNull()).groupBy("human_class").agg(F.min("saved_utc").alias("at"))
        return [*CLASSES, *(r["human_class"] for r in used.orderBy("at", "human_class").collect() if r["human_class"] not in CLASSES)]

    @property
    def cursor(self) -> str | None:
        """Where the last reviewer was, if that candidate is there still, else the first candidate."""
        last = self._read("positions", POSITION).agg(F.max_by("candidate_id", "at_utc").alias("c")).first()["c"]
        if last is not None and self.candidates.filter(F.col("candidate_id") == last).limit(1).count():
            return last
        return self.candidates.agg(F.min("candidate_id").alias("c")).first()["c"]

    def position(self, candidate_id: str, reviewer: str = "") -> None:
        """Keeps where a reviewer is."""
        self._known(candidate_id)
        row = (candidate_id, dt.datetime.now(dt.timezone.utc), reviewer[:LABEL_CHARS])
        self.spark.createDataFrame([row], POSITION).write.mode("append").parquet(f"{self.folder}/positions")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def reviews(self) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/reviews"):
            return self.spark.createDataFrame([], REVIEW)
        return self.spark.read.schema(REVIEW).json(f"{self.folder}/reviews/*/*.json")

    @property
    def exposures(self) -> DataFrame:
        return self._read("exposures", EXPOSURE)

    def _known(self, candidate_id: str) -> None:
        if not self.candidates.filter(F.col("candidate_id") == candidate_id).limit(1).count():
            raise ValueError(f"no candidate {candidate_id}")

    def reveal(self, candidate_id: str, reviewer: str = "", available: bool = True, evidence: DataFrame | None = None) -> list:
        """The saved evidence of a candidate, if any is given; logs that it was asked for, whether there was any or not."""
        self._known(candidate_id)
        found = evidence.filter(F.col("candidate_id") == candidate_id).collect() if evidence is not None else []
        row = (candidate_id, dt.datetime.now(dt.timezone.utc), reviewer[:LABEL_CHARS], bool(found) if evidence is not None else available)
        self.spark.createDataFrame([row], EXPOSURE).write.mode("append").parquet(f"{self.folder}/exposures")
        return found

    def save(self, candidate_id: str, human_class: str | None, crop_quality: str, expected_revision: int | None = None, notes: str = "", reviewer: str = "", shared_object_group: str | None = None) -> int:
        """Appends a revision and returns its number. RevisionConflict if another number was expected."""
        self._known(candidate_id)
        label = (human_class or "").strip()
        label = None if label.lower() in UNKNOWN else label
        if label and len(label) > LABEL_CHARS:
            raise ValueError(f"a class has at most {LABEL_CHARS} characters")
        if crop_quality not in QUALITIES[self.vocabulary]:
            raise ValueError(f"unknown quality {crop_quality}")
        mine = self.reviews.filter(F.col("candidate_id") == candidate_id)
        revision = mine.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("r")).first()["r"]
        if expected_revision is not None and expected_revision != revision:
            raise RevisionConflict(f"revision {revision}, not {expected_revision}")
        seen = self.exposures.filter(F.col("candidate_id") == candidate_id).agg(F.coalesce(F.bool_or("suggestions_available"), F.lit(False)).alias("a"), F.count("*").alias("n")).first()
        group = (shared_object_group or "").strip()[:LABEL_CHARS] or None
        row = (candidate_id, revision + 1, dt.datetime.now(dt.timezone.utc), label, crop_quality, notes[:NOTE_CHARS], reviewer[:LABEL_CHARS], group, self.vocabulary, seen["a"], seen["n"])
        names = [f.split()[0] for f in REVIEW.split(", ")]
        try:
            create_text(self.spark, f"{self.folder}/reviews/{hashlib.sha256(candidate_id.encode()).hexdigest()[:40]}/{revision + 1:09d}.json", json_text(dict(zip(names, row, strict=True))))
        except FileExistsError:
            raise RevisionConflict(f"revision {revision + 1} is there already") from None
        return revision + 1

    def decide(self, candidate_id: str, decision: str, label: str | None, crop_quality: str, notes: str = "") -> int:
        """A review of the first vocabulary: a label is needed unless the decision leaves it open."""
        if decision not in DECISIONS:
            raise ValueError(f"unknown decision {decision}")
        if (decision == "unlabeled") == bool((label or "").strip()):
            raise ValueError("a label is given unless the decision is unlabeled")
        return ReviewStore(self.spark, self.folder, self.candidates, 1).save(candidate_id, label, crop_quality, notes=notes)

    def export(self, groups: DataFrame, folder: str) -> None:
        """Reference rows as one CSV file with a header."""
        rows = reference_rows(self.candidates, self.reviews, groups)
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)

    def export_file(self, groups: DataFrame, path: str) -> dict:
        """Reference rows of a review's candidates as one CSV file on the driver, with a byte-order mark, put in place in one step, and a manifest of it beside."""
        rows = reference_rows(self.candidates, self.reviews, groups)
        data = rows.orderBy("candidate_id").toPandas()
        data.to_csv(f"{path}.tmp", index=False, encoding="utf-8-sig")
        os.replace(f"{path}.tmp", path)
        with open(path, "rb") as f:
            digest = hashlib.sha256(f.read()).hexdigest()
        manifest = {"rows": len(data), "reviewed": int(data["reviewed"].sum()), "eligible": int(data["eligible_for_later_classification"].sum()), "columns": [*data.columns], "sha256": digest}
        atomic_json(f"{path}.manifest.json", manifest)
        return manifest
