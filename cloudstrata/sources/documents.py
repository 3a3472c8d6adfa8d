"""JSON and text documents around surveys: manifests, sidecars, histories; and their sinks."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.sources.las import open_file, read_header
from cloudstrata.sources.wkt import facts, parse

#: Fixed by the sidecars' format: what begins the line with the coordinate system.
WKT_LINE = r"^  WKT \(GDAL\): (.*)$"


_FACTS = "kind string, name string, unit string, unit_factor double, vertical_unit string, vertical_factor double, epsg string, error string"


def crs_facts(texts: DataFrame, text: str = "wkt") -> DataFrame:
    """texts with kind, name, horizontal and vertical unit and their factors, EPSG code, and the error of those that can't be read."""
    names = [f.split()[0] for f in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(at).to_pylist():
                try:
                    rows.append(facts(parse(t or "")) | {"error": None})
                except ValueError as error:
                    rows.append(dict.fromkeys(names) | {"error": str(error)})
            kinds = [pa.float64() if n.endswith("factor") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=[*batch.schema.names, *names])

    at = texts.columns.index(text)
    return texts.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), _FACTS]))


def coordinate_systems(lines: DataFrame, path: str = "path", line: str = "value") -> DataFrame:
    """path, wkt and the facts of crs_facts, of the sidecar lines that have the coordinate system."""
    rows = lines.select(path, F.regexp_extract(line, WKT_LINE, 1).alias("wkt")).filter("wkt <> ''")
    return crs_facts(rows)


def read_sidecars(spark: SparkSession, paths: list[str]) -> DataFrame:
    return coordinate_systems(spark.read.text(paths).withColumn("path", F.input_file_name()))


def history_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of comparison_rows of all finished manifests."""
    docs = spark.read.option("multiLine", True).json(pattern)
    return docs.filter("comparison_rows is not null").select(F.input_file_name().alias("path"), F.explode("comparison_rows").alias("row"))


def catalogue(runs: DataFrame, inputs: DataFrame, fields: list[str], key: str = "side") -> DataFrame:
    """Saved runs beside the input manifest: a run without header is an error row, others say for each lineage field whether it is equal."""
    left = runs.alias("r").join(inputs.alias("i"), key, "left")
    same = [F.col(f"r.{f}").eqNullSafe(F.col(f"i.{f}")).alias(f"same_{f}") for f in fields]
    lineage = F.lit(True)
    for f in fields:
        lineage = lineage & F.col(f"r.{f}").eqNullSafe(F.col(f"i.{f}"))
    return left.select(F.col(key), *[F.col(f"r.{c}").alias(c) for c in runs.columns if c != key], *same, lineage.alias("lineage_ok"))


def file_facts(paths: DataFrame, path: str = "path", text: bool = False) -> DataFrame:
    """The rows of paths with length, sha256 and error of each file, read by the tasks a piece at a time; text: also what documents say.

    A file that is missing or can't be read is a row with an error, not a failure.
    """
    out = "length long, sha256 string, text string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                digest, length, said = hashlib.sha256(), 0, []
                try:
                    with open_file(name) as f:
                        while piece := f.read(1 << 22):
                            digest.update(piece)
                            length += len(piece)
                            if text:
                                said.append(piece)
                    found.append((length, digest.hexdigest(), b"".join(said).decode() if text else None, None))
                except (OSError, ValueError, TypeError, pa.ArrowException) as error:
                    found.append((None, None, None, f"{type(error).__name__}: {error}".split("\n")[0]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in found], t) for k, t in enumerate(kinds))], names=[*batch.schema.names, "length", "sha256", "text", "error"])

    at = paths.columns.index(path)
    rows = paths.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema), out]))
    return rows if text else rows.drop("text")


def header_facts(paths: DataFrame, path: str = "path") -> DataFrame:
    """The rows of paths with point_count, point_format and error of each LAS file; one that is missing or broken is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                try:
                    h = read_header(name)
                    found.append((h["point_count"], h["point_format"], None))
                except (OSError, ValueError, TypeError, struct.error, pa.ArrowException) as error:
                    found.append((None, None, f"{type(error).__name__}: {error}".split("\n")[0]))
            kinds = (pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in found], t) for k, t in enumerate(kinds))], names=[*batch.schema.names, "point_count", "point_format", "error"])

    at = paths.columns.index(path)
    return paths.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema), "point_count long, point_format int, error string"]))


#: What of a saved run's source has to be as in the input manifest.
LINEAGE = ("source_path", "source_point_count", "sample_point_count", "selection_probability", "seed")


def saved_runs(spark: SparkSession, input_manifest: str, runs: list[tuple[str, str]]) -> DataFrame:
    """A row for each saved run (name, path of its manifest) and side: counts of its output files by their headers, whether its lineage is that of the input manifest, parameters, and status.

    A run whose manifest is missing or broken is one row without a side, and a missing or broken output is told in status; neither is a failure.
    Output paths are relative to their manifest.
    """
    inputs = read_json(spark, input_manifest)
    documents = file_facts(spark.createDataFrame(runs, "run string, path string"), text=True).collect()  # a row for each run
    rows, files = [], []
    for d in documents:
        try:
            manifest = json.loads(d["text"] or "") if d["error"] is None else None
            sides = sorted(manifest["sources"].items()) if manifest is not None else []
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            manifest, sides = None, []
            d = d.asDict() | {"error": f"{type(error).__name__}: {error}"}
        if manifest is None:
            rows.append((d["run"], None, None, None, None, d["error"]))
        for side, source in sides:
            known = inputs.get("sources", {}).get(side, {})
            same = all(source.get(f) == known.get(f) for f in LINEAGE) and manifest.get("shared_roi") == inputs.get("shared_roi")
            rows.append((d["run"], side, same, json_text(manifest.get("parameters", {})), source.get("sample_point_count"), None))
            for label in ("ground", "non_ground"):
                relative = source.get("output_files", {}).get(label)
                files.append((d["run"], side, label, f"{d['path'].rsplit('/', 1)[0]}/{relative}" if relative else None))
    table = spark.createDataFrame(rows, "run string, side string, same_lineage boolean, parameters string, sample_points long, error string")
    heads = header_facts(spark.createDataFrame(files, "run string, side string, label string, path string"))
    of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    counts = heads.groupBy("run", "side").agg(of("ground", "point_count").alias("ground_points"), of("non_ground", "point_count").alias("non_ground_points"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("label", F.lit(": "), "error")))), "; ").alias("missing"))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("missing", F.lit("")) != "", F.col("missing")).otherwise("saved partitions available")
    return table.join(counts, ["run", "side"], "left").select("run", "side", "same_lineage", "parameters", "sample_points", "ground_points", "non_ground_points", status.alias("status"))


def catalogue(runs: DataFrame, inputs: DataFrame, fields: list[str], key: str = "side") -> DataFrame:
    """Saved runs beside the input manifest: a run without header is an error row, others say for each lineage field whether it is equal."""
    left = runs.alias("r").join(inputs.alias("i"), key, "left")
    same = [F.col(f"r.{f}").eqNullSafe(F.col(f"i.{f}")).alias(f"same_{f}") for f in fields]
    lineage = F.lit(True)
    for f in fields:
        lineage = lineage & F.col(f"r.{f}").eqNullSafe(F.col(f"i.{f}"))
    return left.select(F.col(key), *[F.col(f"r.{c}").alias(c) for c in runs.columns if c != key], *same, lineage.alias("lineage_ok"))


def latest_path(paths: DataFrame, kind: str, path: str = "path") -> DataFrame:
    """The last path of each kind in the order of text."""
    return paths.groupBy(kind).agg(F.max(path).alias(path))


def write_comparison_csv(rows: DataFrame, folder: str) -> None:
    """Rows as CSV; nested cells as JSON."""
    cells = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).write.mode("errorifexists").option("header", True).csv(folder)


def plain(value: object) -> object:
    """What JSON can say of a value: NaN and infinities are null, NumPy's numbers and arrays plain ones, dates ISO text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def json_text(value: object) -> str:
    return json.dumps(plain(value), sort_keys=True, allow_nan=False)


def atomic_json(path: str, value: object) -> None:
    """Replaces a driver-side document in one step."""
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(json_text(value))
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def _local(path: str) -> str | None:
    """The local path, if it is one."""
    return path.removeprefix("file://") if path.startswith("file://") else None if "://" in path else path


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new document in any store; FileExistsError if it is there, so of two writers one alone succeeds."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        # written apart and linked under its name: readers see all of it or nothing, and a link never replaces a file
        temporary = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(temporary, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(temporary, local)
        finally:
            os.remove(temporary)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception.getClass().getName()):
            raise FileExistsError(path) from None
        raise
    out.write(bytearray(text.encode()))
    out.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A document in any store, new or instead of the one that is there."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        temporary = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(temporary, "x", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, local)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def read_json(spark: SparkSession, path: str) -> dict:
    """One document of any store, on the driver."""
    found = spark.read.option("wholetext", True).text(path).collect()
    if len(found) != 1:
        raise ValueError(f"{path} isn't one document")
    return json.loads(found[0]["value"])
