"""LAS 1.2-1.4 files (public ASPRS layout) as Spark sources and as a sink.

    register(spark)
    spark.read.format("las").load(path)           points, read in ranges of records
    spark.read.format("las_header").load(path)    one row for each file
    write_las(points, path, like=other_path)      points in order of row_id, header and VLRs of another file

path is a file or a comma-separated list; files are opened through pyarrow's file
systems, so any store it knows will do. row_id is the place in the file.

Filters on coordinates and row_id reach the reader: files whose header's bounds don't meet
them are left out, and with an index (index_las: bounds of each BLOCK records, a small table for each
file) so are blocks. With `overview` only so many evenly spaced records of each file are read,
by seeking to them; partitions are made by wanted records.

The sink gives every task the places of its records: it writes them where they belong in a
file that has the header already, so any number of tasks write one file, a task that runs again writes
the same bytes, and the driver sees counts and bounds only. The file gets its name when all is there.
That needs a file system in which tasks can write to parts of a file; in others each task writes
a whole file of its own, in one folder.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cloudstrata.functions.numbering import placed
from cloudstrata.types import HEADER, POINT

CHUNK = 1_000_000
#: Records of a block of the index; wanted records of a partition of an overview; bytes between wanted records up to which it is cheaper to read on than to seek.
BLOCK, WANTED, NEAR_BYTES = 50_000, 5_000, 1_024
#: Record layouts by point format: the fields in order of their bytes.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_TIME, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR}


def open_file(path: str):
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def read_header(path: str) -> dict:
    """The header and the variable-length records of a file."""
    with open_file(path) as f:
        size = f.size()
        head = f.read(min(375, size))
        if head[:4] != b"LASF" or len(head) < 227:
            raise ValueError(f"{path} isn't a LAS file")
        major, minor = head[24], head[25]
        day, year, header_size, offset, n_vlr, fmt, length, old_count = struct.unpack_from("<HHHIIBHI", head, 90)
        scales, offsets = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        box = struct.unpack_from("<6d", head, 179)
        count, evlr_at, n_evlr = old_count, 0, 0
        if (major, minor) >= (1, 4):
            evlr_at, n_evlr, count = struct.unpack_from("<QIQ", head, 235)
            count = count or old_count

        def records(at: int, n: int, kind: str) -> list[dict]:
            out = []
            fixed = 54 if kind == "VLR" else 60
            for _ in range(n):
                f.seek(at)
                raw = f.read(fixed)
                if len(raw) < fixed:
                    break
                user, rid = _text(raw[2:18]), struct.unpack_from("<H", raw, 18)[0]
                body = struct.unpack_from("<H" if kind == "VLR" else "<Q", raw, 20)[0]
                out.append({"type": kind, "user_id": user, "record_id": rid, "description": _text(raw[fixed - 32 : fixed]), "record_length": body})
                at += fixed + body
            return out

        fmt &= 0x3F
        names = [n for n, _ in FORMATS.get(fmt, [])]
        return {
            "path": path, "file_size_bytes": size, "las_version": f"{major}.{minor}", "point_format": fmt, "point_record_length": length, "point_count": count,
            "generating_software": _text(head[58:90]), "system_identifier": _text(head[26:58]), "creation_date": f"{year}-{day}", "scales": list(scales), "offsets": list(offsets),
            "mins": list(box[1::2]), "maxs": list(box[0::2]), "point_dimensions": names, "vlrs": records(header_size, n_vlr, "VLR"), "evlrs": records(evlr_at, n_evlr, "EVLR"), "data_offset": offset,
        }


def record_type(header: dict) -> np.dtype:
    """The layout of a file's records."""
    fields = FORMATS.get(header["point_format"])
    if fields is None:
        raise ValueError(f"point format {header['point_format']} isn't known")
    used = sum(np.dtype(t).itemsize for _, t in fields)
    extra = header["point_record_length"] - used
    return np.dtype(fields + ([("extra", f"V{extra}")] if extra else []))


def decode(records: np.ndarray, header: dict, places: np.ndarray) -> pa.RecordBatch:
    """Records with their places as rows of types.POINT."""
    n = len(records)
    names = records.dtype.names
    new = "flags" in names
    bits, flags = records["bits"], records["flags"] if new else records["classification"] >> 5
    no = np.zeros(n, bool)
    columns = {
        "row_id": places, "raw_x": records["X"], "raw_y": records["Y"], "raw_z": records["Z"],
        **{a: records[a.upper()] * header["scales"][k] + header["offsets"][k] for k, a in enumerate("xyz")},
        "intensity": records["intensity"], "return_number": bits & (15 if new else 7), "number_of_returns": bits >> 4 if new else bits >> 3 & 7,
        **{b: flags >> k & 1 == 1 for k, b in enumerate(("synthetic", "key_point", "withheld"))}, "overlap": flags >> 3 & 1 == 1 if new else no,
        "scanner_channel": flags >> 4 & 3 if new else np.zeros(n, np.int16), "scan_direction_flag": (flags if new else bits) >> 6 & 1 == 1, "edge_of_flight_line": (flags if new else bits) >> 7 & 1 == 1,
        "classification": records["classification"] if new else records["classification"] & 31, "user_data": records["user_data"], "scan_angle": records["scan_angle"],
        "point_source_id": records["point_source_id"], **{k: records[k] if k in names else None for k in ("gps_time", "red", "green", "blue")}, "file_id": None,
    }
    schema = to_arrow_schema(POINT)
    arrays = [pa.array([header["path"]] * n) if f.name == "file_id" else pa.nulls(n, f.type) if columns[f.name] is None else pa.array(np.ascontiguousarray(columns[f.name])).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _paths(options) -> list[str]:
    return [p for p in (options.get("path") or "").split(",") if p]


class RecordRange(InputPartition):
    """Records start to start + count of a file; of an overview, the wanted ones with these numbers."""

    def __init__(self, path: str, start: int, count: int):
        super().__init__((path, start, count))


def wanted_records(total: int, most: int, start: int, count: int) -> np.ndarray:
    """Numbers start to start + count of `most` evenly spaced records of a file: all if there are no more, else the first to the last, rounded down."""
    k = np.arange(start, start + count)
    if total <= most:
        return k
    if most == 1:
        return np.zeros(count, np.int64)
    return np.where(k == most - 1, total - 1, np.floor(k * ((total - 1) / (most - 1)))).astype(np.int64)


class LasReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.chunk = _paths(options), int(options.get("chunk_points", CHUNK))
        self.index, self.overview = options.get("index"), int(options["overview"]) if options.get("overview") else None
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters):
        """Keeps the bounds of coordinates and row_id. Spark filters the rows, too: blocks hold other points as well."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("x", "y", "z", "row_id") and self.overview is None:
                low, high = self.bounds.get(name, (-np.inf, np.inf))
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = max(low, float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = min(high, float(f.value))
                self.bounds[name] = (low, high)
            yield f

    def _meets(self, low: dict, high: dict) -> bool:
        return all(high[a] >= b[0] and low[a] <= b[1] for a, b in self.bounds.items() if a in low)

    def _ranges(self, path: str) -> list[RecordRange]:
        h = read_header(path)
        n = h["point_count"]
        if self.overview is not None:
            wanted = min(self.overview, n)
            return [RecordRange(path, at, min(WANTED, wanted - at)) for at in range(0, wanted, WANTED)]
        if not n or not self._meets(dict(zip("xyz", h["mins"], strict=True)), dict(zip("xyz", h["maxs"], strict=True))):
            return []
        low, high = self.bounds.get("row_id", (-np.inf, np.inf))
        first, last = int(max(0, np.ceil(max(low, 0)))), int(min(n - 1, np.floor(min(high, n - 1))))
        spans = [(first, last + 1)] if first <= last else []
        blocks = _read_index(self.index, path, h) if self.index and self.bounds.keys() & set("xyz") else None
        if blocks is not None:
            kept = []
            for k in range(len(blocks["first"])):
                box = [{a: blocks[f"{e}_{a}"][k] * h["scales"][j] + h["offsets"][j] for j, a in enumerate("xyz")} for e in ("min", "max")]
                begin, end = max(first, blocks["first"][k]), min(last, blocks["last"][k]) + 1
                if begin < end and self._meets(*box):
                    kept.append((begin, end))
            spans = []
            for begin, end in sorted(kept):
                if spans and spans[-1][1] == begin:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((begin, end))
        return [RecordRange(path, at, min(self.chunk, end - at)) for begin, end in spans for at in range(begin, end, self.chunk)]

    def partitions(self):
        if len(self.paths) <= 1:
            return [r for p in self.paths for r in self._ranges(p)]
        with ThreadPoolExecutor(16) as pool:  # headers of many files
            return [r for found in pool.map(self._ranges, self.paths) for r in found]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing meets the filters
            return
        path, start, count = partition.value
        header = read_header(path)
        kind = record_type(header)
        with open_file(path) as f:
            if self.overview is not None:
                wanted = wanted_records(header["point_count"], self.overview, start, count)
                if len(wanted):
                    yield decode(_records_at(f, header, kind, wanted), header, wanted)
                return
            for at in range(start, start + count, 100_000):
                n = min(100_000, start + count - at)
                f.seek(header["data_offset"] + at * kind.itemsize)
                yield decode(np.frombuffer(f.read(n * kind.itemsize), kind), header, np.arange(at, at + n))


def _records_at(f, header: dict, kind: np.dtype, wanted: np.ndarray) -> np.ndarray:
    """The records with these numbers: runs that lie near one another are read through, others by themselves."""
    out = np.empty(len(wanted), kind)
    breaks = np.flatnonzero(np.diff(wanted) * kind.itemsize > NEAR_BYTES) + 1
    for begin, end in zip([0, *breaks.tolist()], [*breaks.tolist(), len(wanted)], strict=True):
        first, last = int(wanted[begin]), int(wanted[end - 1])
        f.seek(header["data_offset"] + first * kind.itemsize)
        out[begin:end] = np.frombuffer(f.read((last - first + 1) * kind.itemsize), kind)[wanted[begin:end] - first]
    return out


def _index_path(folder: str, path: str) -> str:
    return f"{folder.rstrip('/')}/{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def _read_index(folder: str, path: str, header: dict) -> dict | None:
    """The blocks of a file's index: first and last record, least and greatest raw coordinates. None without one, or if it is of another file of that name."""
    fs, inner = pafs.FileSystem.from_uri(_index_path(folder, path)) if "://" in folder else (pafs.LocalFileSystem(), _index_path(folder, path))
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return None
    found = pq.read_table(inner, filesystem=fs).to_pydict()
    return found if found["first"] and {*found["file_size_bytes"]} == {header["file_size_bytes"]} and {*found["point_count"]} == {header["point_count"]} else None


def index_las(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Writes the index of files: a row for each BLOCK records of each file, in a table of its own."""
    for path in paths:
        header = read_header(path)
        rows = spark.read.format("las").option("chunk_points", 20 * BLOCK).load(path)
        blocks = rows.groupBy(F.floor(F.col("row_id") / BLOCK).alias("block")).agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), *[f(f"raw_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
        blocks.withColumns({"file_size_bytes": F.lit(header["file_size_bytes"]).cast("long"), "point_count": F.lit(header["point_count"]).cast("long")}).coalesce(1).write.mode("overwrite").parquet(_index_path(folder, path))  # a row for BLOCK records


def register(spark: SparkSession) -> None:
    """Makes the sources and the sink known to a session, and lets filters reach them."""
    spark.dataSource.register(LasSource)
    spark.dataSource.register(LasHeaderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def overview(spark: SparkSession, path: str, most: int = 40_000) -> DataFrame:
    """At most `most` evenly spaced points of each file, in the order of row_id by file; reads little more than them."""
    if most < 1:
        raise ValueError("an overview has one point at least")
    return spark.read.format("las").option("overview", most).load(path)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return POINT

    def reader(self, schema: StructType):
        return LasReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return LasWriter(self.options, schema)


class LasHeaderReader(DataSourceReader):
    def __init__(self, options):
        self.paths = _paths(options)

    def partitions(self):
        return [RecordRange(p, 0, 0) for p in self.paths]

    def read(self, partition):
        h = read_header(partition.value[0])
        vlr = lambda rows: [(r["type"], r["user_id"], r["record_id"], r["description"], r["record_length"]) for r in rows]
        yield tuple(vlr(v) if k in ("vlrs", "evlrs") else v for k, v in h.items() if k != "data_offset")


class LasHeaderSource(DataSource):
    @classmethod
    def name(cls):
        return "las_header"

    def schema(self):
        return HEADER

    def reader(self, schema: StructType):
        return LasHeaderReader(self.options)


def header_bytes(count: int, scales: tuple, offsets: tuple, mins: tuple, maxs: tuple, software: str = "cloudstrata", wkt: str = "", by_return: list[int] | None = None) -> bytes:
    """A LAS 1.4 header for format 7, with the coordinate system as a record if given."""
    body = wkt.encode()
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(body), b"WKT") + body if wkt else b""
    size = 375
    box = [v for lo, hi in zip(mins, maxs, strict=True) for v in (hi, lo)]
    head = b"LASF" + struct.pack("<HH16sBB32s32sHHHIIBHI5I", 0, 16, b"", 1, 4, b"EXPORT", software.encode()[:32], 1, 2024, size, size + len(vlr), 1 if wkt else 0, 7, 36, 0, *[0] * 5)
    head += struct.pack("<3d3d6d", *scales, *offsets, *box) + struct.pack("<QQIQ15Q", 0, 0, 0, count, *(by_return or [count, *[0] * 14]))
    return head + vlr


def encode(rows: dict[str, np.ndarray], point_format: int = 7) -> bytes:
    """Records of a format. What the format has no room for is left out."""
    out = np.zeros(len(rows["raw_x"]), np.dtype(FORMATS[point_format]))
    for k, a in enumerate("XYZ"):
        out[a] = rows[f"raw_{'xyz'[k]}"]
    part = lambda name, at, mask=255: (rows[name].astype(np.uint8) & mask) << at
    if "flags" in out.dtype.names:
        out["bits"] = part("return_number", 0, 15) | part("number_of_returns", 4, 15)
        out["flags"] = part("synthetic", 0) | part("key_point", 1) | part("withheld", 2) | part("overlap", 3) | part("scanner_channel", 4, 3) | part("scan_direction_flag", 6) | part("edge_of_flight_line", 7)
        out["classification"] = rows["classification"]
    else:
        out["bits"] = part("return_number", 0, 7) | part("number_of_returns", 3, 7) | part("scan_direction_flag", 6) | part("edge_of_flight_line", 7)
        out["classification"] = part("classification", 0, 31) | part("synthetic", 5) | part("key_point", 6) | part("withheld", 7)
    for name in ("intensity", "user_data", "scan_angle", "point_source_id", "gps_time", "red", "green", "blue"):
        if name in out.dtype.names:
            out[name] = rows[name]
    return out.tobytes()


def copied_header(path: str, count: int, mins: tuple, maxs: tuple, by_return: list[int]) -> bytes:
    """The header and the variable-length records of a file, with other counts and bounds. Records beyond the points (EVLRs), waveforms and extra bytes of points aren't copied."""
    h = read_header(path)
    if h["point_format"] not in FORMATS:
        raise ValueError(f"point format {h['point_format']} isn't known")
    with open_file(path) as f:
        head = bytearray(f.read(h["data_offset"]))
    length = np.dtype(FORMATS[h["point_format"]]).itemsize
    old = h["point_format"] < 6 and count < 1 << 32
    struct.pack_into("<BH", head, 104, h["point_format"], length)
    struct.pack_into("<6I", head, 107, count if old else 0, *((by_return + [0] * 5)[:5] if old else [0] * 5))
    struct.pack_into("<6d", head, 179, *[v for lo, hi in zip(mins, maxs, strict=True) for v in (hi, lo)])
    if h["las_version"] >= "1.4":
        struct.pack_into("<QQIQ15Q", head, 227, 0, 0, 0, count, *(by_return + [0] * 15)[:15])
    return bytes(head)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: records, or the name of a file of its own."""

    records: int
    file: str | None = None


class LasWriter(DataSourceArrowWriter):
    """Writes rows of types.POINT with `place`, their place in the file. Options: path, header (hexadecimal), point_format, target; made by write_las."""

    def __init__(self, options, schema: StructType):
        self.path, self.target, self.header, self.format, self.count = options["path"], options["target"], bytes.fromhex(options["header"]), int(options["point_format"]), int(options["count"])
        self.names = schema.fieldNames()
        self.whole = options["whole"] == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        if not self.whole:
            return self._part(iterator, TaskContext.get())
        length, n = np.dtype(FORMATS[self.format]).itemsize, 0
        with open(self.target, "r+b") as f:
            for batch in iterator:
                rows = {c: _numbers(batch.column(k)) for k, c in enumerate(self.names)}
                place, data = rows["place"], encode(rows, self.format)
                ends = np.flatnonzero(np.diff(place) != 1) + 1
                for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(place)], strict=True):
                    if begin < end:
                        f.seek(len(self.header) + int(place[begin]) * length)
                        f.write(data[begin * length : end * length])
                n += len(place)
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def _part(self, iterator: Iterator[pa.RecordBatch], task) -> Written:
        """A file of the task's own, with its own counts and bounds, under a name that an attempt alone has until it is committed."""
        fs, inner = pafs.FileSystem.from_uri(self.target)
        batches = [encode({c: _numbers(b.column(k)) for k, c in enumerate(self.names)}, self.format) for b in iterator if b.num_rows]
        data = b"".join(batches)
        records = np.frombuffer(data, np.dtype(FORMATS[self.format]))
        if not len(records):
            return Written(0)
        head = bytearray(self.header)
        scales, offsets = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        box = [float(v) * scales[k] + offsets[k] for k, a in enumerate("XYZ") for v in (records[a].max(), records[a].min())]
        struct.pack_into("<6d", head, 179, *box)
        struct.pack_into("<Q", head, 247, len(records))
        name = f"{inner}/part-{task.partitionId():06d}.las"
        fs.create_dir(inner)
        with fs.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
            f.write(bytes(head))
            f.write(data)
        return Written(len(records), f"{name}.{task.taskAttemptId()}")

    def commit(self, messages: list[Written | None]) -> None:
        written = [m for m in messages if m is not None]
        if sum(m.records for m in written) != self.count:
            self.abort(messages)
            raise ValueError("not all records were written")
        if self.whole:
            os.link(self.target, self.path)  # never replaces a file
            os.remove(self.target)
        else:
            fs, _ = pafs.FileSystem.from_uri(self.target)
            for m in written:
                if m.file:
                    fs.move(m.file, m.file.rsplit(".", 1)[0])

    def abort(self, messages: list[Written | None]) -> None:
        if self.whole:
            os.path.exists(self.target) and os.remove(self.target)
        else:
            fs, _ = pafs.FileSystem.from_uri(self.target)
            for m in messages:
                if m is not None and m.file:
                    fs.delete_file(m.file)


def _numbers(column: pa.Array) -> np.ndarray:
    """A column as numbers; null is 0. Texts are left out."""
    if pa.types.is_string(column.type):
        return np.zeros(len(column), np.int8)
    return (column.fill_null(False) if pa.types.is_boolean(column.type) else column.fill_null(0)).to_numpy(zero_copy_only=False)


def write_las(points: DataFrame, path: str, scales: tuple = (0.01, 0.01, 0.01), offsets: tuple = (0.0, 0.0, 0.0), like: str | None = None, wkt: str = "") -> int:
    """Writes points (types.POINT) in the order of row_id as one file and returns their number; FileExistsError if it is there.

    like: a file whose header and variable-length records are copied, with its scales, offsets and point format; raw coordinates have to
    be in them. Otherwise a header of LAS 1.4, format 7. A path with a scheme other than file:// becomes a folder of files.
    """
    local = path.removeprefix("file://")
    whole = "://" not in local
    if whole and os.path.exists(local):
        raise FileExistsError(path)
    ordered = placed(points, ["row_id"], "place")
    number = F.least(F.greatest(F.col("return_number"), F.lit(1)), F.lit(15))
    box = [F.coalesce(f(f"raw_{a}"), F.lit(0)).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    stats = ordered.agg(F.count("*").alias("n"), *box, *[F.count_if(number == k).alias(f"r{k}") for k in range(1, 16)]).first()
    if like:
        h = read_header(like)
        scales, offsets, point_format = tuple(h["scales"]), tuple(h["offsets"]), h["point_format"]
    else:
        point_format = 7
    mins, maxs = (tuple(stats[f"{e}_{a}"] * scales[k] + offsets[k] for k, a in enumerate("xyz")) for e in ("min", "max"))
    by_return = [stats[f"r{k}"] for k in range(1, 16)]
    header = copied_header(like, stats["n"], mins, maxs, by_return) if like else header_bytes(stats["n"], scales, offsets, mins, maxs, wkt=wkt, by_return=by_return)
    target = path
    if whole:
        target = f"{os.path.dirname(local) or '.'}/.{os.path.basename(local)}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        with open(target, "xb") as f:
            f.write(header)
            f.truncate(len(header) + stats["n"] * np.dtype(FORMATS[point_format]).itemsize)
    register(points.sparkSession)
    options = {"header": header.hex(), "point_format": point_format, "target": target, "count": stats["n"], "whole": str(whole).lower()}
    ordered.sortWithinPartitions("place").write.format("las").options(**options).mode("append").save(local if whole else path)
    return stats["n"]
