"""LAS files: pruned and strided reads by bytes, and files written by many tasks."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThanOrEqual

from cloudstrata.sources import las
from tests.test_operators import las_points


@pytest.fixture(scope="module")
def sorted_file(spark, tmp_path_factory):
    """4,000 points along x, so blocks of records are slabs; blocks of 100 records."""
    path = str(tmp_path_factory.mktemp("las") / "run.las")
    points = las_points(spark, 4000).withColumns({"raw_x": F.col("row_id").cast("int"), "x": F.col("row_id") * 0.01})
    las.write_las(points.repartition(7), path, (0.01,) * 3, (0.0,) * 3, wkt='PROJCS["Here"]')
    return path


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(las, "BLOCK", 100)
    monkeypatch.setattr(las, "WANTED", 7)


class Counting:
    """A file that adds up the bytes that are read of it."""

    def __init__(self, inner, total):
        self.inner, self.total = inner, total

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.inner.close()

    def read(self, n):
        out = self.inner.read(n)
        self.total.append(len(out))
        return out


def read_all(reader, monkeypatch):
    """row_ids and the bytes read for them, headers aside."""
    total, plain = [], las.open_file
    parts = list(reader.partitions())
    monkeypatch.setattr(las, "open_file", lambda p: Counting(plain(p), total))
    rows = []
    for p in parts:
        rows += [v for b in reader.read(p) for v in b.column("row_id").to_pylist()]
    monkeypatch.setattr(las, "open_file", plain)
    return rows, sum(n for n in total if n not in (375, 54, 60))


def test_pruned_scan(spark, sorted_file, small_blocks, tmp_path, monkeypatch):
    index = str(tmp_path / "index")
    las.index_las(spark, [sorted_file], index)
    reader = las.LasReader({"path": sorted_file, "index": index, "chunk_points": 1000})
    filters = [GreaterThanOrEqual(("x",), 12.34), LessThanOrEqual(("x",), 14.5), GreaterThan(("intensity",), 3)]
    assert list(reader.pushFilters(filters)) == filters  # Spark filters, too
    rows, read = read_all(reader, monkeypatch)
    assert rows == list(range(1200, 1500)) and read == 300 * 36
    other = las.LasReader({"path": sorted_file, "index": index})
    list(other.pushFilters([EqualTo(("x",), 99.0)]))
    assert list(other.partitions()) == []  # by the header alone
    by_row = las.LasReader({"path": sorted_file})
    list(by_row.pushFilters([GreaterThan(("row_id",), 10), LessThanOrEqual(("row_id",), 20)]))
    assert read_all(by_row, monkeypatch)[0] == list(range(10, 21))
    found = spark.read.format("las").option("index", index).load(sorted_file).filter("x between 12.34 and 14.5 and z > 5.2")
    whole = spark.read.format("las").load(sorted_file).filter("x + 0 between 12.34 and 14.5 and z + 0 > 5.2")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and 0 < found.count() < 300
    assert found.rdd.getNumPartitions() == 1
    # an index of another file of that name isn't used
    monkeypatch.setattr(las, "_index_path", lambda folder, path: f"{folder}/{os.listdir(folder)[0]}")
    shorter = str(tmp_path / "other.las")
    las.write_las(las_points(spark, 50), shorter)
    assert las._read_index(index, shorter, las.read_header(shorter)) is None


def test_overview(spark, sorted_file, small_blocks, monkeypatch):
    for most in (1, 2, 40, 1999, 4000, 9000):
        reader = las.LasReader({"path": sorted_file, "overview": most})
        rows, read = read_all(reader, monkeypatch)
        want = np.linspace(0, 3999, most, dtype=int).tolist() if most < 4000 else list(range(4000))
        assert rows == want, most
        assert read <= min(4000 * 36, most * (las.NEAR_BYTES + 36)) and (most != 40 or read == 40 * 36)
    assert las.overview(spark, sorted_file, 40).count() == 40
    with pytest.raises(ValueError):
        las.overview(spark, sorted_file, 0)


def test_copied_header(spark, sorted_file, tmp_path):
    """Scales, offsets, format, software and variable-length records are those of the source; counts and bounds are the points'."""
    path = str(tmp_path / "part.las")
    some = spark.read.format("las").load(sorted_file).filter("row_id % 3 = 1")
    assert las.write_las(some.repartition(5), path, like=sorted_file) == 1333
    a, b = las.read_header(sorted_file), las.read_header(path)
    assert all(a[k] == b[k] for k in ("scales", "offsets", "point_format", "las_version", "vlrs", "generating_software", "data_offset")) and len(b["vlrs"]) == 1
    assert b["point_count"] == 1333 and b["mins"][0] == pytest.approx(0.01) and b["maxs"][0] == pytest.approx(39.97) and os.path.getsize(path) == b["data_offset"] + 1333 * 36
    got = spark.read.format("las").load(path).drop("row_id", "file_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, some.drop("row_id", "file_id").collect()))
    raw = open(path, "rb").read()
    assert b'PROJCS["Here"]' in raw and struct.unpack_from("<15Q", raw, 255)[0] == 1333
    assert [f for f in os.listdir(tmp_path) if f.startswith(".part")] == []  # nothing is left over
    with pytest.raises(FileExistsError):
        las.write_las(some, path, like=sorted_file)


@pytest.mark.parametrize("point_format", [1, 3, 6])
def test_other_formats(spark, tmp_path, point_format):
    source = str(tmp_path / f"f{point_format}.las")
    rows = las_points(spark, 30)
    length = np.dtype(las.FORMATS[point_format]).itemsize
    head = bytearray(las.header_bytes(30, (0.01,) * 3, (5.0,) * 3, (0,) * 3, (1,) * 3))
    struct.pack_into("<BH", head, 104, point_format, length)
    columns = {c: np.array([r[c] for r in rows.orderBy("row_id").collect()]) for c in rows.columns}
    with open(source, "wb") as f:
        f.write(head + las.encode(columns, point_format))
    las.register(spark)
    read = spark.read.format("las").load(source)
    path = str(tmp_path / "copy.las")
    las.write_las(read, path, like=source)
    assert open(path, "rb").read()[375:] == open(source, "rb").read()[375:]
    kept = ["raw_x", "raw_y", "raw_z", "intensity", "return_number", "number_of_returns", "classification", "synthetic", "withheld", "scan_direction_flag", "point_source_id"] + ["gps_time"]
    assert sorted(map(tuple, read.select(kept).collect())) == sorted(map(tuple, rows.select(kept).collect()))


def test_empty_and_failing_writes(spark, tmp_path):
    path = str(tmp_path / "none.las")
    assert las.write_las(las_points(spark, 10).filter("row_id < 0"), path) == 0 and las.read_header(path)["point_count"] == 0
    bad = las_points(spark, 10).withColumn("user_data", F.when(F.col("row_id") == 7, F.raise_error(F.lit("no")).cast("short")).otherwise(F.lit(0).cast("short")))
    with pytest.raises(Exception, match="no"):
        las.write_las(bad, str(tmp_path / "bad.las"))
    assert not os.path.exists(tmp_path / "bad.las")


def test_folder_of_files(spark, tmp_path, monkeypatch):
    """Where tasks can't write to parts of a file, each writes one of its own."""
    monkeypatch.setattr(las.os.path, "exists", lambda p: False)
    writer = {}
    real = las.LasWriter.__init__

    def spy(self, options, schema):
        writer.update(whole=options["whole"])
        real(self, options, schema)

    monkeypatch.setattr(las.LasWriter, "__init__", spy)
    header = las.header_bytes(0, (0.01,) * 3, (5.0,) * 3, (0,) * 3, (0,) * 3)
    rows = las_points(spark, 100).withColumns({"file_id": F.lit(""), "place": F.col("row_id")})
    las.register(spark)
    folder = f"file://{tmp_path}/parts"
    rows.repartition(3).write.format("las").options(header=header.hex(), point_format=7, target=folder, count=100, whole="false").mode("append").save(folder)
    files = sorted(os.listdir(tmp_path / "parts"))
    assert files == [f"part-{k:06d}.las" for k in range(3)]
    got = spark.read.format("las").load(",".join(f"{tmp_path}/parts/{f}" for f in files))
    assert sorted(r["raw_x"] for r in got.collect()) == sorted(r["raw_x"] for r in rows.collect())
