"""Operators against brute force and known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.functions.graph import connected_components
from cloudstrata.functions.hashing import COORDINATES, MIXERS, SHIFTS, signed, spatial_hash
from cloudstrata.operators import clusters, ground, neighbours, records, regions, render, reviews, shape
from cloudstrata.sources import documents, las


def cloud(spark, xyz, **more):
    rows = [(k, *map(float, p), *[v[k] for v in more.values()]) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, z double" + "".join(f", {n} string" for n in more))


def random_cloud(seed, n=60, side=6.0, twins=5):
    r = np.random.default_rng(seed)
    xyz = r.random((n, 3)) * side
    return np.concatenate([xyz, xyz[:twins]])


def brute_dbscan(xyz, eps, least):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    near = [np.flatnonzero(row <= eps) for row in d]
    core = np.array([len(v) >= least for v in near])
    label = np.full(len(xyz), -1)
    number = 0
    for i in range(len(xyz)):
        if core[i] and label[i] < 0:
            label[i] = number
            work = [i]
            while work:
                for j in near[work.pop()]:
                    if label[j] < 0:
                        label[j] = number
                        if core[j]:
                            work.append(j)
            number += 1
    return core, label


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan(spark, seed):
    xyz = random_cloud(seed)
    got = {r["row_id"]: r for r in clusters.dbscan(cloud(spark, xyz), 1.07, 4).collect()}
    core, label = brute_dbscan(xyz, 1.07, 4)
    assert [got[k]["label"] for k in range(len(xyz))] == label.tolist()
    assert [got[k]["core"] for k in range(len(xyz))] == core.tolist()


def test_k_nearest(spark):
    xyz = random_cloud(3)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.k_nearest(cloud(spark, xyz), cloud(spark, xyz), 3, other=True).collect()}
    for i, p in enumerate(xyz):
        d = np.sqrt(((xyz - p) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(len(xyz)) if j != i)[:3]
        for k, (dist, j) in enumerate(order, 1):
            assert got[i, k][0] == j and math.isclose(got[i, k][1], dist, abs_tol=1e-12)


def test_components(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (50, 2))] + [(100 + k, 101 + k) for k in range(40)]
    root = {}

    def find(k):
        while root.get(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for e in edges for k in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shapes():
    grid = np.array([(a, b, 0.0) for a in range(9) for b in range(9)])
    line = np.array([(0.0, 0.0, t) for t in np.linspace(-1, 1, 9)])
    return {
        "line": (line, (1, 0, 0), 1, None), "plane": (grid, (0, 1, 0), None, 1), "wall": (grid[:, [0, 2, 1]], (0, 1, 0), None, 0),
        "cube": (np.array([*itertools.product(range(3), repeat=3)], float), (0, 0, 1), None, None),
    }


@pytest.mark.parametrize("offset", [(0, 0, 0), (2454000, 414800, 800)])
def test_shape_features(spark, offset):
    for xyz, lps, axis, normal in shapes().values():
        r = shape.shape_features(cloud(spark, xyz + np.array(offset, float)).withColumn("g", F.lit(1)), ["g"]).first()
        assert r["status"] == "valid"
        assert np.allclose([r["linearity"], r["planarity"], r["scattering"]], lps, atol=1e-6)
        for got, want in ((r["axis_alignment"], axis), (r["normal_alignment"], normal)):
            assert got is None if want is None else math.isclose(got, want, abs_tol=1e-6)


def test_undefined_shapes(spark):
    same = shape.shape_features(cloud(spark, [(1, 2, 3)] * 6).withColumn("g", F.lit(1)), ["g"]).first()
    assert same["status"] == "zero_variance" and same["linearity"] is None
    two = shape.shape_features(cloud(spark, [(1, 2, 3), (2, 3, 4)]).withColumn("g", F.lit(1)), ["g"]).first()
    assert two["status"] == "insufficient_neighbors" and two["l1"] is None


def test_spatial_hash(spark):
    r = np.random.default_rng(5)
    rows = [tuple(map(int, v)) for v in r.integers(-(2**31), 2**31, (50, 3))]
    m = (1 << 64) - 1

    def exact(v):
        h = 7
        for c, f in zip(v, COORDINATES, strict=True):
            h ^= (c & m) * f & m
        for s, f in zip(SHIFTS, (*MIXERS, 1), strict=True):
            h = (h ^ h >> s) * f & m
        return signed(h)

    got = spatial_hash(spark.createDataFrame(rows, "raw_x int, raw_y int, raw_z int"), 7).collect()
    assert {(g["raw_x"], g["raw_y"], g["raw_z"]): g["score"] for g in got} == {v: exact(v) for v in rows}


def test_sample_of_everything(spark):
    p = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "raw_x int, raw_y int, raw_z int")
    assert regions.hash_sample(p, 5, 2, 101).count() == 2


@pytest.mark.parametrize(("n", "most"), [(5, 10), (10, 10), (11, 10), (97, 7), (50, 1), (3, 2)])
def test_even_sample(spark, n, most):
    got = sorted(r["id"] for r in regions.even_sample(spark.range(n), most, ["id"]).collect())
    assert got == sorted(set(np.linspace(0, n - 1, min(n, most)).astype(int).tolist()))


def test_representatives_need_room(spark):
    with pytest.raises(ValueError, match="labels"):
        regions.representatives(spark.range(5).withColumn("l", F.col("id")), "l", 3, "id")


def test_region_cap(spark):
    p = cloud(spark, random_cloud(6))
    with pytest.raises(ValueError, match="more than"):
        regions.region(p, (0, 6), (0, 6), 0, most=5)


def records_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b string")


def test_partition_labels(spark):
    all_rows = records_of(spark, [(1, "x"), (1, "x"), (2, None), (3, "z")])
    parts = {"ground": records_of(spark, [(1, "x"), (1, "x")]), "other": records_of(spark, [(2, None), (3, "z")])}
    got = sorted((r["a"], r["label"]) for r in records.label_by_partition(all_rows, parts, ["a", "b"]).collect())
    assert got == [(1, "ground"), (1, "ground"), (2, "other"), (3, "other")]
    bad = [
        {"ground": records_of(spark, [(1, "x"), (1, "x"), (2, None)]), "other": records_of(spark, [(2, None), (3, "z")])},
        {"ground": records_of(spark, [(1, "x")] * 3), "other": records_of(spark, [(2, None), (3, "z")])},
        {"ground": records_of(spark, [(1, "x")]), "other": records_of(spark, [(2, None), (3, "z")])},
    ]
    for parts in bad:
        with pytest.raises(ValueError):
            records.label_by_partition(all_rows, parts, ["a", "b"])


def test_cloth_finds_a_floor():
    r = np.random.default_rng(8)
    floor = np.column_stack([r.random((400, 2)) * 20, r.random(400) * 0.1])
    pole = np.column_stack([np.full(40, 10.0), np.full(40, 10.0), np.linspace(1, 6, 40)])
    got = ground.cloth_mask(np.concatenate([floor, pole]), 1.0, 0.8, 3, 500, True)
    assert got[:400].mean() > 0.95 and not got[403 - 3 + 10 :].any()


def test_pixels_prefer_near_then_late(spark):
    p = cloud(spark, [(0, 0, 0), (0, -5, 0), (0, -5, 0), (9, 0, 9)])
    rows = render.projected(p, {"front": render.VIEWS["front"]})
    got = render.pixels(rows, render.frame(rows, 16, 0, 0.0), 16, 0).collect()
    assert sorted(r["row_id"] for r in got) == [2, 3]
    assert render.png(2, 1, b"\0" * 6).startswith(b"\x89PNG")


def test_review_store(spark, tmp_path):
    who = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    store = reviews.ReviewStore(spark, str(tmp_path / "store"), who)
    assert store.save("a", " Vehicle ", "usable single object", 0) == 1
    store.reveal("a", "me")
    assert store.save("a", "Kiosk", "unclear", 1) == 2
    with pytest.raises(reviews.RevisionConflict):
        store.save("a", None, "unclear", 1)
    for args in (("a", None, "complete object"), ("nobody", None, "unclear"), ("a", "x" * 200, "unclear")):
        with pytest.raises(ValueError):
            store.save(*args)
    again = reviews.ReviewStore(spark, str(tmp_path / "store"), who)
    last = reviews.latest(again.reviews, "candidate_id", "revision").first()
    assert (last["revision"], last["human_class"], last["suggestions_revealed"], last["reveal_event_count"]) == (2, "Kiosk", True, 1)
    assert again.reviews.count() == 2 and "Kiosk" in store.classes
    p = reviews.progress(who, again.reviews, "candidate_id").first()
    assert (p["reviewed"], p["total"]) == (1, 2)
    groups = who.select("candidate_id", F.col("candidate_id").alias("group"))
    rows = {r["candidate_id"]: r for r in reviews.reference_rows(who, again.reviews, groups).collect()}
    assert rows["b"]["human_class"] is None and not rows["b"]["reviewed"] and not rows["a"]["eligible_for_later_classification"]
    store.export(groups, str(tmp_path / "csv"))


def las_points(spark, n=2500):
    df = spark.range(n).select(
        F.col("id").alias("row_id"), *[((F.col("id") * k) % 1000).cast("int").alias(f"raw_{a}") for a, k in zip("xyz", (3, 7, 11), strict=True)],
    )
    df = df.select("*", *[(F.col(f"raw_{a}") * 0.01 + 5.0).alias(a) for a in "xyz"], (F.col("row_id") % 4000).cast("int").alias("intensity"))
    fill = {"return_number": 1, "number_of_returns": 2, "scanner_channel": 1, "classification": 2, "user_data": 3, "scan_angle": -4}
    df = df.select("*", *[F.lit(v).cast("short").alias(n) for n, v in fill.items()], *[(F.col("row_id") % k == 0).alias(n) for n, k in (("synthetic", 2), ("key_point", 3), ("withheld", 5), ("overlap", 7), ("scan_direction_flag", 11), ("edge_of_flight_line", 13))])
    return df.select("*", F.lit(9).alias("point_source_id"), (F.col("row_id") * 0.5).alias("gps_time"), *[(F.col("row_id") * k % 65536).cast("int").alias(c) for c, k in (("red", 17), ("green", 19), ("blue", 23))])


def test_las_round_trip(spark, tmp_path):
    path = str(tmp_path / "run left.las")
    source = las_points(spark)
    assert las.write_las(source, path, (0.01,) * 3, (5.0,) * 3) == 2500
    with pytest.raises(FileExistsError):
        las.write_las(source, path, (0.01,) * 3, (5.0,) * 3)
    got = spark.read.format("las").option("chunk_points", 600).load(path)
    columns = [c for c in source.columns if c not in "xyz"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, source.select(columns).collect()))
    assert got.filter("abs(x - (raw_x * 0.01 + 5.0)) > 1e-9").count() == 0
    h = spark.read.format("las_header").load(path).first()
    assert (h["point_count"], h["point_format"], h["las_version"], h["point_record_length"]) == (2500, 7, "1.4", 36)


def test_documents(spark, tmp_path):
    side = tmp_path / "a.las.txt"
    side.write_text('Export unit: Meter\n  WKT (GDAL): PROJCS["Here",UNIT["US survey foot",0.3],AUTHORITY["EPSG","6553"]]\n')
    r = documents.read_sidecars(spark, [str(side)]).first()
    assert (r["name"], r["unit"], r["epsg"]) == ("Here", "US survey foot", "6553")
    run = tmp_path / "run1"
    run.mkdir()
    documents.atomic_json(str(run / "manifest.json"), {"comparison_rows": [{"name": "a", "points": 3}, {"name": "b", "points": 4}]})
    rows = documents.history_rows(spark, str(tmp_path / "*/manifest.json"))
    assert rows.select("row.name").orderBy("name").collect()[0][0] == "a" and rows.count() == 2
    documents.write_comparison_csv(rows, str(tmp_path / "csv"))


def test_cloth_of_all_points(spark, sf_dir):
    from cloudstrata.plans import registry

    rows = registry.QUERIES["ground_cloth"](spark, sf_dir).collect()
    ids = [r["row_id"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_id")).collect()]
    assert sorted(r["row_id"] for r in rows) == sorted(ids)


def test_cloth_regions(spark):
    r = np.random.default_rng(9)
    xy = r.random((900, 2)) * 60 - 20
    rows = [(k, "left", float(x), float(y), 0.0 if k % 9 else 6.0) for k, (x, y) in enumerate(xy)]
    p = spark.createDataFrame(rows, "row_id long, side string, x double, y double, z double")
    got = {x["row_id"]: x["ground"] for x in ground.ground_by_cloth_regions(p, ["side"], 16.0, 6.0, resolution=2.0, iterations=200).collect()}
    assert len(got) == 900 and np.mean([got[k] for k in got if k % 9]) > 0.95 and np.mean([got[k] for k in got if not k % 9]) < 0.1


def test_regrouping_of_all_points(spark, sf_dir):
    from cloudstrata.plans import point_queries, registry

    p = point_queries.points(spark, sf_dir)
    left, right = ([(r["row_id"], r["x"], r["y"], r["z"]) for r in p.filter(F.col("side") == s).orderBy("row_id").collect()] for s in ("left", "right"))
    rows = registry.QUERIES["dense_regrouping"](spark, sf_dir).collect()
    labelled = clusters.regroup_dense(p.filter("side = 'left'"), p.filter("side = 'right'").limit(1), 6.01, 3, 12.07)[0]
    label = {r["row_id"]: r["label"] for r in labelled.collect()}
    dense, want = np.array(left)[:, 1:], {}
    for seed in np.array(right)[:, 1:]:
        d2 = ((dense - seed) ** 2).sum(1)
        k = label[left[int(d2.argmin())][0]]
        if d2.min() <= 12.07**2 and k >= 0:
            want[k] = want.get(k, 0) + 1
    assert {r["label"]: r["support"] for r in rows if r["support"]} == want
    assert sum(r["points"] for r in rows) == sum(k >= 0 for k in label.values())


def brute_nearest(queries, points, k, other):
    out = {}
    for i, q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, p, strict=True)), j) for j, p in points if not (other and i == j))
        for rank, (d, j) in enumerate(near[:k], 1):
            out[i, rank] = (j, d**0.5)
    return out


@pytest.mark.parametrize("pairs", [0, 128])
@pytest.mark.parametrize("kind", ["plane", "line", "clusters", "one place", "far"])
def test_k_nearest_kinds(spark, kind, pairs, monkeypatch):
    """Flat, clustered and coincident points, far queries; with rounds by shells of counted cells, and without."""
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    r = np.random.default_rng(5)
    xyz = {
        "plane": np.column_stack([r.random((150, 2)) * 50, np.zeros(150)]), "line": np.column_stack([r.random(60) * 9, np.full(60, 2.0), np.full(60, -1.0)]), "one place": np.ones((30, 3)),
        "clusters": np.concatenate([c + r.normal(size=(40, 3)) * 0.01 for c in (0.0, 5.0, 300.0)]), "far": np.concatenate([r.random((100, 3)), [[500.0, 3.0, 2.0], [-900.0, 0.0, 1.0]]]),
    }[kind]
    asked = xyz if kind != "far" else np.concatenate([xyz[:10], xyz[-2:], [[2000.0, -70.0, 0.5]]])
    rows = lambda v: [(k, tuple(map(float, p))) for k, p in enumerate(v)]
    for k, other in ((1, kind != "far"), (3, False)):
        got = {(x["query"], x["rank"]): (x["neighbour"], x["distance"]) for x in neighbours.k_nearest(cloud(spark, asked), cloud(spark, xyz), k, other=other).collect()}
        want = brute_nearest(rows(asked), rows(xyz), k, other)
        assert got.keys() == want.keys()
        for key in want:
            assert got[key][1] == pytest.approx(want[key][1], abs=1e-9) and (got[key][0] == want[key][0] or kind != "one place")


def test_plane_in_few_rounds(spark, monkeypatch):
    """2,000 points on a plane: a flat axis doesn't make the first cells small."""
    rounds = []
    plain = neighbours._nearest_of
    monkeypatch.setattr(neighbours, "_nearest_of", lambda pairs, k: rounds.append(1) or plain(pairs, k))
    r = np.random.default_rng(6)
    p = cloud(spark, np.column_stack([r.random((2000, 2)) * 100, np.full(2000, 7.0)]))
    assert neighbours.k_nearest(p, p, 1, other=True).count() == 2000 and len(rounds) <= 2


@pytest.mark.parametrize(("tile", "steps"), [(12, 3), (512, 20)])
def test_cloth_tiles(spark, tile, steps):
    """A cloth over many tiles labels points as one cloth of the whole does, for two groups of unlike extent, with voids, hills and poles."""
    r = np.random.default_rng(12)
    rows, want = [], {}
    for side, n, wide in (("left", 700, (60, 37)), ("right", 150, (20, 9))):
        xy = r.random((n, 2)) * wide - 11.0
        xy = xy[~((xy[:, 0] > 15) & (xy[:, 0] < 30) & (xy[:, 1] > 0))]  # wider than what tiles exchange at once
        z = np.sin(xy[:, 0] / 6) * 2 + 0.05 * r.random(len(xy)) + np.where(r.random(len(xy)) < 0.1, 4.0, 0.0)
        mask = ground.cloth_mask(np.column_stack([xy, z]), 1.0, 0.5, 2, 60, True)
        for (x, y), h, g in zip(xy.tolist(), z.tolist(), mask.tolist(), strict=True):
            want[len(rows)] = g
            rows.append((len(rows), side, x, y, h))
    p = spark.createDataFrame(rows, "row_id long, side string, x double, y double, z double").repartition(3)
    got = {x["row_id"]: x["ground"] for x in ground.ground_by_cloth_tiles(p, ["side"], 1.0, 0.5, 2, 60, True, tile=tile, steps=steps if tile == 12 else 20).collect()}
    assert got == want and 0.5 < np.mean([*want.values()]) < 0.98
    assert ground.ground_by_cloth_tiles(p.limit(0), ["side"]).count() == 0
    with pytest.raises(ValueError):
        ground.ground_by_cloth_tiles(p, ["side"], tile=12, steps=20)
