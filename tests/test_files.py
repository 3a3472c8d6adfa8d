"""Documents and files that may be missing or broken, coordinate systems as trees, and candidate extraction as one call."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.operators import batches, clusters, parameters, runs, shape
from cloudstrata.sources import documents, las, wkt
from tests.test_operators import brute_dbscan, cloud, las_points

PLANE = 'PROJCS["NAD83 / ""X""", GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 80",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925]],PROJECTION["Lambert"],PARAMETER["k",-1.5e-3],UNIT["US survey foot",0.304800609601219],AXIS["X",EAST],AUTHORITY["EPSG","6553"]]'
V2 = 'COMPOUNDCRS["both",PROJCRS["p",BASEGEOGCRS["g",DATUM["d",ELLIPSOID["e",1,2,LENGTHUNIT["metre",1]]]],CS[Cartesian,2],AXIS["e",east,LENGTHUNIT["foot",0.3048]],AXIS["n",north,LENGTHUNIT["foot",0.3048]]],VERTCRS["v",VDATUM["w"],CS[vertical,1],AXIS["h",up],LENGTHUNIT["yard",0.9144]],ID["EPSG",9999]]'


def test_wkt():
    f = wkt.facts(wkt.parse(PLANE))
    assert (f["kind"], f["name"], f["unit"], f["unit_factor"], f["vertical_unit"], f["epsg"]) == ("projected", 'NAD83 / "X"', "US survey foot", 0.304800609601219, None, "6553")
    f = wkt.facts(wkt.parse(f'COMPD_CS["c",{PLANE},VERT_CS["NAVD88",VERT_DATUM["v",2005],UNIT["metre",1],AXIS["Up",UP]]]'))
    assert (f["kind"], f["unit"], f["vertical_unit"], f["vertical_factor"], f["epsg"]) == ("compound", "US survey foot", "metre", 1.0, None)
    f = wkt.facts(wkt.parse('GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298,AUTHORITY["EPSG","7030"]]],UNIT["degree",0.01745,AUTHORITY["EPSG","9122"]]]'))
    assert (f["kind"], f["unit"], f["epsg"]) == ("geographic", "degree", None)
    f = wkt.facts(wkt.parse(V2))
    assert (f["kind"], f["name"], f["unit"], f["vertical_unit"], f["epsg"]) == ("compound", "both", "foot", "yard", "9999")
    for bad in ("", "x", 'PROJCS["a"', 'PROJCS["a"]]', '"a"', 'PROJCS["a"],GEOGCS["b"]', 'PROJCS["a",?]'):
        with pytest.raises(ValueError):
            wkt.parse(bad)


def test_file_facts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "large.bin").write_bytes(b"x" * 9_000_000)
    paths = [str(tmp_path / n) for n in ("a.txt", "missing", "large.bin")] + [None]
    rows = {r["path"]: r for r in documents.file_facts(spark.createDataFrame([(p, 1) for p in paths], "path string, n int"), text=True).collect()}
    assert rows[paths[0]]["sha256"] == hashlib.sha256(b"one").hexdigest() and rows[paths[0]]["text"] == "one" and rows[paths[0]]["n"] == 1
    assert rows[paths[2]]["length"] == 9_000_000 and rows[paths[2]]["sha256"] == hashlib.sha256(b"x" * 9_000_000).hexdigest()
    assert rows[paths[1]]["sha256"] is None and "FileNotFound" in rows[paths[1]]["error"] and rows[None]["error"]


def test_saved_runs(spark, tmp_path):
    """Runs with all files, with a missing output, with a broken one, without a manifest, with a broken manifest, and of another source."""
    side = {"source_path": "a.las", "source_point_count": 9, "sample_point_count": 30, "selection_probability": 0.5, "seed": 101}
    roi = {"min": [0, 0, 0], "max": [1, 1, 1]}
    documents.atomic_json(str(tmp_path / "inputs.json"), {"sources": {"left": side, "right": side | {"seed": 202}}, "shared_roi": roi})
    las.write_las(las_points(spark, 20), str(tmp_path / "g.las"))
    las.write_las(las_points(spark, 10), str(tmp_path / "n.las"))
    (tmp_path / "broken.las").write_bytes(b"LASF")
    whole = {"ground": "g.las", "non_ground": "n.las"}
    manifests = {
        "good": {"sources": {"left": side | {"output_files": whole}, "right": side | {"seed": 202, "output_files": whole}}, "shared_roi": roi, "parameters": {"cell": 1.0}},
        "missing": {"sources": {"left": side | {"output_files": whole | {"ground": "no.las"}}}, "shared_roi": roi}, "broken": {"sources": {"left": side | {"output_files": whole | {"non_ground": "broken.las"}}}, "shared_roi": roi},
        "other": {"sources": {"left": side | {"seed": 7, "output_files": whole}}, "shared_roi": roi}, "elsewhere": {"sources": {"left": side | {"output_files": whole}}, "shared_roi": {"min": [1, 1, 1], "max": [2, 2, 2]}},
    }
    for name, m in manifests.items():
        documents.atomic_json(str(tmp_path / f"{name}.json"), m)
    (tmp_path / "damaged.json").write_text('{"sources": ')
    names = [*manifests, "damaged", "none"]
    got = {(r["run"], r["side"]): r for r in documents.saved_runs(spark, str(tmp_path / "inputs.json"), [(n, str(tmp_path / f"{n}.json")) for n in names]).collect()}
    assert set(got) == {("good", "left"), ("good", "right"), ("missing", "left"), ("broken", "left"), ("other", "left"), ("elsewhere", "left"), ("damaged", None), ("none", None)}
    r = got["good", "left"]
    assert (r["ground_points"], r["non_ground_points"], r["same_lineage"], r["status"], json.loads(r["parameters"])) == (20, 10, True, "saved partitions available", {"cell": 1.0}) and got["good", "right"]["same_lineage"]
    assert got["missing", "left"]["status"].startswith("ground: FileNotFound") and got["missing", "left"]["non_ground_points"] == 10
    assert got["broken", "left"]["status"].startswith("non_ground: ") and got["broken", "left"]["ground_points"] == 20
    assert not got["other", "left"]["same_lineage"] and not got["elsewhere", "left"]["same_lineage"]
    assert "FileNotFound" in got["none", None]["status"] and "JSONDecodeError" in got["damaged", None]["status"]


def test_experiment_parameters():
    base, cloth = {"cell": 1.0, "tolerance": 0.0}, {"resolution": 1.0, "threshold": 0, "rigidness": 2, "time_step": 0.65, "iterations": 2000, "smooth": True}
    assert parameters.checked_experiment(base, cloth) == (base, cloth)
    for b, c in (({"cell": 1.0}, cloth), (base | {"x": 1}, cloth), (base, {k: v for k, v in cloth.items() if k != "smooth"}), (base, cloth | {"iterations": 2001}), (base, cloth | {"iterations": True}), (base, cloth | {"smooth": 1}), (base, cloth | {"threshold": -0.1}), (base | {"cell": 0}, cloth)):
        with pytest.raises(ValueError):
            parameters.checked_experiment(b, c)
    for bad in ({"eps": 0.0, "min_samples": 3}, {"eps": 1.0, "min_samples": 0}, {"eps": float("inf"), "min_samples": 3}):
        with pytest.raises(ValueError):
            clusters.dbscan(None, **bad)


def test_extract_candidates(spark, tmp_path):
    r = np.random.default_rng(4)
    xyz = np.concatenate([c + r.random((n, 3)) for c, n in ((0.0, 25), (10.0, 12), (20.0, 4), (40.0, 1))])
    source = cloud(spark, xyz).withColumn("eligible", F.col("row_id") != 5)
    kept = [k for k in range(len(xyz)) if k != 5]
    _, label = brute_dbscan(xyz[kept], 1.2, 3)
    members, table, counts, there = runs.extract_candidates(source, str(tmp_path), {"file": "a"}, 1.2, 6, 3, 1, (-5.0, 50.0, -0.5, 50.0))
    got = {x["row_id"]: (x["raw_label"], x["label"]) for x in members.collect()}
    small = {v for v in label if v >= 0 and (label == v).sum() < 6}
    assert not there and got == {k: (int(v), -1 if v in small else int(v)) for k, v in zip(kept, label, strict=True)}
    rows = table.orderBy(F.desc("point_count")).collect()
    assert [x["status"] for x in rows] == ["in_review_batch", "outside_review_batch", "below_min_cluster_points"] and rows[0]["touches_region_boundary"] and not rows[1]["touches_region_boundary"]
    c = counts.first()
    assert (c["points"], c["noise_points"], c["clusters"], c["kept_clusters"], c["batch_clusters"]) == (41, 1, 3, 2, 1)
    assert runs.extract_candidates(source, str(tmp_path), {"file": "a"}, 1.2, 6, 3, 1, (-5.0, 50.0, -0.5, 50.0))[3]
    assert not runs.extract_candidates(source, str(tmp_path), {"file": "b"}, 1.2, 6, 3, 1, (-5.0, 50.0, -0.5, 50.0))[3]
    for bad in ({"most": 3}, {"min_samples": 0}, {"max_candidates": 31}):
        with pytest.raises(ValueError):
            runs.extract_candidates(source, str(tmp_path), {"file": "a"}, 1.2, 6, **bad)


def test_query_points(spark):
    points = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("g"))
    one, two = (shape.query_points(p, ["g"], 512) for p in (points, points.repartition(5).orderBy(F.desc("row_id"))))
    a, b = (sorted(map(tuple, d.collect())) for d in (one, two))
    assert a == b and sorted(g for _, g in a) == ["a"] * 512 + ["b"] * 500
    assert {r["row_id"] for r in shape.query_points(points, ["g"], 512, seed=1).collect()} != {k for k, _ in a}


def test_collect_observations(spark, tmp_path):
    """The latest report of each kind, with hashes of what it names; a file that was changed or is gone is refused."""
    digest = {}
    for name in ("c1", "c2", "m1", "m2"):
        (tmp_path / name).write_text(name * 3)
        digest[name] = hashlib.sha256((name * 3).encode()).hexdigest()
    item = lambda k, roi: {"candidate_id": f"p{k}", "region": f"r{k}", "region_roi": roi, **{n: {"path": f"{tmp_path}/{n[0]}{k}", "sha256": digest[f"{n[0]}{k}"]} for n in ("crop", "membership")}}
    documents.atomic_json(str(tmp_path / "a_1.json"), {"source_identity": "s", "items": []})
    documents.atomic_json(str(tmp_path / "a_2.json"), {"source_identity": "s", "items": [item(1, [0, 1]), item(2, [0, 1])]})
    documents.atomic_json(str(tmp_path / "b_1.json"), {"source_identity": "t", "items": [item(1, [0, 1])]})
    documents.atomic_json(str(tmp_path / "f.json"), {"entries": [{"id": "p1"}]})
    reports = spark.createDataFrame([(n[0], str(tmp_path / f"{n}.json")) for n in ("a_1", "a_2", "b_1")], "kind string, path string")
    rows = sorted(map(tuple, batches.collect_observations(spark, reports, str(tmp_path / "f.json"), 3).select("kind", "candidate_id", "region_id", "feature_reference").collect()))
    assert [r[:2] for r in rows] == [("a", "p1"), ("a", "p2"), ("b", "p1")] and rows[0][2] == rows[1][2] != rows[2][2] and rows[0][2].startswith("region_") and len(rows[0][2]) == 23
    assert [r[3] is not None for r in rows] == [True, False, True]
    with pytest.raises(ValueError, match="3 items"):
        batches.collect_observations(spark, reports, expected=5)
    (tmp_path / "m2").write_text("other")
    with pytest.raises(ValueError, match="m2: not as"):
        batches.collect_observations(spark, reports)
    (tmp_path / "m2").unlink()
    with pytest.raises(ValueError, match="m2: FileNotFound"):
        batches.collect_observations(spark, reports)
