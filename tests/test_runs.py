"""Saved runs, sources, review stores, figures and colours."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from cloudstrata.operators import batches, figures, profile, ranking, records, render, reviews, runs
from cloudstrata.sources import documents

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def pts(spark):
    return spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") / 10).alias("y"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 3 == 0).alias("ground"))


def test_parameters():
    assert runs.checked_parameters(eps=0.5, min_samples=5, tolerance=0) == {"eps": 0.5, "min_samples": 5, "tolerance": 0}
    for bad in ({"eps": 0}, {"eps": float("nan")}, {"min_samples": 2.5}, {"min_samples": True}, {"rigidness": 4}, {"padding": -1}, {"other": 1}, {"eps": "1"}):
        with pytest.raises(ValueError):
            runs.checked_parameters(**bad)


def test_guarded_region(pts):
    assert runs.guarded_region(pts, (2, 5), (1, 3), 1.0).filter("core").count() > 0
    for call in (lambda: runs.guarded_region(pts, (2, 5), (1, 3), 1.0, most_points=5), lambda: runs.guarded_region(pts, (2, 2), (1, 3)), lambda: runs.guarded_region(pts, (0, 900), (0, 900))):
        with pytest.raises(ValueError):
            call()


def test_complementary(pts):
    runs.complementary(pts, [pts.filter("ground"), pts.filter("not ground")])
    for parts in ([pts.filter("ground")], [pts, pts.filter("ground")], [pts, pts.limit(1).withColumn("row_id", F.lit(99).cast("long"))]):
        with pytest.raises(ValueError):
            runs.complementary(pts, parts)


def test_reload(spark, pts, tmp_path):
    folder = runs.run_folder(str(tmp_path), "ground")
    assert folder != runs.run_folder(str(tmp_path), "ground")
    facts = {"side": "left", "roi": [0, 1], "padding": 2.0}
    runs.save_run(pts, folder, facts, COLUMNS)
    plain = pts.drop("ground")
    assert runs.reload_run(spark, folder, plain, facts, COLUMNS).filter("ground").count() == 20
    for other, rows in (({**facts, "padding": 3.0}, plain), (facts, plain.withColumn("x", F.col("x") + 1)), (facts, plain.unionByName(plain.withColumn("row_id", F.col("row_id") + 100)))):
        with pytest.raises(ValueError):
            runs.reload_run(spark, folder, rows, other, COLUMNS)
    with pytest.raises(FileExistsError):
        runs.create_json(f"{folder}/manifest.json", {})
    path = runs.review_snapshot(folder, spark.createDataFrame([("a", 1)], "method string, points int"), {"seen": "well"})
    assert json.load(open(path))["comparison_rows"] == [{"method": "a", "points": 1}]


def test_source(spark, pts, tmp_path):
    file = tmp_path / "a.txt"
    file.write_text("one")
    identity = runs.source_identity(spark, [str(file)], {"side": "left"})
    coloured = pts.drop("ground").withColumns({"core": F.col("x") < 5, "red": F.lit(0.5), "green": F.lit(0.5), "blue": F.lit(0.5)})
    parts = {"ground": coloured.filter("z < 3"), "non_ground": coloured.filter("z >= 3")}
    load = lambda: coloured
    out, there = runs.load_source(spark, str(tmp_path / "cache"), identity, load, parts, ["row_id", *COLUMNS])
    assert not there and out.filter("eligible").count() == coloured.filter("core and z >= 3").count()
    assert runs.load_source(spark, str(tmp_path / "cache"), identity, load, parts, ["row_id", *COLUMNS])[1]
    file.write_text("two")
    assert runs.source_identity(spark, [str(file)], {"side": "left"}) != identity
    for bad_load, kwargs in ((load, {"most": 3}), (lambda: coloured.drop("red"), {})):
        with pytest.raises(ValueError):
            runs.load_source(spark, str(tmp_path / "other"), {**identity, "k": str(kwargs)}, bad_load, {k: v.drop("red") if not kwargs else v for k, v in parts.items()}, ["row_id", *COLUMNS], **kwargs)


def test_store_restarts(spark, tmp_path):
    candidates = spark.createDataFrame([("a_1", "[secret]"), ("b_2", None)], "candidate_id string, predictions string")
    evidence = spark.createDataFrame([("a_1", "r/1", "m", ["p", "q"])], "candidate_id string, path string, model string, prompts array<string>")
    one = reviews.ReviewStore(spark, str(tmp_path / "s"), candidates)
    assert one.cursor == "a_1" and reviews.public_view(candidates).columns == ["candidate_id"]
    assert one.reveal("a_1", evidence=evidence)[0]["path"] == "r/1" and one.reveal("b_2", evidence=evidence) == []
    assert one.save("a_1", "Windmill", "usable single object", expected_revision=0) == 1
    one.position("b_2", "ann")
    two = reviews.ReviewStore(spark, str(tmp_path / "s"), candidates)
    assert two.cursor == "b_2" and two.classes[-1] == "Windmill" and len(two.classes) == len(reviews.CLASSES) + 1
    assert two.save("a_1", None, "unclear", expected_revision=1) == 2 and two.reviews.count() == 2
    with pytest.raises(reviews.RevisionConflict):
        two.save("a_1", None, "unclear", expected_revision=1)
    assert {r["candidate_id"]: r["suggestions_available"] for r in two.exposures.collect()} == {"a_1": True, "b_2": False}
    assert reviews.ReviewStore(spark, str(tmp_path / "s"), candidates.filter("candidate_id <> 'b_2'")).cursor == "a_1"
    refs = {r["candidate_id"]: r["references"] for r in reviews.evidence_references(candidates, evidence).collect()}
    assert len(refs["a_1"]) == 1 and refs["b_2"] == []
    groups = candidates.select("candidate_id", F.lit("g").alias("group"))
    manifest = two.export_file(groups, str(tmp_path / "out.csv"))
    raw = open(tmp_path / "out.csv", "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and manifest["rows"] == 2 and manifest["reviewed"] == 1 and manifest["eligible"] == 0
    assert [r["candidate_id"] for r in csv.DictReader(raw.decode("utf-8-sig").splitlines())] == ["a_1", "b_2"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Two stores that saw the same revision: one saves the next, the other is told."""
    who = spark.createDataFrame([("a_1",), ("x/../y",)], "candidate_id string")
    one, two = (reviews.ReviewStore(spark, str(tmp_path / "s"), who) for _ in range(2))
    assert one.save("a_1", "Vehicle", "unclear") == 1
    seen = two.reviews.collect()
    assert one.save("a_1", "Debris", "unclear", expected_revision=1) == 2
    monkeypatch.setattr(reviews.ReviewStore, "reviews", property(lambda self: spark.createDataFrame(seen, reviews.REVIEW)))  # what the other writer read before
    for expected in (1, None):
        with pytest.raises(reviews.RevisionConflict):
            two.save("a_1", "Vehicle", "unclear", expected_revision=expected)
    monkeypatch.undo()
    assert two.save("x/../y", None, "unclear", expected_revision=0) == 1
    rows = sorted((r["candidate_id"], r["revision"], r["human_class"]) for r in two.reviews.collect())
    assert rows == [("a_1", 1, "Vehicle"), ("a_1", 2, "Debris"), ("x/../y", 1, None)] and two.reviews.filter("saved_utc is null").count() == 0
    with pytest.raises(FileExistsError):
        documents.create_text(spark, f"file://{tmp_path}/t.json", "1") or documents.create_text(spark, f"file://{tmp_path}/t.json", "2")
    assert documents.read_json(spark, f"file://{tmp_path}/t.json") == 1


def test_json(tmp_path):
    import datetime as dt

    import numpy as np

    value = {"nan": float("nan"), "inf": [float("inf"), 1.5], "n": np.int64(3), "a": np.array([1.0, np.nan]), "t": dt.date(2024, 5, 1), 4: {"x": {2, 1}}, "b": np.bool_(True)}
    documents.atomic_json(str(tmp_path / "a.json"), value)
    runs.create_json(str(tmp_path / "b.json"), value)
    want = {"nan": None, "inf": [None, 1.5], "n": 3, "a": [1.0, None], "t": "2024-05-01", "4": {"x": [1, 2]}, "b": True}
    assert json.load(open(tmp_path / "a.json")) == json.load(open(tmp_path / "b.json")) == want


def test_figure(pts):
    members = pts.filter("x between 3 and 5 and y < 3")
    context, own, edges = figures.candidate_frames(pts, members, 1.0)
    assert own.count() == members.count() and context.join(own, "row_id").count() == 0 and edges.count() == 12
    assert context.count() + own.count() == batches.candidate_context(pts, members, 1.0).count()


def test_colours(spark):
    df = spark.createDataFrame([(0, 0.0, 0.5, 1.0), (1, 1.0, 0.0, 0.25)], "row_id long, red double, green double, blue double")
    drawn = spark.createDataFrame([("front", 1, 2, 0), ("front", 3, 3, 1)], "view string, py int, px int, row_id long")
    rgb = render.coloured(drawn, df)
    assert {(r["row_id"], r["red"], r["green"], r["blue"]) for r in rgb.collect()} == {(0, 0, 128, 255), (1, 255, 0, 64)}
    assert render.images(rgb, 8).first()["png"].startswith(b"\x89PNG")
    assert df.select(render.normalised_colour(F.col("red") * 0 + 255, "uint8").alias("c")).first()["c"] == 1.0
    with pytest.raises(Exception, match="share"):
        df.select(render.normalised_colour(F.col("red") + 1, "float").alias("c")).collect()


def test_small_helpers(spark, pts):
    stats, counts = profile.statistics(pts, ["x"]), profile.value_counts(pts, ["z"])
    doc = json.loads(profile.json_profile(stats, counts).first()["profile"])
    assert doc["dimensions"][0]["dimension"] == "x" and len(doc["counts"]) == 7
    assert "x: n=60" in profile.text_report(stats.collect(), counts.collect()) and profile.same_schema(pts, pts) and not profile.same_schema(pts, pts.drop("x"))
    assert batches.normal_parameters({"cloth_resolution_m": 1, "eps": 2}) == {"cloth_resolution": 1, "eps": 2}
    reports = spark.createDataFrame([("a", "a/1", [(1,)]), ("a", "a/2", [(2,), (3,)]), ("b", "b/1", [(4,)])], "kind string, path string, crops array<struct<crop:int>>")
    assert sorted((r["path"], r["crop"]) for r in batches.observations(reports, 3).collect()) == [("a/2", 2), ("a/2", 3), ("b/1", 4)]
    with pytest.raises(ValueError):
        batches.observations(reports, 5)
    members = pts.filter("row_id < 4").select(F.lit("c").alias("candidate_id"), "row_id", *COLUMNS)
    assert batches.original_candidate(members, pts, "c", COLUMNS).count() == 4
    with pytest.raises(ValueError):
        batches.original_candidate(members, pts, "d", COLUMNS)
    assert documents.latest_path(reports.select("kind", "path"), "kind").count() == 2

    class Fixed(ranking.EmbeddingProvider):
        def of_views(self, views):
            return views.withColumn("features", F.array(F.lit(1.0), F.col("view").cast("double")))

        def of_prompts(self, prompts):
            return spark.createDataFrame([(p, [1.0, float(k)]) for k, p in enumerate(prompts)], "prompt string, features array<double>")

    scores, order, split = ranking.score_candidates(Fixed(), spark.createDataFrame([("c", 0), ("c", 1)], "candidate string, view int"), ["a", "b"])
    assert scores.count() == 4 and order.count() == 2 and split.first()["disagreement"] == 0.5
    with pytest.raises(NotImplementedError):
        ranking.EmbeddingProvider().of_views(pts)
    assert records.typical_cell(spark.createDataFrame([(0.0, 2.0, 0.0, 4.0)], "min_x double, max_x double, min_y double, max_y double")) == 8.0


def test_quantiles(spark):
    import numpy as np

    from cloudstrata.functions.numbering import quantiles

    r = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in ((None, 1), (1, 40), (2, 333)) for v in r.integers(0, 20, n)] + [(1, None), (3, None)]
    got = {x["g"]: x["quantiles"] for x in quantiles(spark.createDataFrame(rows, "g long, v double"), "v", [0, 0.1, 0.5, 0.99, 1], ["g"]).collect()}
    for g in (None, 1, 2):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0, 0.1, 0.5, 0.99, 1]))
    assert set(got) == {None, 1, 2} and quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() <= 1
