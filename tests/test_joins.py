"""Joins with a key that holds most rows."""

from pyspark.sql import functions as F

from cloudstrata.functions import graph, joins
from cloudstrata.session import cut


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 50)
    big = cut(spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("long").alias("k"), "id"), "big")
    small = spark.createDataFrame([(7, "a"), (7, "b"), (2, "c"), (None, "n")], "k long, v string")
    assert joins.hot_keys(big, ["k"]).collect() == [(7,)]
    for how in ("inner", "left", "left_semi"):
        got, want = joins.join_hot(big, small, ["k"], how), big.join(small, ["k"], how)
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert joins.hot_keys(small, ["k"]) is None and joins.hot_keys(big.limit(0), ["k"]) is None


def test_components_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 50)
    edges = spark.range(1, 400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.createDataFrame([(500, 501), (501, 502), (600, 600)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(400)}, 500: 500, 501: 500, 502: 500, 600: 600}
