"""Neighbour joins at size: nothing repeated is broadcast, and nearest neighbours take two rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.functions import joins
from cloudstrata.operators import neighbours, shape


def cloud(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "row_id long, x double, y double, z double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_points_are_not_broadcast(spark):
    p = cloud(spark, np.random.default_rng(1).random((50, 3)))
    joined = neighbours.radius_join(p, p, 0.3)
    assert "Broadcast" not in plan(joined) and "Broadcast" not in plan(shape.local_features(p.withColumn("g", F.lit(1)), p.withColumn("g", F.lit(1)), 0.3, ["g"]))


@pytest.mark.parametrize("radius", [0.25, 1.0])
def test_radius_pairs(spark, radius):
    """Points on the borders of cells and exactly a radius apart, on both sides of zero."""
    xyz = np.stack(np.meshgrid(*[np.arange(-1.0, 1.25, 0.5)] * 3), -1).reshape(-1, 3)
    got = {(r["a"], r["b"]) for r in neighbours.radius_join(cloud(spark, xyz), cloud(spark, xyz), radius).select(F.col("q.row_id").alias("a"), F.col("p.row_id").alias("b")).collect()}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert got == {(int(a), int(b)) for a, b in np.argwhere(d2 <= radius**2)}


@pytest.mark.parametrize("few", [20, 50_000])
def test_tail_in_two_rounds(spark, monkeypatch, few):
    """Points with a long tail on one axis, by many tiles: results are put together once, also where many queries share a tile and are dealt."""
    monkeypatch.setattr(joins, "FEW_ROWS", few)
    monkeypatch.setattr(neighbours, "TILE_POINTS", 64)
    rounds, plain = [], neighbours._nearest_of
    monkeypatch.setattr(neighbours, "_nearest_of", lambda pairs, k: rounds.append(1) or plain(pairs, k))
    r = np.random.default_rng(3)
    xyz = np.column_stack([r.random((600, 2)) * 30, r.exponential(50, 600) ** 1.5])
    asked = np.concatenate([xyz[:300], np.repeat([[15.0, 15.0, 9e4]], 200, 0)])
    got = {(x["query"], x["rank"]): (x["neighbour"], x["distance"]) for x in neighbours.k_nearest(cloud(spark, asked), cloud(spark, xyz), 3).collect()}
    d = np.sqrt(((asked[:, None] - xyz[None]) ** 2).sum(2))
    order = np.argsort(d, 1, "stable")
    assert len(got) == 1500 and len(rounds) == 1
    for (q, rank), (n, distance) in got.items():
        assert n == order[q, rank - 1] and distance == pytest.approx(d[q, n], abs=1e-9)


def test_groups_apart(spark):
    """Neighbours within groups, of which one has fewer points than asked for; rows without finite coordinates take no part."""
    r = np.random.default_rng(4)
    xyz = np.concatenate([r.random((700, 3)), [[np.nan, 0, 0], [np.inf, 0, 0]]])
    p = cloud(spark, xyz).withColumn("g", F.when(F.col("row_id") < 2, 1).otherwise(2))
    got = {(x["query"], x["rank"]): x["neighbour"] for x in neighbours.k_nearest(p, p, 2, ["g"], other=True).collect()}
    assert {key: n for key, n in got.items() if key[0] < 2} == {(0, 1): 1, (1, 1): 0}
    d = ((xyz[2:700, None] - xyz[None, 2:700]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 2 + 2 * 698 and all(got[q + 2, 1] == n + 2 for q, n in enumerate(d.argmin(1)))
