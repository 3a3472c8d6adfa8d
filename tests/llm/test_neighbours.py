"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.llm import neighbours


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 1200)] + 0.5 * r.normal(size=(1200, 16))
    if scaled:
        x *= r.random((1200, 1)) + 0.2
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0, 10, block=500).collect()
    hit = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        got = sorted((g["rank"], g["vec_id"], g["score"]) for g in rows if g["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(math.isclose(s[i], v, abs_tol=1e-9) for _, i, v in got)
        hit += len({g[1] for g in got} & set(np.argsort(-s)[:10].tolist()))
    assert hit >= 0.9 * 600


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0, 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.nearest(df.limit(0), F.pmod("id", F.lit(20)) == 0, 20).count() == 0


def clustered(seed, n, d=16, centres=40, spread=0.15):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, d))
    x = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame_of(spark, x):
    return spark.createDataFrame([(int(k), v.tolist(), "extra", 0.5) for k, v in enumerate(x)], "vec_id long, embedding array<double>, part string, score double")


def recall_of(rows, x, step, k):
    got: dict[int, set] = {}
    for g in rows:
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    hit = n = 0
    for q in range(0, len(x), step):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == k
        hit, n = hit + len(got[q] & set(np.argsort(-s, kind="stable")[:k].tolist())), n + k
    return hit / n


def test_many_regions(spark, monkeypatch):
    """Recall over many regions, and work that grows about as the rows do where vectors have structure."""
    monkeypatch.setattr(neighbours, "CHUNK", 100)
    work = {}
    for n in (2_000, 8_000):
        x = clustered(5, n)
        rows = neighbours.usable(frame_of(spark, x), "vec_id", "embedding").withColumn("asked", F.pmod("id", F.lit(20)) == 0)
        best, told = neighbours._search(rows, n, neighbours._Index(16, 1.0, 11, neighbours.CONFIDENCE), 250)
        assert told.filter("low is not null").count() == n // 250
        work[n] = told.agg(F.sum("verified")).first()[0], told.count(), n * n / 20
        assert recall_of(best.filter("query_id <> vec_id").collect(), x, 20, 10) >= 0.95
    assert all(v < 0.5 * pairs for v, _, pairs in work.values())  # of all pairs of a query and a vector
    assert work[8_000][1] < 8 * work[2_000][1]  # groups of a region and a chunk of queries: what travels


def test_equal_vectors(spark, monkeypatch):
    """A vector of most rows, and some of a few, in several regions and with salted joins."""
    from cloudstrata.functions import joins

    monkeypatch.setattr(joins, "FEW_ROWS", 100)
    x = clustered(6, 900)
    x[::2] = x[0]
    x[1:60:4] = x[1]
    rows = sorted(tuple(r) for r in neighbours.nearest(frame_of(spark, x), F.pmod("id", F.lit(20)) == 0, 20, block=100).collect())
    want = []
    for q in range(0, 900, 20):
        s = np.round(x @ x[q], 9)
        best = [v for v in np.lexsort((np.arange(900), -s)).tolist() if v != q][:20]
        want += [(q, k + 1, v) for k, v in enumerate(best)]
    assert [r[:3] for r in rows] == want


def test_chi_square():
    r = np.random.default_rng(2)
    for m in (2, 6, 8):
        draws = (r.normal(size=(40_000, m)) ** 2).sum(1)
        for x in (1.0, 5.0, 12.0):
            assert abs((draws <= x).mean() - neighbours.chi_square(np.array(x), m)) < 0.01
