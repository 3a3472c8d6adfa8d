"""Shape features of neighbourhoods with many coincident points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.operators import shape


def cloud(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "row_id long, x double, y double, z double")


def test_coincident_points_are_met_once(spark, monkeypatch):
    """40 copies of 8 places: features as from all points, by 8 pairs for a point rather than 320."""
    places = np.random.default_rng(2).random((8, 3)) + [4e5, 5e6, 100.0]
    p, made, plain = cloud(spark, np.repeat(places, 40, 0)).withColumn("g", F.lit(1)), [], shape.radius_join
    monkeypatch.setattr(shape, "radius_join", lambda *a: made.append(plain(*a)) or made[-1])
    rows = shape.local_features(p, p, 2.0, ["g"]).collect()
    assert made[0].count() == 320 * 8 and len(rows) == 320
    want = shape.shape_features(cloud(spark, np.repeat(places - places[0], 40, 0)).withColumn("g", F.lit(1)), ["g"]).first()
    for r in rows:
        assert r["count"] == 320 and r["status"] == "valid"
        assert all(r[n] == pytest.approx(want[n], abs=1e-7) for n in ("cxx", "cxy", "cyz", "linearity", "planarity", "scattering", "extent_x", "extent_z"))
    alone = shape.local_features(p, p.filter("row_id < 40"), 2.0, ["g"])  # all neighbours in one place, which isn't that of most queries
    assert {(r["status"], r["l1"]) for r in alone.select("status", "l1").distinct().collect()} == {("zero_variance", 0.0)}
