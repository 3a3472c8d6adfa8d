"""Clusters are labelled once, whatever follows from them."""

from cloudstrata.plans import registry


def test_labels_are_read_from_files(spark, sf_dir):
    labelled = registry.point_queries._clustered(spark, sf_dir)[0]
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
