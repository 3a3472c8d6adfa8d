"""Profiles of point streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloudstrata.operators.profile import statistics


def running_statistics(points: DataFrame, dimensions: list[str]) -> DataFrame:
    """statistics of a stream, for output mode complete; percentiles are sketches."""
    return statistics(points, dimensions, exact=False)
