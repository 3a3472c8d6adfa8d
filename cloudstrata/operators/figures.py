"""The tables behind a candidate's figure: context, candidate and the edges of its box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.numbering import quantiles
from cloudstrata.operators.batches import candidate_context
from cloudstrata.operators.profile import AXES, finite
from cloudstrata.operators.regions import even_sample

#: Points of the context that are drawn at most.
MOST_CONTEXT = 20_000


def suggested_centre(points: DataFrame) -> DataFrame:
    """One row: the medians of x and y of finite points, exact and found by ranges of values."""
    both = points.filter(finite(F.col("x")) & finite(F.col("y"))).select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xy"])))
    found = quantiles(both, "v", [0.5], ["axis"])
    return found.agg(*[F.max(F.when(F.col("axis") == a, F.col("quantiles")[0])).alias(a) for a in "xy"])


def box_edges(boxes: DataFrame, key: str) -> DataFrame:
    """key, edge (0 to 11) and both ends of each edge of a box: four along each axis."""
    edges = []
    for along in range(3):
        others = [a for k, a in enumerate(AXES) if k != along]
        for corner in range(4):
            ends = {}
            for end, side in (("from", "min"), ("to", "max")):
                ends[end] = {AXES[along]: f"{side}_{AXES[along]}", **{o: f"{'max' if corner >> j & 1 else 'min'}_{o}" for j, o in enumerate(others)}}
            edges.append(F.struct(F.lit(len(edges)).alias("edge"), *[F.col(ends[end][a]).alias(f"{end}_{a}") for end in ends for a in AXES]))
    return boxes.select(key, F.inline(F.array(*edges)))


def candidate_frames(points: DataFrame, members: DataFrame, padding: float, most: int = MOST_CONTEXT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three traces: an even sample of the points around a candidate without its own, all of its own, and the edges of its box."""
    near = candidate_context(points, members, padding)
    own = near.filter("member").drop("member")
    context = even_sample(near.filter("not member").drop("member"), most, ["row_id"])
    box = own.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]).withColumn("candidate", F.lit(0))
    return context, own, box_edges(box, "candidate")
