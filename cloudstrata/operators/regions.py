"""Regions, slices, samples and joins with boxes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import signed, spatial_hash, unsigned_order
from cloudstrata.functions.numbering import placed_in_groups
from cloudstrata.operators.profile import AXES
from cloudstrata.session import cut

#: Seeds of the sides' samples; fixed values.
SIDE_SEEDS = {"left": 101, "right": 202}


def inside(bounds: dict[str, tuple[float, float]]) -> Column:
    """Closed at both ends, in the axes given."""
    out = F.lit(True)
    for a, (low, high) in bounds.items():
        out = out & F.col(a).between(F.lit(float(low)), F.lit(float(high)))
    return out


def region(points: DataFrame, x: tuple[float, float], y: tuple[float, float], padding: float = 10.0, most: int | None = None) -> DataFrame:
    """The points of a padded rectangle, with core (in the rectangle itself). most: an error beyond it, instead of a cut."""
    out = points.filter(inside({"x": (x[0] - padding, x[1] + padding), "y": (y[0] - padding, y[1] + padding)})).withColumn("core", inside({"x": x, "y": y}))
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"the region has more than {most} points")
    return out


def elevation_slice(points: DataFrame, axis: str, at: float, width: float) -> DataFrame:
    """Points within half a width of a plane, closed."""
    return points.filter(F.abs(F.col(axis) - F.lit(float(at))) <= F.lit(width / 2))


def hash_sample(points: DataFrame, target: int, total: int, seed: int) -> DataFrame:
    """Points whose spatial hash is at most the share target / total of all hashes. Coincident points stay or go together; a share of 1 keeps all."""
    share = min(1.0, target / max(total, 1))
    if share >= 1:
        return points
    limit = F.lit(signed(int(share * float(2**64)))).cast("long")
    return spatial_hash(points, seed, "__score").filter(unsigned_order(F.col("__score")) <= unsigned_order(limit)).drop("__score")


def first_of_voxels(points: DataFrame, size: float, anchor: str = "absolute", by: list[str] | None = None) -> DataFrame:
    """The point of least row_id of each cubic voxel. anchor: absolute, or least for a grid from the group's least coordinates."""
    by = by or []
    if anchor == "least":
        low = points.groupBy(*by).agg(*[F.min(a).alias(f"__o{a}") for a in AXES])
        points = points.join(low, by) if by else points.crossJoin(low)  # one row
    origin = {a: F.col(f"__o{a}") if anchor == "least" else F.lit(0.0) for a in AXES}
    cells = {f"__c{a}": F.floor((F.col(a) - origin[a]) / F.lit(float(size))) for a in AXES}
    chosen = points.withColumns(cells).groupBy(*by, *cells).agg(F.min_by(F.struct(*points.columns), "row_id").alias("p"))
    return chosen.select("p.*").drop(*[f"__o{a}" for a in AXES])


def even_sample(rows: DataFrame, most: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """At most `most` rows of each group, evenly spaced in order, which tells all rows of a group apart: all if there are no more, else rows trunc(k (n - 1) / (most - 1)), the last being n - 1, or the first alone for most = 1."""
    keys = [*(by or []), *order]
    numbered = placed_in_groups(rows.select(*keys), by or [], order, "__rn", "__n")  # other columns of other rows aren't moved
    if most == 1:
        wanted = F.col("__rn") == 0
    else:
        # the k whose place may be this row lie next to rn / step
        step = (F.col("__n") - 1).cast("double") / F.lit(float(most - 1))
        guess = F.floor(F.col("__rn") / step)
        near = F.array(*[guess + d for d in (-1, 0, 1, 2)])
        wanted = (F.col("__rn") == F.col("__n") - 1) | F.exists(near, lambda j: (j >= 0) & (j < most - 1) & (F.floor(j * step) == F.col("__rn")))
    chosen = numbered.filter((F.col("__n") <= most) | wanted).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"__{k}"))
    return rows.join(chosen, same, "left_semi")


def representatives(rows: DataFrame, label: str, most: int, key: str) -> DataFrame:
    """The row of least key of each label, and an even sample of the rest up to `most` rows; an error if there are more labels."""
    first = cut(rows.groupBy(label).agg(F.min(key).alias(key)), "representatives")
    labels = first.count()
    if labels > most:
        raise ValueError(f"{labels} labels don't fit into {most} rows")
    out = rows.join(first.select(key), key, "left_semi").select(*rows.columns)
    rest = rows.join(first.select(key), key, "left_anti").select(*rows.columns)
    return out if labels == most else out.unionByName(even_sample(rest, most - labels, [key]))


def box_points(points: DataFrame, boxes: Iterable[tuple[str, dict[str, tuple[float, float]]]], margin_xy: float = 0.0) -> DataFrame:
    """box, and the points in it, closed in three dimensions, in one scan. Boxes are a few literals; a point in several comes several times."""
    names = F.array_compact(F.array(*[F.when(inside({a: (lo - margin_xy, hi + margin_xy) if a != "z" else (lo, hi) for a, (lo, hi) in b.items()}), F.lit(n)) for n, b in boxes]))
    return points.withColumn("box", F.explode(names))


def local_coordinates(points: DataFrame, by: list[str] | None = None, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """points with local_x, local_y and local_z: coordinates less one shared origin, which is given or each group's least."""
    if origin is not None:
        return points.withColumns({f"local_{a}": F.col(a) - F.lit(float(o)) for a, o in zip(AXES, origin, strict=True)})
    by = by or []
    low = points.groupBy(*by).agg(*[F.min(a).alias(f"__o{a}") for a in AXES])
    joined = points.join(low, by) if by else points.crossJoin(low)  # one row
    return joined.withColumns({f"local_{a}": F.col(a) - F.col(f"__o{a}") for a in AXES}).select(*points.columns, *[f"local_{a}" for a in AXES])


def axis_limits(points: DataFrame, by: list[str], share: float, least: float) -> DataFrame:
    """low and high of each axis with padding of a share of its span, or at least so much."""
    box = points.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    pad = lambda a: F.greatest(F.lit(least), F.lit(share) * (F.col(f"max_{a}") - F.col(f"min_{a}")))
    return box.select(*by, *[e for a in AXES for e in ((F.col(f"min_{a}") - pad(a)).alias(f"low_{a}"), (F.col(f"max_{a}") + pad(a)).alias(f"high_{a}"))])
