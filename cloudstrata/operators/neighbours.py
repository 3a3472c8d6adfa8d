"""Neighbour joins: radius pairs over a grid, nearest neighbours over tiles.

Radius pairs meet in cells as wide as two radii: a query is in its own cell, a
point in all cells that its radius touches, eight on average. Nearest neighbours
are looked for in tiles of about equally many points, first in a query's own tile, then in
those that its k-th neighbour so far doesn't rule out.
Coincident points are one node with a count, or only the least of them can be
among the nearest: many equal points don't multiply. A tile that very many
queries share is dealt over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.joins import SALT, copied, dealt, hot_keys
from cloudstrata.functions.numbering import quantiles
from cloudstrata.operators.profile import AXES
from cloudstrata.session import cut

#: Points of a leaf, which a query meets pair by pair; points of a tile, tiles (as a power of two) and points for each tile from which their borders are taken, at most.
PAIRS, TILE_POINTS, MOST_HALVINGS, SAMPLE = 128, 16_384, 12, 16


def _squared(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) * (F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) for x in AXES[1:]), (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))


def radius_join(queries: DataFrame, points: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """q.* and p.* as structs, and squared distance, of all pairs at most a radius apart, within groups of `by`. A point that is in both pairs with itself.

    Points are repeated by cell, which Spark's estimates of sizes don't see: the hint keeps them from being broadcast.
    """
    by = by or []
    width, reach = F.lit(2 * float(radius)), F.lit(float(radius) * (1 + 1e-9))  # a little more, for pairs that are a radius apart but for rounding
    cell = [f"c{a}" for a in AXES]
    q = queries.select(*by, F.struct(*queries.columns).alias("q"), *[F.floor(F.col(a) / width).alias(c) for a, c in zip(AXES, cell, strict=True)])
    p = points.select(*by, *AXES, F.struct(*points.columns).alias("p"))
    for a, c in zip(AXES, cell, strict=True):
        p = p.withColumn(c, F.explode(F.sequence(F.floor((F.col(a) - reach) / width), F.floor((F.col(a) + reach) / width)))).drop(a)
    joined = q.hint("merge").join(p, [*by, *cell])
    return joined.select(*by, "q", "p", _squared("q", "p").alias("d2")).filter(F.col("d2") <= radius * radius)


def nodes(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct coordinates with their number of points and least row_id."""
    return points.groupBy(*(by or []), *AXES).agg(F.count("*").alias("weight"), F.min("row_id").alias("row_id"))


def _nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    """query, rank, neighbour and distance of the k nearest pairs (query, neighbour, d2) of each query; ties to the smaller neighbour. For one, tasks find the least before the shuffle."""
    if k == 1:
        best = pairs.groupBy("query").agg(F.min(F.struct("d2", "neighbour")).alias("n")).select("query", F.lit(1).alias("rank"), "n.neighbour", "n.d2")
    else:
        best = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d2", "neighbour"))).filter(F.col("rank") <= k)
    return best.select("query", "rank", "neighbour", F.sqrt("d2").alias("distance"))


class Halvings:
    """Space halved again and again at medians of points along their widest axis; a complete tree, whose leaves are tiles."""

    def __init__(self, xyz: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [xyz]
        for node in range(2**depth - 1):
            own = parts[node]
            if len(own):
                a = self.axis[node] = int(np.argmax(own.max(0) - own.min(0)))
                v = own[:, a]
                self.at[node] = np.partition(v, len(v) // 2)[len(v) // 2]
                parts += [own[v < self.at[node]], own[v >= self.at[node]]]
            else:
                parts += [own, own]
            parts[node] = None

    def tile(self, xyz: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(xyz), np.int64), np.arange(len(xyz))
        for _ in range(self.depth):
            node = 2 * node + 1 + (xyz[rows, self.axis[node]] >= self.at[node])
        return node - (2**self.depth - 1)

    def bound(self, low: np.ndarray, high: np.ndarray) -> None:
        """Takes the boxes of the points in each tile; those of empty ones are turned around."""
        self.low, self.high = low, high
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low, self.high = np.concatenate([low, self.low]), np.concatenate([high, self.high])

    def reached(self, xyz: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tiles whose boxes aren't farther (squared) than the row's limit."""
        row, node = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        for level in range(self.depth + 1):
            if level:
                row, node = np.repeat(row, 2), np.repeat(2 * node + 1, 2)
                node[1::2] += 1
            with np.errstate(invalid="ignore"):
                v = xyz[row]
                gap = np.maximum(np.maximum(self.low[node] - v, v - self.high[node]), 0.0)
                near = (self.low[node, 0] <= self.high[node, 0]) & (gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] <= limit[row])
            row, node = row[near], node[near]
        return row, node - (2**self.depth - 1)


def _best(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row in order, ties to the smaller id; infinite where there are fewer."""
    if d2.shape[1] > k:
        row, column = np.nonzero((d2 <= np.partition(d2, k - 1, 1)[:, k - 1 : k]) & np.isfinite(d2))
    else:
        row, column = np.nonzero(np.isfinite(d2))
    d, i = d2[row, column], ids[row, column]
    order = np.lexsort((i, d, row))
    row, d, i = row[order], d[order], i[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    out, name = np.full((len(d2), k), np.inf), np.zeros((len(d2), k), np.int64)
    keep = rank < k
    out[row[keep], rank[keep]], name[row[keep], rank[keep]] = d[keep], i[keep]
    return out, name


def nearest_in(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray, own: np.ndarray | None = None, leaf: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids of the k nearest points of each query that aren't farther (squared) than its limit, by leaves of points; not that whose id is the query's own."""
    found, names = np.full((len(queries), k), np.inf), np.zeros((len(queries), k), np.int64)
    if not len(points):
        return found, names
    halvings = Halvings(points, max(0, math.ceil(math.log2(len(points) / max(leaf, 1)))))
    at = halvings.tile(points)
    order = np.argsort(at, kind="stable")
    points, ids, at = points[order], ids[order], at[order]
    ends = np.searchsorted(at, np.arange(2**halvings.depth + 1))
    low, high = np.full((len(ends) - 1, 3), np.inf), np.full((len(ends) - 1, 3), -np.inf)
    there = np.flatnonzero(ends[1:] > ends[:-1])
    low[there], high[there] = np.minimum.reduceat(points, ends[there]), np.maximum.reduceat(points, ends[there])
    halvings.bound(low, high)

    def meet(row: np.ndarray, tile: np.ndarray) -> None:
        order = np.argsort(tile, kind="stable")
        row, tile = row[order], tile[order]
        begin = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else tile
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(tile)], strict=True) if len(begin) else ():
            some = slice(ends[tile[b]], ends[tile[b] + 1])
            p, i = points[some], ids[some]
            for c in range(b, e, step := max(1, (1 << 20) // max(len(p), 1))):
                r = row[c : min(e, c + step)]
                q = queries[r]
                dx, dy, dz = (q[:, None, a] - p[None, :, a] for a in range(3))
                d2 = dx * dx + dy * dy + dz * dz
                d2[d2 > limit[r, None]] = np.inf
                if own is not None:
                    d2[own[r, None] == i] = np.inf
                found[r], names[r] = _best(np.concatenate([found[r], d2], 1), np.concatenate([names[r], np.broadcast_to(i, d2.shape)], 1), k)

    first = halvings.tile(queries)
    meet(np.arange(len(queries)), first)
    row, tile = halvings.reached(queries, np.minimum(limit, found[:, k - 1]))
    other = tile != first[row]
    meet(row[other], tile[other])
    return found, names


def _search(cell: list[str], k: int, other: bool, leaf: int):
    """One row for each query of a tile: its limit is the squared distance of the k-th neighbour that it has by now."""

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        xyz = lambda t: np.column_stack([t.column(a).to_numpy() for a in AXES]).astype(float)
        p = p.sort_by("pid")
        qid, pid, limit = q.column("qid").to_numpy(), p.column("pid").to_numpy(), q.column("limit").to_numpy()
        d2, ids = nearest_in(xyz(q), xyz(p), pid, k, limit, qid if other else None, leaf) if len(q) else (np.full((0, k), np.inf), np.zeros((0, k), np.int64))
        full = np.isfinite(d2)
        ends = pa.array(np.concatenate([[0], np.cumsum(full.sum(1))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[full])) for v in (ids, d2)]
        return pa.table([*(q.column(c) for c in (*cell, "qid", *AXES)), pa.array(np.minimum(limit, d2[:, k - 1])), *lists], names=[*cell, "qid", *AXES, "limit", "neighbours", "d2"])

    return run


def k_nearest(queries: DataFrame, points: DataFrame, k: int, by: list[str] | None = None, other: bool = False) -> DataFrame:
    """query row_id, rank, neighbour row_id and distance of the k nearest points. other: a point isn't its own neighbour. Ties go to the smaller row_id. Rows without finite coordinates take no part.

    Space is halved at medians of a sample into tiles; the sample decides on the borders only. A query meets the points of its own tile, then
    those of other tiles whose boxes of points are no farther than its k-th neighbour
    by then, so every query is done after two rounds, wherever it lies. A query that finds fewer than k in its tile meets all tiles.
    Queries are repeated, not points; a tile's points are copied only where very many queries are dealt over tasks.
    """
    by = by or []
    cell = [*by, "tile"]
    finite = lambda df: df.filter(" and ".join(f"abs({a}) < double('infinity')" for a in AXES))
    points, queries = finite(points), finite(queries)
    n = points.count()
    if not n:
        return queries.sparkSession.createDataFrame([], "query long, rank int, neighbour long, distance double")
    depth = min(MOST_HALVINGS, max(0, math.ceil(math.log2(n / min(TILE_POINTS, max(512, n // 64))))))
    some = points.select(*[F.col(a).cast("double").alias(a) for a in AXES]).sample(min(1.0, SAMPLE * 2**depth / n), 1).toArrow()  # 65,536 rows or so at most
    some = np.unique(np.column_stack([some.column(a).to_numpy() for a in AXES]), axis=0)
    halvings = Halvings(some, min(depth, max(0, int(math.log2(max(len(some), 1))))))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xyz = np.column_stack([b.column(b.schema.get_field_index(a)).to_numpy() for a in AXES])
            yield b.append_column("tile", pa.array(halvings.tile(xyz)))

    def other_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (v.slice(at, 1024) for v in batches for at in range(0, v.num_rows, 1024)):
            xyz = np.column_stack([b.column(b.schema.get_field_index(a)).to_numpy() for a in AXES])
            at = b.schema.get_field_index("tile")
            row, tile = halvings.reached(xyz, b.column("limit").to_numpy())
            new = tile != b.column(at).to_numpy()[row]
            yield b.take(pa.array(row[new])).set_column(at, "tile", pa.array(tile[new]))

    def with_tile(df: DataFrame, run=tiled) -> DataFrame:
        kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "tile")
        order = [c for c in df.columns if c != "tile"]
        return df.select(*order, *[c for c in ("tile",) if c in df.columns]).mapInArrow(run, f"{kinds}, tile long")

    numbers = [F.col(a).cast("double").alias(a) for a in AXES]
    # of coincident points the k + 1 least are enough; they are limited before the shuffle
    place = W.partitionBy(*by, *AXES).orderBy("pid")
    everything = points.select(*by, F.col("row_id").cast("long").alias("pid"), *numbers).withColumn("__k", F.row_number().over(place)).filter(F.col("__k") <= k + 1).drop("__k")
    everything = cut(with_tile(everything), "places")
    boxes = everything.groupBy("tile").agg(*[f(a).alias(f"{e}_{a}") for e, f in (("low", F.min), ("high", F.max)) for a in AXES]).collect()  # a row for each tile
    low, high = np.full((2**halvings.depth, 3), np.inf), np.full((2**halvings.depth, 3), -np.inf)
    for b in boxes:
        low[b["tile"]], high[b["tile"]] = [b[f"low_{a}"] for a in AXES], [b[f"high_{a}"] for a in AXES]
    halvings.bound(low, high)
    kinds = ", ".join(f"`{c}` {t}" for c, t in everything.select(*cell).dtypes)
    schema = f"{kinds}, qid long, x double, y double, z double, limit double, neighbours array<long>, d2 array<double>"

    def met(asked: DataFrame) -> DataFrame:
        p, on, hot = everything.select(*cell, "pid", *AXES), cell, hot_keys(asked, cell)
        if hot is not None:
            asked, p, on = dealt(asked, cell, hot), copied(p, cell, hot), [*cell, SALT]
        return asked.groupBy(*on).cogroup(p.groupBy(*on)).applyInArrow(_search(cell, k, other, PAIRS), schema)

    asked = with_tile(queries.select(*by, F.col("row_id").cast("long").alias("qid"), *numbers, F.lit(float("inf")).alias("limit")))
    found = cut(met(asked), "nearest")
    again = cut(with_tile(found.drop("neighbours", "d2"), other_tiles), "open-queries")
    both = found.select("qid", "neighbours", "d2").unionByName(cut(met(again), "nearest").select("qid", "neighbours", "d2"))
    return _nearest_of(both.select(F.col("qid").alias("query"), F.explode(F.arrays_zip("neighbours", "d2")).alias("n")).select("query", F.col("n.neighbours").alias("neighbour"), "n.d2"), k)


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def spacing_report(points: DataFrame) -> DataFrame:
    """One row about nearest other points: quantiles of distances and of those above zero, zeros, points beyond distinct places, and twice the median above zero as a radius."""
    near = cut(k_nearest(points, points, 1, other=True).select("distance"), "spacings")
    names = [f"q{int(100 * v):02d}" for v in QUANTILES]
    both = near.withColumn("kind", F.lit(0)).unionByName(near.filter("distance > 0").withColumn("kind", F.lit(1)))
    q = quantiles(both, "distance", QUANTILES, ["kind"])
    pick = lambda kind, k: F.max(F.when(F.col("kind") == kind, F.col("quantiles")[k]))
    wide = q.agg(*[pick(0, k).alias(n) for k, n in enumerate(names)], *[pick(1, k).alias(f"{n}_above_zero") for k, n in enumerate(names)], (2 * pick(1, 2)).alias("suggested_radius"))
    counts = near.agg(F.count("*").alias("points"), F.count_if(F.col("distance") == 0).alias("zeros"))
    places = points.select(*AXES).distinct().agg(F.count("*").alias("__places")).crossJoin(points.agg(F.count("*").alias("__all")))  # single rows
    out = counts.crossJoin(places).crossJoin(wide)  # single rows
    return out.select("points", *names, *[f"{n}_above_zero" for n in names], "zeros", (F.col("__all") - F.col("__places")).alias("duplicates"), "suggested_radius")


def sampled_spacing(points: DataFrame, most: int = 6000) -> DataFrame:
    """Median and ninetieth percentile of nearest distances, zeros included, and the share of zeros, for an even sample of queries against all points."""
    from cloudstrata.operators.regions import even_sample

    near = k_nearest(even_sample(points, most, ["row_id"]), points, 1, other=True)  # `most` rows at most
    return near.agg(F.median("distance").alias("median"), F.percentile("distance", 0.9).alias("p90"), F.avg((F.col("distance") == 0).cast("double")).alias("zero_fraction"))
