"""Approximate nearest neighbours by inner product: stable projections in kd-trees.

Largest inner products are nearest points once every vector has one more
coordinate that brings it to the greatest norm. Gaussian projections to PROJECTED
dimensions keep distances in distribution: the squared projected distance over
the squared distance is chi-square with PROJECTED degrees of freedom (Sun et al.
2014). A kd-tree over the projections of a bounded sample cuts their space into
regions of about BLOCK vectors; every vector goes to its region, once, where it
is in a leaf of the region's own kd-tree. A query takes leaves by increasing
projected distance and verifies their vectors by exact inner products, until
the chance that a vector as near as the k-th found would have come by now is at
least CONFIDENCE.

A query begins in its own region. With what it found there it goes on to the
nearest REGIONS others whose boxes pass the same test, and with the k-th of all
found so far to those that still pass. So a region's vectors travel once for
every CHUNK queries that come to it, and most regions are never met by most queries
where vectors have structure.

Equal vectors are indexed and asked once: of each the k + 1 least ids are enough,
so a vector that a third of all rows have is no burden. Every row is indexed.
Scores are double-precision inner products of the original vectors. Vectors that are
null or zero, have null, NaN or infinite components, or another dimension than
most (of equally common ones the smallest), take no part; nor does a null id. Rows with one vec_id
count once, with the least vector. Ties go to the smaller vec_id. Without
vectors or queries there are no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.joins import join_hot
from cloudstrata.session import cut

PROJECTED, CONFIDENCE, LEAF, BLOCK, CHUNK, SEED = 6, 0.8, 64, 32_768, 16_384, 5
#: Leaves that a query takes at a time; regions of its first step beyond its own; vectors that the regions are made from.
STEP, REGIONS, SAMPLE = 6, 4, 50_000


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The distribution function, for even degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, freedom // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def projection(dimension: int, projected: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    """Gaussian directions for vectors with their added coordinate."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dimension + 1, projected))


def lifted(x: np.ndarray, greatest: float) -> np.ndarray:
    """The added coordinate."""
    return np.sqrt(np.maximum(greatest**2 - (x * x).sum(1), 0))[:, None]


def _gaps(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared projected distances of points from boxes."""
    gap = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        v = p[:, d, None]
        gap += np.maximum(np.maximum(low[:, d] - v, v - high[:, d]), 0) ** 2
    return gap


class Regions:
    """A kd-tree over a sample of projections, with one region for each leaf. Points on a splitting plane are dealt to both sides by a hash."""

    def __init__(self, p: np.ndarray, count: int):
        self.axis, self.plane, self.left, self.right, self.leaf = [], [], [], [], []
        self.count = 0
        work = [(np.arange(len(p)), max(1, count), self._node())]
        while work:
            rows, n, at = work.pop()
            if n == 1 or len(rows) < 2:
                self.leaf[at] = self.count
                self.count += 1
                continue
            axis = int(np.ptp(p[rows], axis=0).argmax())
            by = rows[np.argsort(p[rows, axis], kind="stable")]
            cut_at = max(1, len(by) * (n // 2) // n)
            self.axis[at], self.plane[at] = axis, float(p[by[cut_at], axis])
            self.left[at], self.right[at] = self._node(), self._node()
            work += [(by[cut_at:], n - n // 2, self.right[at]), (by[:cut_at], n // 2, self.left[at])]

    def _node(self) -> int:
        for values, v in ((self.axis, 0), (self.plane, 0.0), (self.left, 0), (self.right, 0), (self.leaf, -1)):
            values.append(v)
        return len(self.leaf) - 1

    def of(self, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The region of each point."""
        axis, plane, left, right, leaf = map(np.array, (self.axis, self.plane, self.left, self.right, self.leaf))
        node, h = np.zeros(len(p), np.int64), ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        rows, level = np.arange(len(p)), 0
        while (inner := leaf[node] < 0).any():
            v, w = p[rows, axis[node]], plane[node]
            below = (v < w) | (v == w) & ((h >> np.uint64(level % 48)) & np.uint64(1) == 1)
            node = np.where(inner, np.where(below, left[node], right[node]), node)
            level += 1
        return leaf[node]


class ProjectedTree:
    """A kd-tree over projections: points in the order of its leaves, and the boxes of leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, greatest: float, directions: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        p = np.hstack([x, lifted(x, greatest)]) @ directions
        leaves, work = [], [np.arange(len(ids))]
        while work:
            rows = work.pop()
            if len(rows) <= leaf:
                leaves.append(np.sort(rows))
                continue
            span = np.ptp(p[rows], axis=0)
            by = rows[np.argsort(p[rows, int(span.argmax())], kind="stable")]  # ties stay in the order of ids
            work += [by[len(by) // 2 :], by[: len(by) // 2]]
        self.rows = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        sizes = np.array([len(v) for v in leaves], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, self.x, p = ids[self.rows], x[self.rows], p[self.rows]
        self.low = np.array([p[b:e].min(0) for b, e in zip(self.begin, self.begin[1:], strict=False)]).reshape(-1, directions.shape[1])
        self.high = np.array([p[b:e].max(0) for b, e in zip(self.begin, self.begin[1:], strict=False)]).reshape(-1, directions.shape[1])
        self.greatest, self.directions, self.verified = greatest, directions, 0

    def search(self, q: np.ndarray, k: int, confidence: float = CONFIDENCE, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (-inf for none) of the k best found for each query, and in self.verified how many vectors were verified. kth: scores of k-th ones known from elsewhere."""
        n, leaves, m = len(q), len(self.low), self.directions.shape[1]
        best_id, best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        self.verified = 0
        if not leaves or not n:
            return best_id, best
        known = np.full(n, -np.inf) if kth is None else kth
        gap = _gaps(self.low, self.high, q @ self.directions[:-1])  # a query has no added coordinate
        order = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, order, 1)
        square = (q * q).sum(1) + self.greatest**2
        active, at = np.arange(n), 0
        width = int(np.diff(self.begin).max())
        while at < leaves:
            bound = np.maximum(best[active, k - 1], known[active])
            distance = np.maximum(square[active] - 2 * bound, 1e-300)
            done = np.isfinite(bound) & (chi_square(gap[active, at] / distance, m) >= confidence)
            active = active[~done]
            if not len(active):
                break
            step = min(STEP, leaves - at)
            score = np.full((len(active), step * width), -np.inf)
            number = np.full((len(active), step * width), -1, np.int64)
            visit = order[active, at : at + step]
            flat = np.argsort(visit, axis=None, kind="stable")
            leaf, first = np.unique(visit.ravel()[flat], return_index=True)
            for l, places in zip(leaf.tolist(), np.split(flat, first[1:]), strict=True):
                b, e = int(self.begin[l]), int(self.begin[l + 1])
                row, column = places // step, places % step
                cells = column[:, None] * width + np.arange(e - b)
                score[row[:, None], cells] = q[active[row]] @ self.x[b:e].T
                number[row[:, None], cells] = self.ids[b:e]
                self.verified += len(places) * (e - b)
            best_id[active], best[active] = _top(np.hstack([best_id[active], number]), np.hstack([best[active], score]), k)
            at += step
        return best_id, best


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id, in order."""
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    kept, kept_id = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    tied = np.flatnonzero((scores >= kept.min(1)[:, None]).sum(1) > k)
    for r in tied:
        o = np.lexsort((ids[r], -scores[r]))[:k]
        kept[r], kept_id[r] = scores[r, o], ids[r, o]
    order = np.lexsort((kept_id, -kept), axis=1)
    return np.take_along_axis(kept_id, order, 1), np.take_along_axis(kept, order, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (array of doubles) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


_FOUND = "query_id long, vec_id long, score double, part long, low array<double>, high array<double>, verified long"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("part", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("verified", pa.int64())])


class _Index:
    """What every task needs to know: the directions, the greatest norm, how many to find and how surely."""

    def __init__(self, d: int, greatest: float, k: int, confidence: float):
        self.d, self.greatest, self.k, self.confidence, self.directions = d, greatest, k, confidence, projection(d)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, lifted(x, self.greatest)]) @ self.directions

    def placed(self, rows: DataFrame, regions: Regions) -> DataFrame:
        """part, asked, id and vector of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = regions.of(self.project(_matrix(batch.column(2), self.d)), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], names=["part", "asked", "id", "vector"])

        return rows.select("asked", "id", "vector").mapInArrow(run, "part long, asked boolean, id long, vector array<double>")

    def sampled(self, rows: DataFrame, total: int) -> np.ndarray:
        """Projections of about SAMPLE rows, those of the least hashes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(list(self.project(_matrix(batch.column(0), self.d))), pa.list_(pa.float64()))], names=["p"])

        if total > SAMPLE:
            rows = rows.filter(F.xxhash64("id", F.lit(SEED)) <= F.lit(-(1 << 63) + int((1 << 64) * SAMPLE / total)))
        found = sorted(tuple(r["p"]) for r in rows.select("vector").mapInArrow(run, "p array<double>").collect())
        return np.array(found).reshape(-1, self.directions.shape[1])

    def search(self, rows: DataFrame, by: list[str], boxes: bool) -> DataFrame:
        """_FOUND for groups of vectors (kth null) and queries (kth: a score known from elsewhere, -inf for none); a row without query tells of the group."""

        def run(table: pa.Table) -> pa.Table:
            kth = table.column("kth").to_numpy()
            asking = ~np.isnan(kth)
            ids, x = table.column("id").to_numpy(), _matrix(table.column("vector"), self.d)
            tree = ProjectedTree(ids[~asking], x[~asking], self.greatest, self.directions)
            best_id, best = tree.search(x[asking], self.k, self.confidence, kth[asking])
            good = np.isfinite(best)
            n = int(good.sum())
            none = [None] * n
            low, high = (tree.low.min(0).tolist(), tree.high.max(0).tolist()) if boxes and len(tree.ids) else (None, None)
            columns = [
                [*np.repeat(ids[asking], good.sum(1)).tolist(), None], [*best_id[good].tolist(), None], [*best[good].tolist(), None], [*none, table.column("part")[0].as_py()], [*none, low], [*none, high], [*none, tree.verified],
            ]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_ARROW.types, strict=True)], schema=_FOUND_ARROW)

        kth = rows.withColumn("kth", F.coalesce("kth", F.lit(float("nan"))))
        return kth.select(*by, "id", "vector", "kth").groupBy(*by).applyInArrow(run, _FOUND)

    def visits(self, queries: DataFrame, boxes: list, seen: int, most: int | None) -> DataFrame:
        """part, id, vector, kth of the regions that queries (own, id, vector, kth) have to meet: of the others by increasing distance those after the first `seen`, at most `most`."""
        parts = np.array([b["part"] for b in boxes], np.int64)
        low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
        m = self.directions.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    q, kth = _matrix(some.column(2), self.d), some.column(3).to_numpy()
                    gap = _gaps(low, high, q @ self.directions[:-1])
                    gap[parts[None, :] == some.column(0).to_numpy()[:, None]] = np.inf
                    order = np.argsort(gap, axis=1, kind="stable")[:, seen : None if most is None else seen + most]
                    distance = np.maximum((q * q).sum(1) + self.greatest**2 - 2 * kth, 1e-300)
                    near = np.take_along_axis(gap, order, 1)
                    row, column = np.nonzero(np.isfinite(near) & (~np.isfinite(kth)[:, None] | (chi_square(near / distance[:, None], m) < self.confidence)))
                    yield pa.RecordBatch.from_arrays([pa.array(parts[order[row, column]]), *(some.column(c).take(pa.array(row)) for c in (1, 2, 3))], names=["part", "id", "vector", "kth"])

        return queries.select("own", "id", "vector", "kth").mapInArrow(run, "part long, id long, vector array<double>, kth double")

    def best(self, found: DataFrame) -> DataFrame:
        """The k best of each query."""
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.filter("query_id is not null").withColumn("rank", rank).filter(F.col("rank") <= self.k).select("query_id", "vec_id", "score")


def _search(rows: DataFrame, total: int, index: _Index, block: int) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, score of the k best found among the rows (id, vector, asked) for those that are asked, themselves included; and what the tasks tell of their work."""
    spark = rows.sparkSession
    blocks = math.ceil(total / block)
    regions = Regions(index.sampled(rows, total) if blocks > 1 else np.zeros((0, index.directions.shape[1])), blocks)
    data = cut(index.placed(rows, regions), "ann-placed")
    none = F.lit(None).cast("double").alias("kth")
    asked = data.filter("asked").select("part", "id", "vector", F.lit(float("-inf")).alias("kth"))
    found = cut(index.search(data.select("part", "id", "vector", none).unionByName(asked), ["part"], True), "ann-found")
    boxes = found.filter("low is not null").select("part", "low", "high").orderBy("part").collect()  # a row for each region
    seen = 0
    while len(boxes) > 1 + seen:
        most = REGIONS if len(boxes) > 1 + 2 * REGIONS and not seen else None
        kth = index.best(found).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == index.k, F.min("score")).otherwise(float("-inf")).alias("kth"))
        queries = data.filter("asked").select(F.col("part").alias("own"), "id", "vector").join(kth, "id")
        visits = cut(index.visits(queries, boxes, seen, most), "ann-visits")
        counts = [(r["part"], -(-r["count"] // CHUNK)) for r in visits.groupBy("part").count().collect()]  # a row for each region
        if counts:
            salts = spark.createDataFrame(counts, "part long, salts long")
            one = data.select("part", "id", "vector", none).join(salts, "part").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
            two = visits.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
            found = found.unionByName(cut(index.search(one.unionByName(two).drop("salts"), ["part", "salt"], False), "ann-found"))
        if most is None:
            break
        seen += most
    return index.best(found), found.filter("query_id is null")


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row for which is_query (over column id) holds."""
    rows = cut(usable(vectors, id_col, vector_col), "vectors")
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).orderBy(F.desc("n"), "d").first()
    if shapes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == shapes["d"])
    name = {n: F.xxhash64(F.lit(j), "vector") for j, n in enumerate(("v1", "v2"))}
    named = rows.withColumns(name)
    twins = cut(named.groupBy(*name).agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "ann-twins")
    index = _Index(shapes["d"], shapes["norm"], k + 1, confidence)
    asked = F.coalesce(is_query, F.lit(False))
    if not twins.limit(1).count():
        best, _ = _search(rows.withColumn("asked", asked), shapes["n"], index, block)
        found, queries = best.withColumnRenamed("query_id", "rep"), None
    else:
        tagged = cut(join_hot(named, twins, [*name], "left").select("id", "vector", F.coalesce("rep", "id").alias("rep")), "ann-tagged")
        queries = cut(tagged.filter(asked).select(F.col("id").alias("query_id"), "rep"), "ann-queries")
        wanted = queries.select(F.col("rep").alias("id")).distinct().withColumn("asked", F.lit(True))
        single = cut(tagged.filter("id = rep").select("id", "vector").join(wanted, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "ann-single")
        best, _ = _search(single, single.count(), index, block)
        # of equal vectors the least ids, limited before the shuffle
        ids = join_hot(tagged.select("id", "rep"), twins.select("rep"), ["rep"], "left_semi")
        ids = ids.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1).select(F.col("rep").alias("vec_id"), F.col("id").alias("twin"))
        found = best.withColumnRenamed("query_id", "rep").join(ids, "vec_id", "left").select("rep", F.coalesce("twin", "vec_id").alias("vec_id"), "score")
        found = found.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("near")  # k + 1 at most
    tops = found.groupBy("rep").agg(ordered)
    asking = tops.withColumn("query_id", F.col("rep")) if queries is None else join_hot(queries, tops, ["rep"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
