"""Queries over point views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import COORDINATES, MIXERS, SHIFTS, content_key, spatial_hash
from cloudstrata.operators import clusters, ground, neighbours, profile, regions, render, shape
from cloudstrata.plans.registry import query, table
from cloudstrata.session import cut
from cloudstrata.views import EVENT_POINTS_SQL as PTS
from cloudstrata.views import event_points

AXES = profile.AXES
CELL, TOLERANCE = (24.0, 10.0), 25.0
ROI = {"x": (100.0, 400.0), "y": (0.0, 60.0), "z": (5.0, 60.0)}
EPS, MIN_SAMPLES = 8.03, 4
RADIUS = 9.07


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS DOUBLE) AS value FROM pts" for d in (*AXES, "user_id"))


@query(f"""WITH {PTS}, u AS ({_DIMS})
SELECT dimension, count(value) > 0 AS available, count(value) AS "count", round(min(value), 6) AS "min", round(max(value), 6) AS "max", round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS standard_deviation, {", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in profile.PERCENTILES.items())} FROM u GROUP BY dimension""")
def point_profile(spark, sf_dir):
    return rounded(profile.statistics(points(spark, sf_dir), [*AXES, "user_id"]))


@query("""SELECT 'event_type' AS dimension, event_type AS "value", count(*) AS "count" FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def category_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), ["event_type"])


@query("""SELECT l_returnflag || ' x ' || l_linestatus AS "key", count(*) AS "count" FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def cross_tab(spark, sf_dir):
    return profile.cross_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


_BOX = ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in AXES)
_EXT = {a: f"greatest(CAST(0 AS DOUBLE), least(l.max_{a}, r.max_{a}) - greatest(l.min_{a}, r.min_{a}))" for a in AXES}


def _density(s: str) -> str:
    v = " * ".join(f"({s}.max_{a} - {s}.min_{a})" for a in AXES)
    return f"CASE WHEN {v} > 0 THEN round({s}.points / ({v}), 6) END"


@query(f"""WITH {PTS}, b AS (SELECT side, count(*) AS points, {_BOX} FROM pts GROUP BY side)
SELECT l.points AS left_points, r.points AS right_points, {", ".join(f"round({e}, 6) AS extent_{a}" for a, e in _EXT.items())}, round({" * ".join(_EXT.values())}, 3) AS volume,
  {_density("l")} AS left_density, {_density("r")} AS right_density FROM b l, b r WHERE l.side = 'left' AND r.side = 'right'""")
def side_comparison(spark, sf_dir):
    return rounded(profile.compare_sides(points(spark, sf_dir))).withColumn("volume", F.round("volume", 3))


@query(f"""WITH {PTS}, b AS (SELECT side, {_BOX} FROM pts GROUP BY side), s AS (SELECT {", ".join(f"max(min_{a}) AS low_{a}, min(max_{a}) AS high_{a}" for a in AXES)} FROM b)
{" UNION ALL ".join(f"SELECT '{a}' AS axis, low_{a} AS low, high_{a} AS high, low_{a} >= high_{a} AS empty FROM s" for a in AXES)}""")
def shared_roi(spark, sf_dir):
    return profile.shared_region(points(spark, sf_dir))


def _between(b: dict) -> str:
    return " AND ".join(f"{a} BETWEEN CAST({lo} AS DOUBLE) AND CAST({hi} AS DOUBLE)" for a, (lo, hi) in b.items())


@query(f"WITH {PTS} SELECT row_id, side, x, y, z FROM pts WHERE {_between(ROI)}")
def roi_points(spark, sf_dir):
    return points(spark, sf_dir).filter(regions.inside(ROI)).select("row_id", "side", *AXES)


@query(f"""WITH {PTS} SELECT row_id, side, x, y, {_between({"x": (100, 400), "y": (10, 60)})} AS core FROM pts WHERE {_between({"x": (90, 410), "y": (0, 70)})}""")
def padded_region(spark, sf_dir):
    return regions.region(points(spark, sf_dir), (100, 400), (10, 60), 10).select("row_id", "side", "x", "y", "core")


@query(f"WITH {PTS} SELECT row_id, x, y, z FROM pts WHERE {_between(ROI)} AND abs(y - 30) <= 5")
def elevation_slice(spark, sf_dir):
    return regions.elevation_slice(points(spark, sf_dir).filter(regions.inside(ROI)), "y", 30, 10).select("row_id", *AXES)


def _wide(c: str) -> str:
    return f"CAST(CASE WHEN {c} < 0 THEN 18446744073709551616::HUGEINT + {c} ELSE {c} END AS UBIGINT)"


def _product(a: str, f: int) -> str:
    return f"CAST((({a})::UHUGEINT * {f}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


_H = f"""h0 AS (SELECT *, xor(xor(xor({_product(_wide("raw_x"), COORDINATES[0])}, {_product(_wide("raw_y"), COORDINATES[1])}), {_product(_wide("raw_z"), COORDINATES[2])}),
  CAST(CASE WHEN side = 'left' THEN 101 ELSE 202 END AS UBIGINT)) AS h FROM pts),
h1 AS (SELECT * EXCLUDE h, {_product(f"xor(h, h >> {SHIFTS[0]})", MIXERS[0])} AS h FROM h0), h2 AS (SELECT * EXCLUDE h, {_product(f"xor(h, h >> {SHIFTS[1]})", MIXERS[1])} AS h FROM h1),
h3 AS (SELECT * EXCLUDE h, xor(h, h >> {SHIFTS[2]}) AS h FROM h2)"""


@query(f"WITH {PTS}, {_H} SELECT row_id, side, CAST(CASE WHEN h > 9223372036854775807 THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS score FROM h3")
def spatial_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    each = [spatial_hash(p.filter(F.col("side") == s), seed) for s, seed in regions.SIDE_SEEDS.items()]
    return each[0].unionByName(each[1]).select("row_id", "side", "score")


@query(f"WITH {PTS}, {_H} SELECT row_id, side, raw_x, raw_y, raw_z FROM h3 WHERE h <= 4611686018427387904::UBIGINT")
def hash_sample(spark, sf_dir):
    p = points(spark, sf_dir)
    each = [regions.hash_sample(p.filter(F.col("side") == s), 1, 4, seed) for s, seed in regions.SIDE_SEEDS.items()]
    return each[0].unionByName(each[1]).select("row_id", "side", "raw_x", "raw_y", "raw_z")


_GROUND = f"""{PTS}, g AS (SELECT *, CAST(floor(x / 24.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 10.0::DOUBLE) AS BIGINT) AS cy FROM pts),
s AS (SELECT *, z - min(z) OVER (PARTITION BY side, cx, cy) <= 25.0::DOUBLE AS ground FROM g)"""


def _split(spark, sf_dir):
    return ground.ground_by_cell(points(spark, sf_dir), CELL, TOLERANCE, ["side"])


@query(f"WITH {_GROUND} SELECT row_id, side, cx, cy, ground FROM s")
def ground_baseline(spark, sf_dir):
    return _split(spark, sf_dir).select("row_id", "side", "cx", "cy", "ground")


@query(f"""WITH {_GROUND} SELECT side, count(DISTINCT (cx, cy)) AS cells, count(*) AS points, count(*) FILTER (ground) AS ground_points, count(*) FILTER (NOT ground) AS other_points,
round(count(*) FILTER (ground) / count(*), 6) AS ground_fraction FROM s GROUP BY side""")
def ground_stats(spark, sf_dir):
    return rounded(ground.ground_summary(_split(spark, sf_dir), ["side"]))


@query(f"""WITH {_GROUND}, c AS (SELECT *, {_between({"x": (100, 400), "y": (10, 60)})} AS core FROM s) SELECT side, {", ".join(f"count(*) FILTER ({a} AND {b}) AS {n}" for n, a, b in (("core_ground", "core", "ground"), ("core_other", "core", "NOT ground"), ("context_ground", "NOT core", "ground"), ("context_other", "NOT core", "NOT ground")))} FROM c GROUP BY side""")
def partition_counts(spark, sf_dir):
    return ground.partition_counts(_split(spark, sf_dir).withColumn("core", regions.inside({"x": (100, 400), "y": (10, 60)})), ["side"])


@query()
def ground_cloth(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "side", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), (F.col("z") / 10).alias("z"))
    return ground.ground_by_cloth_tiles(p, ["side"], iterations=200).select("row_id", "side", "ground")


@query(f"""WITH {PTS}, v AS (SELECT *, row_number() OVER (PARTITION BY side, floor(x / 20.0::DOUBLE), floor(y / 20.0::DOUBLE), floor(z / 20.0::DOUBLE) ORDER BY row_id) AS k FROM pts)
SELECT row_id, side, x, y, z FROM v WHERE k = 1""")
def voxel_first(spark, sf_dir):
    return regions.first_of_voxels(points(spark, sf_dir), 20, by=["side"]).select("row_id", "side", *AXES)


@query(f"""WITH {PTS}, o AS (SELECT side, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts GROUP BY side), v AS (SELECT p.*, row_number() OVER
(PARTITION BY p.side, floor((x - ox) / 15.0::DOUBLE), floor((y - oy) / 15.0::DOUBLE), floor((z - oz) / 15.0::DOUBLE) ORDER BY row_id) AS k FROM pts p JOIN o ON p.side = o.side)
SELECT row_id, side, x, y, z FROM v WHERE k = 1""")
def voxel_anchored(spark, sf_dir):
    return regions.first_of_voxels(points(spark, sf_dir), 15, "least", ["side"]).select("row_id", "side", *AXES)


_EVEN = """n AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY row_id) - 1 AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {of}),
w AS (SELECT {by}, k, n, CASE WHEN k = {m} - 1 THEN n - 1 ELSE CAST(floor(k * (CAST(n - 1 AS DOUBLE) / CAST({m} - 1 AS DOUBLE))) AS BIGINT) END AS place FROM (SELECT DISTINCT {by}, n FROM n), generate_series(0, {m} - 1) t(k))"""


@query(f"""WITH {PTS}, {_EVEN.format(by="side", of="pts", m=300)} SELECT row_id, side, x, y FROM n WHERE n <= 300 OR EXISTS (SELECT 1 FROM w WHERE w.side = n.side AND w.place = n.rn)""")
def display_sample(spark, sf_dir):
    return regions.even_sample(points(spark, sf_dir), 300, ["row_id"], ["side"]).select("row_id", "side", "x", "y")


@query(f"""WITH {PTS}, f AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY row_id) AS first, 1 AS one FROM pts), rest AS (SELECT * FROM f WHERE first > 1),
{_EVEN.format(by="one", of="rest", m="(100 - (SELECT count(DISTINCT classification) FROM pts))")}
SELECT row_id, classification FROM f WHERE first = 1 UNION ALL SELECT row_id, classification FROM n WHERE rn IN (SELECT place FROM w)""")
def cluster_representatives(spark, sf_dir):
    return regions.representatives(points(spark, sf_dir), "classification", 100, "row_id").select("row_id", "classification")


_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


_Q = {f"q{int(100 * v):02d}": v for v in neighbours.QUANTILES}
_NN = f"nn AS (SELECT a.row_id, sqrt(min({_D2})) AS d FROM pts a JOIN pts b ON a.row_id <> b.row_id GROUP BY a.row_id)"


def _close(radius: float) -> str:
    """Pairs a, b of points of a side at most a radius apart, met in cells of x."""
    return f"""(SELECT *, CAST(floor(x / {radius}) AS BIGINT) + d AS cell FROM pts, generate_series(-1, 1) t(d)) a JOIN pts b ON a.side = b.side AND CAST(floor(b.x / {radius}) AS BIGINT) = a.cell
AND abs(a.y - b.y) <= {radius} AND abs(a.z - b.z) <= {radius} AND {_D2} <= CAST({radius} AS DOUBLE) * CAST({radius} AS DOUBLE)"""


@query(f"""WITH {PTS}, {_NN} SELECT count(*) AS points, {", ".join(f"round(quantile_cont(d, {p}), 6) AS {n}" for n, p in _Q.items())},
{", ".join(f"round(quantile_cont(d, {p}) FILTER (d > 0), 6) AS {n}_above_zero" for n, p in _Q.items())}, count(*) FILTER (d = 0) AS zeros,
(SELECT count(*) - count(DISTINCT (x, y, z)) FROM pts) AS duplicates, round(2 * quantile_cont(d, 0.5) FILTER (d > 0), 6) AS suggested_radius FROM nn""")
def nn_spacing(spark, sf_dir):
    return rounded(neighbours.spacing_report(points(spark, sf_dir)))


@query(f"""WITH {PTS}, one AS (SELECT *, 1 AS one FROM pts), {_EVEN.format(by="one", of="one", m=200)}, q AS (SELECT * FROM n WHERE n <= 200 OR rn IN (SELECT place FROM w)),
nn AS (SELECT a.row_id, sqrt(min({_D2})) AS d FROM q a JOIN pts b ON a.row_id <> b.row_id GROUP BY a.row_id)
SELECT round(median(d), 6) AS "median", round(quantile_cont(d, 0.9), 6) AS p90, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction FROM nn""")
def nn_spacing_sampled(spark, sf_dir):
    return rounded(neighbours.sampled_spacing(points(spark, sf_dir), 200))


@query(f"""WITH {PTS}, r AS (SELECT a.row_id AS query, b.row_id AS neighbour, {_D2} AS d2 FROM (SELECT * FROM pts WHERE row_id % 100 = 0) a JOIN pts b ON a.row_id <> b.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS "rank" FROM r) SELECT query, CAST("rank" AS INTEGER) AS "rank", neighbour, round(sqrt(d2), 6) AS distance FROM k WHERE "rank" <= 3""")
def k_nearest(spark, sf_dir):
    """The stated set of queries, rows whose id is divisible by 100, against all points."""
    p = points(spark, sf_dir)
    return rounded(neighbours.k_nearest(p.filter("row_id % 100 = 0"), p, 3, other=True))


@query(f"""WITH {PTS} SELECT a.row_id AS row_id, count(*) AS neighbours, round(sum(sqrt({_D2})), 6) AS total_distance FROM {_close(RADIUS)} GROUP BY a.row_id""")
def radius_neighbors(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "side", *AXES)
    pairs = neighbours.radius_join(p, neighbours.nodes(p, ["side"]), RADIUS, ["side"])
    weight = F.col("p.weight")
    return rounded(pairs.groupBy(F.col("q.row_id").alias("row_id")).agg(F.sum(weight).alias("neighbours"), F.sum(weight * F.sqrt("d2")).alias("total_distance")))


_DB = f"""{PTS}, e AS (SELECT a.row_id AS i, b.row_id AS j FROM pts a JOIN pts b ON floor(b.x / 8.03) BETWEEN floor(a.x / 8.03) - 1 AND floor(a.x / 8.03) + 1 AND abs(a.x - b.x) <= {EPS}
AND abs(a.y - b.y) <= {EPS} AND abs(a.z - b.z) <= {EPS} AND {_D2} <= CAST({EPS} AS DOUBLE) * CAST({EPS} AS DOUBLE)),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= {MIN_SAMPLES}), ce AS (SELECT i, j FROM e WHERE i IN (FROM core) AND j IN (FROM core)),
reach AS (WITH RECURSIVE t(i, j) AS (SELECT i, j FROM ce UNION SELECT t.i, ce.j FROM t JOIN ce ON t.j = ce.i) SELECT i, min(j) AS root FROM t GROUP BY i),
lab AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM reach), bord AS (SELECT e.i, min(lab.label) AS label FROM e JOIN lab ON e.j = lab.i GROUP BY e.i),
db AS (SELECT p.*, lab.i IS NOT NULL AS core, CAST(coalesce(lab.label, bord.label, -1) AS INTEGER) AS label FROM pts p LEFT JOIN lab ON lab.i = p.row_id LEFT JOIN bord ON bord.i = p.row_id)"""


@query(f"WITH {_DB} SELECT row_id, core, label FROM db")
def dbscan_labels(spark, sf_dir):
    return clusters.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES).select("row_id", "core", "label")


_KEY = content_key({"eps": EPS, "min_samples": MIN_SAMPLES})
_TAB = f"""{_DB}, t AS (SELECT label, count(*) AS point_count, {_BOX} FROM db WHERE label >= 0 GROUP BY label), n AS (SELECT *, point_count < 8 AS tiny,
row_number() OVER (PARTITION BY point_count < 8 ORDER BY point_count DESC, label) - 1 AS k FROM t), ct AS (SELECT '{_KEY[:16]}' || '_' || lpad(CAST(label AS VARCHAR), 5, '0') AS candidate_id, label, point_count,
{", ".join(f"{m}_{a}" for m in ("min", "max") for a in AXES)}, {", ".join(f"max_{a} - min_{a} AS extent_{a}" for a in AXES)}, min_x - 0 <= {EPS} OR 720 - max_x <= {EPS} OR min_y - 0 <= {EPS} OR 150 - max_y <= {EPS} AS touches_region_boundary,
CASE WHEN tiny THEN 'below_min_cluster_points' WHEN k < 8 THEN 'in_review_batch' ELSE 'outside_review_batch' END AS status, CAST(CASE WHEN NOT tiny AND k < 8 THEN k END AS INTEGER) AS candidate_index FROM n)"""


def _clustered(spark, sf_dir):
    labelled = cut(clusters.dbscan(points(spark, sf_dir).select("row_id", *AXES), EPS, MIN_SAMPLES).select("label", *AXES), "labelled")  # read twice
    return labelled, clusters.cluster_table(labelled, 8, 8, (0.0, 720.0, 0.0, 150.0), EPS, _KEY)


@query(f"WITH {_TAB} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in [f'{m}_{a}' for m in ('min', 'max', 'extent') for a in AXES])}) FROM ct")
def cluster_table(spark, sf_dir):
    return rounded(_clustered(spark, sf_dir)[1])


@query(f"""WITH {_TAB} SELECT (SELECT count(*) FROM db) AS points, (SELECT count(*) FROM db WHERE label < 0) AS noise_points, coalesce(sum(point_count) FILTER (status = 'below_min_cluster_points'), 0)::BIGINT AS rejected_points,
coalesce(sum(point_count) FILTER (status <> 'below_min_cluster_points'), 0)::BIGINT AS kept_points, count(*) AS clusters, count(*) FILTER (status <> 'below_min_cluster_points') AS kept_clusters, count(*) FILTER (status = 'in_review_batch') AS batch_clusters FROM ct""")
def cluster_summary(spark, sf_dir):
    return clusters.cluster_summary(*_clustered(spark, sf_dir))


def eigen_sql(source: str, by: str) -> str:
    """CTEs f (features) over a table with x, y, z, grouped: a twin of shape_features."""
    cov = ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))
    ext = ", ".join(f"max({a}) - min({a}) AS extent_{a}" for a in AXES)
    det = "((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz))"

    def vz(lam: str) -> str:
        m = [(f"(cxx - {lam})", "cxy", "cxz"), ("cxy", f"(cyy - {lam})", "cyz"), ("cxz", "cyz", f"(czz - {lam})")]
        out = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            a, b = m[i], m[j]
            x, y, z = f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"
            out.append(f"{{'n': {x} * {x} + {y} * {y} + {z} * {z}, 'z': abs({z})}}")
        return f"list_max([{', '.join(out)}])"

    return f"""c AS (SELECT {by}, count(*) AS n, {cov}, {ext} FROM {source} GROUP BY {by}), m AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM c),
m2 AS (SELECT *, sqrt((pow(cxx - q, 2) + pow(cyy - q, 2) + pow(czz - q, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM m),
m3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {det} / (2 * p * p * p)))) / 3 END AS t FROM m2),
m4 AS (SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(t) ELSE q END AS r1, CASE WHEN p > 0 THEN q + 2 * p * cos(t + 2 * pi() / 3) ELSE q END AS r3 FROM m3),
m5 AS (SELECT *, greatest(r1, 0) AS l1, greatest(3 * q - r1 - r3, 0) AS l2, greatest(r3, 0) AS l3 FROM m4),
m6 AS (SELECT *, {vz("l1")} AS w1, {vz("l3")} AS w3, CASE WHEN n < 6 THEN 'insufficient_neighbors' WHEN l1 <= 1e-20 THEN 'zero_variance' ELSE 'valid' END AS status FROM m5),
m7 AS (SELECT *, CASE WHEN status = 'valid' THEN (l1 - l2) / l1 END AS linearity, CASE WHEN status = 'valid' THEN (l2 - l3) / l1 END AS planarity, CASE WHEN status = 'valid' THEN l3 / l1 END AS scattering FROM m6),
f AS (SELECT *, CASE WHEN linearity > 1e-6 AND w1.n > 0 THEN least(1.0::DOUBLE, w1.z / sqrt(w1.n)) END AS axis_alignment, CASE WHEN planarity > 1e-6 AND w3.n > 0 THEN least(1.0::DOUBLE, w3.z / sqrt(w3.n)) END AS normal_alignment FROM m7)"""


_SHAPE = ["l1", "l2", "l3", "linearity", "planarity", "scattering", "axis_alignment", "normal_alignment"]


@query(f"""WITH {PTS}, {eigen_sql("pts", "side, classification")} SELECT side, classification, n AS "count", status, {", ".join(f"round({c}, 6) AS {c}" for c in ["cxx", "cxy", "czz", *_SHAPE])}, round(1 - normal_alignment, 6) AS surface_verticality,
{", ".join(f"round(extent_{a}, 6) AS extent_{a}" for a in AXES)} FROM f""")
def pca_global(spark, sf_dir):
    out = shape.shape_features(points(spark, sf_dir), ["side", "classification"])
    return rounded(out.select("side", "classification", "count", "status", "cxx", "cxy", "czz", *_SHAPE, "surface_verticality", *[f"extent_{a}" for a in AXES]))


_NEAR = f"""{PTS}, nb AS (SELECT a.row_id AS row_id, b.x, b.y, b.z FROM {_close(21.7)}), {eigen_sql("nb", "row_id")}"""


def _local(spark, sf_dir):
    p = points(spark, sf_dir)
    return shape.local_features(p, p, 21.7, ["side"])


@query(f"""WITH {_NEAR} SELECT row_id, n AS "count", status, round(linearity, 5) AS linearity, round(planarity, 5) AS planarity, round(scattering, 5) AS scattering FROM f""")
def pca_local(spark, sf_dir):
    return rounded(_local(spark, sf_dir).select("row_id", "count", "status", "linearity", "planarity", "scattering"), 5)


@query(f"""WITH {_NEAR} SELECT count(*) AS queries, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'insufficient_neighbors') AS insufficient_neighbors, count(*) FILTER (status = 'zero_variance') AS zero_variance,
quantile_cont(n, 0.5) AS median_neighbours, count(linearity) FILTER (status = 'valid') AS linearity_defined, round(quantile_cont(linearity, 0.5), 5) AS median_linearity,
round(count(*) FILTER (linearity >= 0.6) / nullif(count(*) FILTER (status = 'valid'), 0), 6) AS linear_share, round(count(*) FILTER (planarity >= 0.6) / nullif(count(*) FILTER (status = 'valid'), 0), 6) AS planar_share,
round(count(*) FILTER (scattering >= 0.25) / nullif(count(*) FILTER (status = 'valid'), 0), 6) AS scattered_share FROM f""")
def pca_local_summary(spark, sf_dir):
    s = shape.summarise_local(_local(spark, sf_dir).withColumn("all", F.lit(1)), ["all"])
    return s.select(
        "queries", "valid", "insufficient_neighbors", "zero_variance", F.col("neighbour_quantiles")[1].alias("median_neighbours"), "linearity_defined", F.round(F.col("linearity_quantiles")[1], 5).alias("median_linearity"),
        *[F.round(f"{k}_share", 6).alias(f"{k}_share") for k in ("linear", "planar", "scattered")],
    )


@query(f"""WITH {PTS}, {eigen_sql("pts", "side, user_id")} SELECT side, round(linearity, 6) AS linearity, round(row_number() OVER (PARTITION BY side ORDER BY linearity) / count(*) OVER (PARTITION BY side), 6) AS fraction FROM f WHERE linearity IS NOT NULL""")
def linearity_ecdf(spark, sf_dir):
    return rounded(shape.ecdf(shape.shape_features(points(spark, sf_dir), ["side", "user_id"]), "linearity", ["side"]))


_BOXES = [("a", {"x": (50.0, 120.0), "y": (0.0, 50.0), "z": (0.0, 80.0)}), ("b", {"x": (100.0, 300.0), "y": (20.0, 90.0), "z": (10.0, 40.0)}), ("c", {"x": (500.0, 700.0), "y": (0.0, 12.0), "z": (0.0, 500.0)})]


@query(f"WITH {PTS} " + " UNION ALL ".join(f"SELECT '{n}' AS box, row_id, x, y, z FROM pts WHERE {_between({a: (lo - 5, hi + 5) if a != 'z' else (lo, hi) for a, (lo, hi) in b.items()})}" for n, b in _BOXES))
def box_scan(spark, sf_dir):
    return regions.box_points(points(spark, sf_dir), _BOXES, 5.0).select("box", "row_id", *AXES)


@query(f"""WITH {PTS}, dense AS (SELECT *, CAST(user_id % 7 AS INTEGER) AS label FROM pts WHERE side = 'left'), seeds AS (SELECT * FROM pts WHERE side = 'right'),
nn AS (SELECT a.row_id, arg_min(b.label, ({_D2}, b.row_id)) AS label, sqrt(min({_D2})) AS d FROM seeds a, dense b GROUP BY a.row_id), s AS (SELECT label, count(*) AS support FROM nn WHERE d <= 12.07 GROUP BY label),
o AS (SELECT d.label, count(*) AS points, coalesce(max(support), 0) AS support FROM dense d LEFT JOIN s ON s.label = d.label GROUP BY d.label)
SELECT label, points, support, CAST(row_number() OVER (ORDER BY support DESC, points DESC, label) AS INTEGER) AS place FROM o""")
def seed_support(spark, sf_dir):
    p = points(spark, sf_dir)
    dense = p.filter("side = 'left'").withColumn("label", (F.col("user_id") % 7).cast("int"))
    return clusters.seed_support(dense, p.filter("side = 'right'"), 12.07)


@query()
def dense_regrouping(spark, sf_dir):
    p = points(spark, sf_dir)
    return clusters.regroup_dense(p.filter("side = 'left'"), p.filter("side = 'right'"), 6.01, 3, 12.07)[1]


@query(f"""WITH {PTS}, b AS (SELECT side, {_BOX} FROM pts GROUP BY side) SELECT side, {", ".join(f"round(min_{a} - greatest(0.05::DOUBLE, 0.07::DOUBLE * (max_{a} - min_{a})), 6) AS low_{a}, round(max_{a} + greatest(0.05::DOUBLE, 0.07::DOUBLE * (max_{a} - min_{a})), 6) AS high_{a}" for a in AXES)} FROM b""")
def axis_limits(spark, sf_dir):
    return rounded(regions.axis_limits(points(spark, sf_dir), ["side"], 0.07, 0.05))


_SIZE, _RAD, _PAD = 128, 2, 0.05


def _drawn(spark, sf_dir):
    rows = render.projected(points(spark, sf_dir).select("row_id", *AXES))
    return render.pixels(rows, render.frame(rows, _SIZE, _RAD, _PAD), _SIZE, _RAD)


def _terms(b: tuple) -> str:
    return " + ".join(f"{a} * CAST({c!r} AS DOUBLE)" for a, c in zip(AXES, b, strict=True))


_PIX = f"""{PTS}, pr AS ({" UNION ALL ".join(f"SELECT row_id, '{n}' AS view, {', '.join(f'{_terms(b)} AS {k}' for k, b in zip(('u', 'v', 'depth'), render.camera_basis(*v), strict=True))} FROM pts" for n, v in render.VIEWS.items())}),
fr AS (SELECT view, (min(u) + max(u)) / 2 AS cu, (min(v) + max(v)) / 2 AS cv, CAST({(_SIZE - 1 - 2 * _RAD) * (1 - 2 * _PAD)!r} AS DOUBLE) / greatest(max(u) - min(u), max(v) - min(v), 1e-9::DOUBLE) AS scale FROM pr GROUP BY view),
pp AS (SELECT pr.view, row_id, depth, CAST(round_even((u - cu) * scale + 63.5::DOUBLE, 0) AS INTEGER) AS px0, CAST(round_even(-(v - cv) * scale + 63.5::DOUBLE, 0) AS INTEGER) AS py0 FROM pr JOIN fr ON pr.view = fr.view),
ds AS (SELECT dx, dy FROM generate_series(-2, 2) a(dx), generate_series(-2, 2) b(dy) WHERE dx * dx + dy * dy <= 4),
px AS (SELECT view, CAST(py0 + dy AS INTEGER) AS py, CAST(px0 + dx AS INTEGER) AS px, arg_max(row_id, (depth, row_id)) AS row_id FROM pp, ds WHERE px0 + dx BETWEEN 0 AND 127 AND py0 + dy BETWEEN 0 AND 127 GROUP BY ALL)"""


@query(f"WITH {_PIX} SELECT view, py, px, row_id FROM px")
def pixel_zbuffer(spark, sf_dir):
    return _drawn(spark, sf_dir)


@query(f"WITH {_PIX} SELECT view, count(*) AS occupied_pixels, round(100.0 * count(*) / 16384, 6) AS occupied_percent, count(DISTINCT row_id) AS visible_points FROM px GROUP BY view")
def render_metrics(spark, sf_dir):
    return rounded(render.render_metrics(_drawn(spark, sf_dir), _SIZE))


@query(f"WITH {PTS} SELECT row_id, CAST(round_even(least(1.0::DOUBLE, z / 500.0::DOUBLE) * 255, 0) AS INTEGER) AS grey FROM pts")
def grey_levels(spark, sf_dir):
    return points(spark, sf_dir).select("row_id", render.eight_bit(F.least(F.lit(1.0), F.col("z") / 500.0)).alias("grey"))
