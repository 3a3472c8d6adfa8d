"""Queries over LAS files, saved runs, figures and names of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudstrata.operators import batches, crops, figures, profile, records, regions, runs
from cloudstrata.plans.point_queries import AXES, points, rounded
from cloudstrata.plans.record_queries import _UB, _user_boxes
from cloudstrata.plans.registry import query, table
from cloudstrata.session import new_folder
from cloudstrata.sources import las
from cloudstrata.types import POINT
from cloudstrata.views import EVENT_POINTS_SQL as PTS

_SCALES, _OFFSETS = (0.0001, 0.0001, 0.0001), (0.0, 0.0, 0.0)


def _las_file(spark, sf_dir) -> str:
    """The event points as a LAS file in the shared folder, in the order of row_id; a file's own row numbers begin at 0."""
    p = points(spark, sf_dir)
    given = {f"raw_{a}": F.col(f"raw_{a}").cast("int") for a in AXES} | {"intensity": (F.col("user_id") % 1000).cast("int"), "classification": F.length("classification").cast("short"), "gps_time": F.col("row_id").cast("double")}
    plain = {"smallint": F.lit(1).cast("short"), "boolean": F.lit(False), "int": F.lit(7), "double": F.lit(0.0), "string": F.lit("")}
    kinds = {f.name: f.dataType.simpleString() for f in POINT.fields}
    rows = p.select(*[given[n].alias(n) if n in given else F.col(n) if n in ("row_id", *AXES) else plain[k].alias(n) for n, k in kinds.items()])
    path = new_folder(spark, "las").removeprefix("file://") + ".las"
    las.write_las(rows, path, _SCALES, _OFFSETS)
    return path


@query(f"""WITH {PTS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(raw_x AS INTEGER) AS raw_x, CAST(raw_y AS INTEGER) AS raw_y, CAST(raw_z AS INTEGER) AS raw_z, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z,
CAST(user_id % 1000 AS INTEGER) AS intensity, CAST(length(classification) AS SMALLINT) AS classification, CAST(row_id AS DOUBLE) AS gps_time FROM pts""")
def las_points(spark, sf_dir):
    found = spark.read.format("las").option("chunk_points", 2_000).load(_las_file(spark, sf_dir))
    return rounded(found.select("row_id", "raw_x", "raw_y", "raw_z", *AXES, "intensity", "classification", "gps_time"))


@query(f"""WITH {PTS} SELECT '1.4' AS las_version, 7 AS point_format, 36 AS point_record_length, count(*) AS point_count, {", ".join(f"round(min({a}), 6) AS min_{a}, round(max({a}), 6) AS max_{a}" for a in AXES)},
375 + 36 * count(*) AS file_size_bytes FROM pts""")
def las_header(spark, sf_dir):
    h = spark.read.format("las_header").load(_las_file(spark, sf_dir))
    box = [F.col(f"{n}s")[k].alias(f"{n}_{a}") for k, a in enumerate(AXES) for n in ("min", "max")]
    return rounded(h.select("las_version", "point_format", "point_record_length", "point_count", *box, "file_size_bytes"))


@query(f"""WITH {PTS}, n AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, raw_x, raw_y, raw_z, x, y FROM pts) SELECT row_id, raw_x::INTEGER AS raw_x, raw_y::INTEGER AS raw_y, raw_z::INTEGER AS raw_z FROM n
WHERE x BETWEEN 200 AND 260 AND y BETWEEN 30 AND 90""")
def las_region(spark, sf_dir):
    """Only the blocks of the file that meet the rectangle are read."""
    path, index = _las_file(spark, sf_dir), new_folder(spark, "las-index")
    las.index_las(spark, [path], index)
    return spark.read.format("las").option("index", index).load(path).filter("x between 200 and 260 and y between 30 and 90").select("row_id", "raw_x", "raw_y", "raw_z")


@query(f"""WITH {PTS}, n AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, raw_x, count(*) OVER () AS n FROM pts), k AS (SELECT DISTINCT CASE WHEN k = 299 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / 299)) AS BIGINT) END AS row_id FROM n, generate_series(0, 299) g(k))
SELECT n.row_id, raw_x::INTEGER AS raw_x FROM n JOIN k USING (row_id)""")
def las_overview(spark, sf_dir):
    return las.overview(spark, _las_file(spark, sf_dir), 300).select("row_id", "raw_x")


@query("""WITH p AS (SELECT 'runs/' || s_suppkey || '/Run ' || CASE s_suppkey % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'RIGHT' ELSE 'left and right' END || '.las.txt' AS path, s_suppkey % 3 AS k FROM supplier)
SELECT 'left' AS side, min(path) AS path FROM p WHERE k <> 1 UNION ALL SELECT 'right', min(path) FROM p WHERE k <> 0""")
def side_pairing(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, "Left").when(k == 1, "RIGHT").otherwise("left and right")
    return profile.sides_of_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("runs/"), F.col("s_suppkey").cast("string"), F.lit("/Run "), name, F.lit(".las.txt")).alias("path")))


@query(f"""WITH {PTS}, r AS (SELECT * FROM pts WHERE x BETWEEN 100 AND 400 AND y BETWEEN 10 AND 60), c AS (SELECT count(*) AS dense_points, count(*) FILTER (row_id % 7 = 0) AS sparse_points FROM r)
SELECT dense_points, sparse_points, round(dense_points / sparse_points, 6) AS multiplier FROM c""")
def density_ratio(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(profile.density_multiplier(p, p.filter("row_id % 7 = 0"), regions.inside({"x": (100, 400), "y": (10, 60)})))


@query(f"""WITH {PTS} SELECT row_id, {", ".join(f"round({a} - min({a}) OVER (PARTITION BY side), 6) AS local_{a}" for a in AXES)} FROM pts""")
def local_coordinates(spark, sf_dir):
    return rounded(regions.local_coordinates(points(spark, sf_dir), ["side"]).select("row_id", *[f"local_{a}" for a in AXES]))


@query(f"""WITH {PTS}, c AS (SELECT min(x) - 8 AS low_x, max(x) + 8 AS high_x, min(y) - 8 AS low_y, max(y) + 8 AS high_y, count(*) AS members FROM pts WHERE user_id = 7 AND classification = 'click')
SELECT round(low_x, 6) AS low_x, round(high_x, 6) AS high_x, round(low_y, 6) AS low_y, round(high_y, 6) AS high_y, (SELECT count(*) FROM pts WHERE x BETWEEN low_x AND high_x AND y BETWEEN low_y AND high_y) AS points, members,
low_x < 0 OR high_x > 720 OR low_y < 0 OR high_y > 60 AS truncated FROM c""")
def context_truncation(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "x", "y", "z", "user_id", "classification")
    found = batches.context_summary(p, p.filter("user_id = 7 and classification = 'click'"), 8.0, (0.0, 720.0, 0.0, 60.0))
    return rounded(found.select("low_x", "high_x", "low_y", "high_y", "points", "members", "truncated"))


_BOXES = {"a": {"x": (100, 140), "y": (20, 45), "z": (0, 30)}, "b": {"x": (130, 200), "y": (40, 80), "z": (10, 60)}, "c": {"x": (650, 700), "y": (1, 30), "z": (0, 500)}}


@query(f"""WITH {PTS}, n AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, raw_x, raw_z, x, y, z FROM pts) {" UNION ALL ".join(f"SELECT '{n}' AS box, row_id, raw_x::INTEGER AS raw_x, raw_z::INTEGER AS raw_z FROM n WHERE x BETWEEN {b['x'][0] - 5} AND {b['x'][1] + 5} AND y BETWEEN {b['y'][0] - 5} AND {b['y'][1] + 5} AND z BETWEEN {b['z'][0]} AND {b['z'][1]}" for n, b in _BOXES.items())}""")
def crop_scan(spark, sf_dir):
    manifest = crops.scan_crops(spark, _las_file(spark, sf_dir), _BOXES, new_folder(spark, "crops"), allow_scan=True)
    each = [spark.read.parquet(c["path"]).select(F.lit(n).alias("box"), "row_id", "raw_x", "raw_z") for n, c in manifest["crops"].items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {PTS} SELECT row_id, CASE WHEN x > 600 THEN 'uncovered' WHEN z <= 20 THEN 'ground' ELSE 'non_ground' END AS part FROM pts")
def mask_parts(spark, sf_dir):
    return points(spark, sf_dir).select("row_id", runs.mask_part(F.col("z") <= 20, F.col("x") <= 600).alias("part"))


@query(f"WITH {PTS} SELECT round(median(x), 6) AS x, round(median(y), 6) AS y FROM pts")
def suggested_centre(spark, sf_dir):
    return rounded(figures.suggested_centre(points(spark, sf_dir)))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first FROM events GROUP BY user_id")
def last_by_key(spark, sf_dir):
    return runs.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""WITH {PTS}, b AS (SELECT user_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY user_id), c AS (SELECT b.*, i, j FROM b, generate_series(0, 1) s(i), generate_series(0, 1) t(j)),
e AS (SELECT user_id, min_x AS x1, CASE WHEN i = 1 THEN max_y ELSE min_y END AS y1, CASE WHEN j = 1 THEN max_z ELSE min_z END AS z1, max_x AS x2, CASE WHEN i = 1 THEN max_y ELSE min_y END AS y2, CASE WHEN j = 1 THEN max_z ELSE min_z END AS z2, i + 2 * j AS edge FROM c
UNION ALL SELECT user_id, CASE WHEN i = 1 THEN max_x ELSE min_x END, min_y, CASE WHEN j = 1 THEN max_z ELSE min_z END, CASE WHEN i = 1 THEN max_x ELSE min_x END, max_y, CASE WHEN j = 1 THEN max_z ELSE min_z END, 4 + i + 2 * j FROM c
UNION ALL SELECT user_id, CASE WHEN i = 1 THEN max_x ELSE min_x END, CASE WHEN j = 1 THEN max_y ELSE min_y END, min_z, CASE WHEN i = 1 THEN max_x ELSE min_x END, CASE WHEN j = 1 THEN max_y ELSE min_y END, max_z, 8 + i + 2 * j FROM c)
SELECT user_id, CAST(edge AS INTEGER) AS edge, {", ".join(f"round({a}1, 6) AS from_{a}, round({a}2, 6) AS to_{a}" for a in AXES)} FROM e""")
def candidate_box_edges(spark, sf_dir):
    p = points(spark, sf_dir)
    boxes = p.groupBy("user_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    return rounded(figures.box_edges(boxes, "user_id"))


@query(f"""WITH {_UB}, nb AS (SELECT *, 'c' || CAST(user_id * 4 + part AS VARCHAR) AS crop, user_id % 3 AS region FROM ub), ed AS (SELECT p.crop AS a, q.crop AS b FROM nb p JOIN nb q ON p.side = q.side AND p.crop <> q.crop AND (p.region = q.region
OR (greatest(p.min_x, q.min_x) <= least(p.max_x, q.max_x) AND greatest(p.min_y, q.min_y) <= least(p.max_y, q.max_y) AND greatest(p.min_z, q.min_z) <= least(p.max_z, q.max_z)))),
t AS (WITH RECURSIVE r(i, j) AS (SELECT crop, crop FROM nb UNION SELECT r.i, ed.b FROM r JOIN ed ON r.j = ed.a) SELECT i, min(j) AS g FROM r GROUP BY i), n AS (SELECT g, side, sha256(side || '|' || string_agg(crop, '|' ORDER BY crop)) AS group_id FROM t JOIN nb ON nb.crop = t.i GROUP BY g, side)
SELECT crop, g AS "group", group_id FROM t JOIN nb ON nb.crop = t.i JOIN n USING (g, side)""")
def crop_groups(spark, sf_dir):
    b = _user_boxes(spark, sf_dir).withColumns({"crop": F.concat(F.lit("c"), (F.col("user_id") * 4 + F.col("part")).cast("string")), "region": F.col("user_id") % 3})
    return records.crop_groups(b, "crop", "side", "region")


@query("""WITH n AS (SELECT l_orderkey AS candidate, l_partkey AS name, l_linenumber AS position FROM lineitem), m AS (SELECT candidate, position, name, p_brand, row_number() OVER (PARTITION BY candidate ORDER BY position, name) AS k FROM n JOIN part ON p_partkey = name WHERE p_size > 25)
SELECT candidate, name AS found_as, p_brand FROM m WHERE k = 1""")
def feature_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("position"))
    features = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("name"), "p_brand")
    return records.first_entry(features, names, key="candidate")


@query("SELECT conv_id, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def joined_ids(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(records.joined_ids("role").alias("roles"))
