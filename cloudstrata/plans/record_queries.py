"""Queries over whole records, memberships, boxes and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudstrata.functions.hashing import membership_id as member_ids
from cloudstrata.operators import batches, ground, records
from cloudstrata.plans.point_queries import points, rounded
from cloudstrata.plans.registry import query, table
from cloudstrata.sources import documents as docs
from cloudstrata.views import EVENT_POINTS_SQL as PTS

LINE = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]
COLS = ", ".join(LINE)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE)


@query(f"""WITH r AS (SELECT {COLS}, l_orderkey % 7 AS part FROM lineitem), s AS (SELECT DISTINCT {COLS}, CASE WHEN l_quantity <= 25 THEN 'ground' ELSE 'non_ground' END AS label FROM lineitem)
SELECT r.l_orderkey, r.l_partkey, r.l_quantity, r.l_returnflag, s.label FROM r LEFT JOIN s ON {" AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in LINE)}""")
def multiset_label_join(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return records.label_by_partition(rows, {"ground": rows.filter("l_quantity <= 25"), "non_ground": rows.filter("l_quantity > 25")}, LINE)


@query("""SELECT l_returnflag, l_quantity, CAST(count(*) - count(*) FILTER (l_linenumber <= 2) AS BIGINT) AS extra FROM lineitem GROUP BY ALL HAVING count(*) > count(*) FILTER (l_linenumber <= 2)""")
def multiset_except(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keep = ["l_returnflag", "l_quantity"]
    return records.multiset_difference(rows.select(*keep), rows.filter("l_linenumber <= 2").select(*keep), keep)


@query(f"""WITH c AS (SELECT DISTINCT {COLS} FROM lineitem WHERE l_quantity <= 30), s AS (SELECT {COLS} FROM lineitem WHERE l_orderkey % 11 = 0)
SELECT count(*) AS seeds, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE {" AND ".join(f"c.{x} IS NOT DISTINCT FROM s.{x}" for x in LINE)})) AS recovered FROM s""")
def seed_recovery(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return records.recovered(rows.filter("l_orderkey % 11 = 0"), rows.filter("l_quantity <= 30"), LINE)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 3 = 0)")
def context_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return records.context_of(e, e.filter("event_type = 'click' and user_id % 3 = 0"), "event_id").select("event_id", "user_id", "event_type")


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS r FROM lineitem), n AS (SELECT g, count(*) AS n FROM m GROUP BY g)
SELECT a.g AS a, b.g AS b, count(*) AS shared, round(count(*) / least(any_value(na.n), any_value(nb.n)), 6) AS smaller_share FROM m a JOIN m b ON a.r = b.r AND a.g < b.g JOIN n na ON na.g = a.g JOIN n nb ON nb.g = b.g GROUP BY a.g, b.g""")
def membership_overlap(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("r"))
    return rounded(records.shared_members(m, "g", "r"))


_UB = f"{PTS}, ub AS (SELECT user_id, side, row_id % 4 AS part, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS points FROM pts GROUP BY user_id, side, row_id % 4)"


def _user_boxes(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("part", F.col("row_id") % 4)
    return p.groupBy("user_id", "side", "part").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("points"))


_EDGES = f"""{_UB}, nb AS (SELECT *, user_id * 4 + part AS k FROM ub), ed AS (SELECT p.side, p.k AS a, q.k AS b FROM nb p JOIN nb q ON p.side = q.side AND p.k < q.k
AND greatest(p.min_x, q.min_x) <= least(p.max_x, q.max_x) AND greatest(p.min_y, q.min_y) <= least(p.max_y, q.max_y) AND greatest(p.min_z, q.min_z) <= least(p.max_z, q.max_z))"""


def _edges(spark, sf_dir):
    b = _user_boxes(spark, sf_dir).withColumn("k", F.col("user_id") * 4 + F.col("part"))
    return b, records.overlapping_boxes(b, "k", "side", cell=50.0)


@query(f"WITH {_EDGES} SELECT side, a, b FROM ed")
def crop_overlap_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("side", "a", "b")


@query(f"""WITH {_EDGES}, u AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed UNION SELECT k, k FROM nb), t AS (WITH RECURSIVE r(i, j) AS (SELECT a, b FROM u UNION SELECT r.i, u.b FROM r JOIN u ON r.j = u.a) SELECT i, min(j) AS g FROM r GROUP BY i)
SELECT i AS k, g AS "group" FROM t""")
def leakage_groups(spark, sf_dir):
    b, e = _edges(spark, sf_dir)
    return records.groups_of_edges(b, "k", e)


@query("""WITH d AS (SELECT doc_id, source || '-' || CAST(doc_id // 40 AS VARCHAR) AS automatic, CASE WHEN doc_id % 10 = 0 THEN lang || CAST(n_chars % 9 AS VARCHAR) END AS tag FROM documents),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.automatic = y.automatic OR x.tag = y.tag), t AS (WITH RECURSIVE r(i, j) AS (SELECT a, b FROM e UNION SELECT r.i, e.b FROM r JOIN e ON r.j = e.a) SELECT i, min(j) AS g FROM r GROUP BY i)
SELECT d.doc_id, coalesce(g, d.doc_id) AS "group" FROM d LEFT JOIN t ON t.i = d.doc_id""")
def eval_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("-", "source", F.expr("doc_id div 40")).alias("automatic"), F.when(F.col("doc_id") % 10 == 0, F.concat("lang", (F.col("n_chars") % 9).cast("string"))).alias("tag")
    )
    return records.tagged_groups(d, "doc_id", ["automatic", "tag"])


@query(f"""WITH {_UB}, s AS (SELECT user_id, part, list_sort([max_x - min_x, max_y - min_y, max_z - min_z]) AS s, least(min_x - 0, 720 - max_x, min_y - 0, 150 - max_y) AS clearance FROM ub)
SELECT user_id, part, CASE WHEN s[3] >= 2.5 * greatest(s[2], 1e-12::DOUBLE) THEN 'elongated' WHEN s[2] >= 2.5 * greatest(s[1], 1e-12::DOUBLE) THEN 'thin' ELSE 'compact' END AS hint, round(clearance, 6) AS clearance, clearance <= 6.03 AS near_boundary FROM s""")
def bbox_hint(spark, sf_dir):
    b = _user_boxes(spark, sf_dir)
    clear = records.crop_clearance({"x": (0, 720), "y": (0, 150)})
    span = {f"s{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    return rounded(b.withColumns(span).select("user_id", "part", records.shape_hint("sx", "sy", "sz").alias("hint"), clear.alias("clearance"), (clear <= 6.03).alias("near_boundary")))


@query("""WITH a AS (SELECT DISTINCT ON (k) k, src FROM (SELECT l_orderkey AS k, 0 AS src FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, 1 FROM lineitem WHERE l_quantity > 45) ORDER BY k, src)
SELECT k, src, row_number() OVER (ORDER BY k) - 1 AS place FROM a""")
def source_union(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    part = lambda f, k: rows.filter(f).select(F.col("l_orderkey").alias("k"), F.lit(k).alias("src")).distinct()
    return records.union_of_sources([part("l_quantity < 5", 0), part("l_quantity > 45", 1)], "k")


_POOL = "CASE WHEN p_size > 33 THEN 'elongated' WHEN p_size > 16 THEN 'thin' ELSE 'compact' END"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, {_POOL} AS hint, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS k,
row_number() OVER (PARTITION BY p_brand, {_POOL} ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS h FROM part), f AS (SELECT *, min(k) OVER (PARTITION BY p_brand, hint) AS first FROM p)
SELECT p_partkey, p_brand, hint, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY h, first) AS INTEGER) AS turn FROM f""")
def pool_interleave(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size", F.expr(_POOL).alias("hint"))
    order = [F.desc("p_retailprice"), F.desc("p_size"), "p_partkey"]
    return records.interleaved(p, "p_brand", "hint", order).select("p_partkey", "p_brand", "hint", "turn")


_LE = " || ".join(f"substr(h, {15 - 2 * k}, 2)" for k in range(8))


@query(f"""WITH r AS (SELECT user_id, event_id, lpad(hex(event_id), 16, '0') AS h FROM (SELECT DISTINCT user_id, event_id FROM events)), s AS (SELECT user_id, count(*) AS n, string_agg({_LE}, '' ORDER BY event_id) AS d FROM r GROUP BY user_id)
SELECT user_id, 'candidate_' || substr(sha256(unhex(hex('source-1') || d)), 1, 24) AS candidate_id, CAST(n AS INTEGER) AS point_count FROM s""")
def membership_id(spark, sf_dir):
    return member_ids(table(spark, sf_dir, "events"), ["user_id"], F.lit("source-1"), "event_id")


_WKT = 'PROJCS["NAD83(2011) / Ohio South",GEOGCS["NAD83",UNIT["degree",0.0174]],UNIT["US survey foot",0.3048006],AUTHORITY["EPSG","6553"]]'


@query(f"""SELECT 'region-' || r_regionkey AS path, '{_WKT}' AS wkt, 'NAD83(2011) / Ohio South' AS name, 'US survey foot' AS unit, '6553' AS epsg FROM region WHERE r_regionkey % 2 = 0""")
def crs_sidecar(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("path"), "r_regionkey")
    text = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Export unit: Meter\n  WKT (GDAL): "), F.lit(_WKT))).otherwise(F.lit("Export unit: Meter"))
    return docs.coordinate_systems(r.select("path", F.explode(F.split(text, "\n")).alias("value"))).select("path", "wkt", "name", "unit", "epsg")


_PLANE, _ANGLE = 'PROJCS["P-%s",GEOGCS["G",UNIT["degree",0.0174]],PROJECTION["T"],PARAMETER["k",1],UNIT["metre",1],AUTHORITY["EPSG","26917"]]', 'GEOGCS["G-%s",DATUM["D",SPHEROID["S",6378137,298.25]],UNIT["degree",0.0174],AUTHORITY["EPSG",4326]]'
_BOTH = 'COMPD_CS["C-%s",PROJCS["P",GEOGCS["G",UNIT["degree",0.0174]],UNIT["US survey foot",0.3048],AUTHORITY["EPSG","6553"]],VERT_CS["V",VERT_DATUM["N",2005],UNIT["metre",1]],AUTHORITY["EPSG","8912"]]'


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'projected' WHEN 1 THEN 'geographic' WHEN 2 THEN 'compound' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN 'P-' WHEN 1 THEN 'G-' WHEN 2 THEN 'C-' END || n_name AS name,
CASE n_nationkey % 4 WHEN 0 THEN 'metre' WHEN 1 THEN 'degree' WHEN 2 THEN 'US survey foot' END AS unit, CASE WHEN n_nationkey % 4 = 2 THEN 'metre' END AS vertical_unit,
CASE n_nationkey % 4 WHEN 0 THEN '26917' WHEN 1 THEN '4326' WHEN 2 THEN '8912' END AS epsg, n_nationkey % 4 = 3 AS broken FROM nation""")
def crs_tree(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    text = F.when(k == 0, F.format_string(_PLANE, "n_name")).when(k == 1, F.format_string(_ANGLE, "n_name")).when(k == 2, F.format_string(_BOTH, "n_name")).otherwise(F.format_string('PROJCS["%s",UNIT["metre",1]', "n_name"))
    return docs.crs_facts(n.select(F.col("n_nationkey").alias("id"), text.alias("wkt"))).select("id", "kind", "name", "unit", "vertical_unit", "epsg", F.col("error").isNotNull().alias("broken"))


@query("""SELECT r_regionkey AS side, r_name AS name, r_regionkey % 2 = 0 AS same_scale, TRUE AS same_format, r_regionkey % 2 = 0 AS lineage_ok FROM region""")
def catalogue_lineage(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    runs = r.select(F.col("r_regionkey").alias("side"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2).alias("scale"), F.lit(7).alias("format"))
    inputs = r.select(F.col("r_regionkey").alias("side"), F.lit(0).cast("long").alias("scale"), F.lit(7).alias("format"))
    return docs.catalogue(runs, inputs, ["scale", "format"]).select("side", "name", "same_scale", "same_format", "lineage_ok")


@query("SELECT event_type AS kind, max(props) AS path FROM events GROUP BY event_type")
def latest_artifact(spark, sf_dir):
    return docs.latest_path(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("path")), "kind")


@query("""SELECT * FROM (SELECT p_brand AS id, p_partkey AS legacy, count(*) OVER (PARTITION BY p_partkey) AS matches FROM part) WHERE matches = 1""")
def alias_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("candidate_id"), F.col("p_partkey").cast("string").alias("name"))
    batch = part.select("candidate_id", F.array("name").alias("legacy_ids"))
    return batches.resolved(batch, part).select(F.col("candidate_id").alias("id"), F.col("name").cast("long").alias("legacy"), "matches")


_MEMBERS = """m AS (SELECT l_suppkey % 12 AS c, l_shipmode_ AS source, l_orderkey AS r, l_quantity AS q FROM (SELECT *, CASE WHEN l_linenumber <= 3 THEN 'left' ELSE 'right' END AS l_shipmode_ FROM lineitem))"""


@query(f"""WITH {_MEMBERS}, d AS (SELECT DISTINCT source || c AS g, source, r FROM m), n AS (SELECT g, count(*) AS n FROM d GROUP BY g), sh AS (SELECT a.g AS a, b.g AS b, count(*) AS shared, any_value(na.n) AS na, any_value(nb.n) AS nb
FROM d a JOIN d b ON a.r = b.r AND a.source = b.source AND a.g < b.g JOIN n na ON na.g = a.g JOIN n nb ON nb.g = b.g GROUP BY a.g, b.g),
bx AS (SELECT source || c AS g, source, min(r) AS lo, max(r) AS hi, min(q) AS ql, max(q) AS qh FROM m GROUP BY ALL), ov AS (SELECT p.g AS a, q.g AS b FROM bx p JOIN bx q ON p.source = q.source AND p.g < q.g AND greatest(p.lo, q.lo) <= least(p.hi, q.hi) AND greatest(p.ql, q.ql) <= least(p.qh, q.qh))
SELECT coalesce(sh.a, ov.a) AS a, coalesce(sh.b, ov.b) AS b, coalesce(shared, 0) AS shared, round(coalesce(shared / least(na, nb), 0), 6) AS smaller_share, ov.a IS NOT NULL AS boxes_overlap FROM sh FULL JOIN ov ON sh.a = ov.a AND sh.b = ov.b""")
def pair_evidence(spark, sf_dir):
    side = F.when(F.col("l_linenumber") <= 3, "left").otherwise("right")
    rows = table(spark, sf_dir, "lineitem").select(side.alias("source"), (F.col("l_suppkey") % 12).alias("c"), F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("q"))
    rows = rows.withColumn("candidate_id", F.concat("source", F.col("c").cast("string")))
    box = rows.groupBy("source", "candidate_id").agg(F.min("row_id").alias("min_x"), F.max("row_id").alias("max_x"), F.min("q").alias("min_y"), F.max("q").alias("max_y"), F.lit(0).alias("min_z"), F.lit(0).alias("max_z"))
    return rounded(batches.pair_evidence(rows, box))


@query(f"""WITH {PTS}, c AS (SELECT * FROM pts WHERE user_id = 7 AND classification = 'click'), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM c)
SELECT row_id, x, y, z, row_id IN (SELECT row_id FROM c) AS member FROM pts, b WHERE x BETWEEN lx - 8 AND hx + 8 AND y BETWEEN ly - 8 AND hy + 8""")
def candidate_context(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "x", "y", "z", "user_id", "classification")
    return batches.candidate_context(p, p.filter("user_id = 7 and classification = 'click'"), 8.0).select("row_id", "x", "y", "z", "member")


@query(f"""WITH {PTS}, g AS (SELECT side, z - min(z) OVER (PARTITION BY side, floor(x / 24.0::DOUBLE), floor(y / 24.0::DOUBLE)) <= 25 AS a, z <= 20 AS b FROM pts)
SELECT 'baseline' AS method, side, count(*) AS input_points, count(*) FILTER (a) AS ground_points, count(*) FILTER (NOT a) AS other_points, round(count(*) FILTER (a) / count(*), 6) AS ground_fraction FROM g GROUP BY side
UNION ALL SELECT 'level', side, count(*), count(*) FILTER (b), count(*) FILTER (NOT b), round(count(*) FILTER (b) / count(*), 6) FROM g GROUP BY side""")
def ground_comparison(spark, sf_dir):
    p = ground.ground_by_cell(points(spark, sf_dir), 24.0, 25.0, ["side"]).withColumnRenamed("ground", "baseline").withColumn("level", F.col("z") <= 20)
    rows = batches.comparison_rows(p, {"baseline": {"cell": 24}, "level": {"z": 20}}, ["side"])
    return rounded(rows.select("method", "side", "input_points", "ground_points", "other_points", "ground_fraction"))


@query()
def review_batch(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("crop", F.concat(F.lit("crop"), (F.col("user_id") % 5).cast("string"))).withColumnsRenamed({"side": "source"}).withColumn("label", (F.col("user_id") % 20).cast("int"))
    c = p.groupBy("crop", "label", "source").agg(F.count("*").alias("point_count"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    c = c.withColumns({"is_parent": (F.col("label") < 5) & (F.col("source") == "left"), "clearance": F.col("min_x") + 1, "region": F.col("crop")})
    batch = batches.prepare_batch(c, p.select("crop", "label", "source", "row_id"), 12, 3)
    return batch.candidates.select("place", "candidate_id", "crop", "label", F.col("point_count").alias("points"))
