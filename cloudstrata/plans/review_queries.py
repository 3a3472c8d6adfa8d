"""Queries over rankings and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudstrata.operators import batches, ranking, reviews
from cloudstrata.plans.registry import query, table

_COS = """v AS (SELECT vec_id // 4 AS candidate, vec_id % 4 AS view, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
m AS (SELECT label AS prompt, list(a ORDER BY i) AS f FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, generate_series(1, 64) t(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT candidate, view, prompt, round(list_inner_product(e, f) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(f, f)), 9) AS cosine FROM v, m)"""
_AGG = f"{_COS}, g AS (SELECT candidate, prompt, round(avg(cosine), 7) AS score FROM s GROUP BY candidate, prompt), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY candidate ORDER BY score DESC, prompt) AS INTEGER) AS \"rank\" FROM g)"


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    parts = e.select(F.col("label").alias("prompt"), F.posexplode("features").alias("i", "x")).groupBy("prompt", "i").agg(F.avg("x").alias("a"))
    prompts = parts.groupBy("prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("features"))
    views = e.select(F.expr("vec_id div 4").alias("candidate"), (F.col("vec_id") % 4).alias("view"), "features")
    return ranking.cosine_scores(views, prompts).withColumn("cosine", F.round("cosine", 9))


def _ranking(spark, sf_dir):
    total = _scores(spark, sf_dir).groupBy("candidate", "prompt").agg(F.round(F.avg("cosine"), 7).alias("score"))
    return ranking.ranked(total, ["candidate"], "score")


@query(f"WITH {_AGG} SELECT candidate, prompt, score, \"rank\" FROM r")
def class_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir)


@query(f"WITH {_AGG} SELECT candidate, prompt, \"rank\" FROM r WHERE \"rank\" <= 5")
def top5(spark, sf_dir):
    return ranking.top(_ranking(spark, sf_dir), 5).select("candidate", "prompt", "rank")


@query(f"""WITH {_COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY candidate, view ORDER BY cosine DESC, prompt) AS INTEGER) AS "rank" FROM s) SELECT candidate, view, prompt, "rank" FROM r WHERE "rank" <= 3""")
def view_top3(spark, sf_dir):
    return ranking.top(ranking.ranked(_scores(spark, sf_dir), ["candidate", "view"]), 3).select("candidate", "view", "prompt", "rank")


@query(f"""WITH {_AGG}, b AS (SELECT candidate, prompt AS top1 FROM r WHERE "rank" = 1), w AS (SELECT candidate, view, arg_min(prompt, (-cosine, prompt)) AS p FROM s GROUP BY candidate, view)
SELECT b.candidate, top1, avg(CASE WHEN p <> top1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS disagreement FROM w JOIN b ON b.candidate = w.candidate GROUP BY b.candidate, top1""")
def view_disagreement(spark, sf_dir):
    return ranking.disagreement(_scores(spark, sf_dir), 7)


@query("""SELECT conv_id, max(turn) AS revision, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def latest_review(spark, sf_dir):
    return reviews.latest(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("revision"), "role", "text"), "conv_id", "revision")


@query("SELECT count(l.doc_id) AS reviewed, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def review_progress(spark, sf_dir):
    return reviews.progress(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH c AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS reviewed FROM documents)
SELECT coalesce((SELECT doc_id FROM c WHERE NOT reviewed AND doc_id <> 120 ORDER BY CASE WHEN doc_id > 120 THEN 0 ELSE 1 END, doc_id LIMIT 1), 120)::BIGINT AS "next" """)
def next_unreviewed(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    c = table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left")
    return reviews.next_unreviewed(c, F.col("done").isNotNull(), "doc_id", 120)


_QUALITY = "CASE WHEN quality = 1 THEN 'usable single object' WHEN quality = 0 THEN 'unclear' END"
_CLASS = "CASE WHEN toxic = 1 THEN '  Unknown ' WHEN toxic = 0 THEN ' Vehicle' END"


@query(f"""WITH l AS (SELECT doc_id, {_QUALITY} AS crop_quality, CASE WHEN lower(trim({_CLASS})) IN ('', 'unknown') THEN NULL ELSE trim({_CLASS}) END AS human_class, 1 AS revision FROM labels)
SELECT d.doc_id, d.source, l.human_class, l.crop_quality, l.revision IS NOT NULL AS reviewed, coalesce(l.human_class IS NOT NULL AND l.crop_quality = 'usable single object', FALSE) AS eligible,
'eval_' || CAST(min(d.doc_id) OVER (PARTITION BY d.source) AS VARCHAR) AS evaluation_group FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""")
def reference_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    made = table(spark, sf_dir, "labels").select("doc_id", F.expr(_QUALITY).alias("crop_quality"), reviews.normal_label(F.expr(_CLASS)).alias("human_class"), F.lit(1).alias("revision"))
    first = d.groupBy("source").agg(F.min("doc_id").alias("g"))
    groups = d.join(first, "source").select("doc_id", F.concat(F.lit("eval_"), F.col("g").cast("string")).alias("group"))
    rows = reviews.reference_rows(d, made, groups, key="doc_id")
    return rows.select("doc_id", "source", "human_class", "crop_quality", "reviewed", F.col("eligible_for_later_classification").alias("eligible"), "evaluation_group")


@query("""WITH l AS (SELECT doc_id, quality FROM labels) SELECT d.doc_id, l.doc_id IS NOT NULL AS reviewed, e.label AS prediction, p.url AS feature_reference FROM documents d LEFT JOIN l USING (doc_id)
LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id""")
def reference_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    made = table(spark, sf_dir, "labels").select("doc_id", F.lit("unclear").alias("crop_quality"), F.lit(None).cast("string").alias("human_class"), F.lit(1).alias("revision"))
    predictions = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("prediction"))
    features = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("feature_reference"))
    rows = reviews.reference_rows(d, made, d.withColumn("group", F.col("doc_id")), key="doc_id", predictions=predictions, features=features)
    return rows.select("doc_id", "reviewed", "prediction", "feature_reference")


@query("""SELECT conv_id, bool_or(role = 'system') AS suggestions_revealed, count(*) AS reveal_event_count, max(turn) AS last_reveal_utc FROM conversations GROUP BY conv_id""")
def exposure_summary(spark, sf_dir):
    events = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "system").alias("suggestions_available"), F.col("turn").alias("at_utc"))
    return reviews.exposure_summary(events, "conv_id")


@query("""SELECT count(*) AS candidates, count(*) FILTER (doc_id % 5 = 0) AS parents, count(*) FILTER (doc_id % 5 <> 0) AS additions, count(DISTINCT source) AS regions, count(DISTINCT lang) AS groups FROM documents""")
def batch_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("is_parent", F.col("doc_id") % 5 == 0)
    return batches.batch_counts(rows, region="source", group="lang")


@query("""SELECT doc_id, CASE WHEN lower(trim(source)) IN ('src0', 'src1') THEN NULL ELSE trim(source) END AS label FROM documents""")
def label_normalisation(spark, sf_dir):
    c = F.when(F.lower(F.trim("source")).isin("src0", "src1"), "Unknown / Uncertain").otherwise(F.concat(F.lit(" "), F.col("source"), F.lit("  ")))
    return table(spark, sf_dir, "documents").select("doc_id", reviews.normal_label(c).alias("label"))


