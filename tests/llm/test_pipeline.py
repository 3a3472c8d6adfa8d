"""The pipeline's stages work on what they are given, and the registry is whole."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from cloudstrata.llm import queries


def test_registry():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert 0.5 * n < kept.count() <= n
        assert kept.join(docs, docs.columns, "left_anti").count() == 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows(spark, sf_dir):
    """Null and repeated ids, repeated rows, a very long text and an extra column whose name stages use: every clean text stays, once in all after the duplicates' stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    base = docs.filter("doc_id < 60").withColumn("label", F.lit("extra"))
    good = [r["text"] for r in corpus_pipeline.keep_good(spark, docs, sf_dir).filter("n_chars between 400 and 3000 and lang = 'en'").orderBy("doc_id").limit(6).collect()]
    long = "\n".join(good[:3] * 400)
    rows = [(None, good[0] + " " + item), (None, good[1]), (None, good[1]), (-1, good[2]), (-1, good[3]), (-2, good[4]), (-2, good[4]), (-3, long), (None, None), (-4, "")]
    odd = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, label string")
    kept = base.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == base.columns and kept.exceptAll(before).count() == 0
        mine = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.filter("source = 'odd'").collect()), key=str)
        clean = [(i or 0, t) for i, t in rows if t]
        if name in ("quality", "toxicity"):
            assert [m for m in mine if m[1]] == sorted(clean, key=str)
    texts = [t for _, t in mine if t]
    assert good[0] + " " + item not in texts and len(texts) == len(set(texts)) and {good[2], good[3], good[4]} <= set(texts)
    assert kept.filter(F.col("text") == good[1]).count() <= 1  # of no id or, if that is there, of the table's own
    out = corpus_pipeline.encode(spark, kept, sf_dir)
    assert out.count() == kept.count()
