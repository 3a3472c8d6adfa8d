"""The corpus pipeline: five stages, each one operator over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs, whatever they are. Stages that learn do so from the
labels table of sf_dir and the documents they are given.

Rows are judged by their text. A row with a null doc_id is judged like others and
has no label; rows with one doc_id and different texts are judged each; repeated
rows get one judgement, but of near duplicates one row stays. Null and empty texts
have no good line, so the first stage rejects them where it could learn; else they
pass all stages and have no tokens. Texts of any length are taken whole. Columns
of any other names pass through the stages unread. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudstrata.llm import bpe, decontaminate, jaccard, quality, toxicity
from cloudstrata.llm.queries import vocabulary
from cloudstrata.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_poor(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least doc_id, null being the greatest, and of equal ones that with the least text name."""
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, whatever their doc_id."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_duplicates", keep_one_of_each), ("decontamination", keep_clean), ("bpe", encode)]

#: The first two stages are fitted models, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
