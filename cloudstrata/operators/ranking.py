"""Similarity ranking of candidates over views and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """The inner product of two arrays of doubles, component by component in order."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(c: str) -> Column:
    """The array over its norm; null without one."""
    norm = F.sqrt(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(F.col(c).cast("array<double>"), lambda x: x / norm))


def cosine_scores(views: DataFrame, prompts: DataFrame, most_prompts: int = 10_000) -> DataFrame:
    """candidate, view, prompt, cosine for each view and prompt. Prompts are a short list whose number is checked, so they are sent to every task."""
    n = prompts.count()
    if n > most_prompts:
        raise ValueError(f"{n} prompts, more than {most_prompts}")
    p = F.broadcast(prompts.select("prompt", unit("features").alias("__p")).agg(F.collect_list(F.struct("prompt", "__p")).alias("__all")))
    each = views.select("candidate", "view", unit("features").alias("__v")).crossJoin(p)  # one row on the right
    each = each.select("candidate", "view", "__v", F.inline("__all"))
    return each.select("candidate", "view", "prompt", dot("__v", "__p").alias("cosine"))


def ranked(scores: DataFrame, by: list[str], score: str = "cosine") -> DataFrame:
    """Adds rank: descending score, ties in the order of prompts."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), "prompt")))


def aggregate_ranking(scores: DataFrame) -> DataFrame:
    """candidate, prompt, mean score over views, rank."""
    return ranked(scores.groupBy("candidate", "prompt").agg(F.avg("cosine").alias("score")), ["candidate"], "score")


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.filter(F.col("rank") <= k)


def disagreement(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """candidate, best prompt over views, and the share of views whose best is another."""
    total = scores.groupBy("candidate", "prompt").agg(F.avg("cosine").alias("score"))
    if digits is not None:
        total = total.withColumn("score", F.round("score", digits))
    best = top(ranked(total, ["candidate"], "score"), 1).select("candidate", F.col("prompt").alias("top1"))
    views = top(ranked(scores, ["candidate", "view"]), 1).select("candidate", F.col("prompt").alias("view_top1"))
    joined = views.join(best, "candidate")
    return joined.groupBy("candidate", "top1").agg(F.avg((F.col("view_top1") != F.col("top1")).cast("double")).alias("disagreement"))


class EmbeddingProvider:
    """What turns views and prompts into features: a model of the user's own behind two methods. Both return arrays of one length."""

    def of_views(self, views: DataFrame) -> DataFrame:
        """candidate, view, features."""
        raise NotImplementedError

    def of_prompts(self, prompts: list[str]) -> DataFrame:
        """prompt, features."""
        raise NotImplementedError


def score_candidates(provider: EmbeddingProvider, views: DataFrame, prompts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores by view, the ranking over views, and the disagreement of views, with a provider's features."""
    scores = cosine_scores(provider.of_views(views), provider.of_prompts(prompts))
    return scores, aggregate_ranking(scores), disagreement(scores)
