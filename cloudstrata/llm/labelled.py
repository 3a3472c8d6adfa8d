"""Bounded samples of labelled rows, by the rules that keep held-out rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.session import cut


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves the remainder; a null id is held out of nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, kept, rows: int) -> DataFrame:
    """text, y, fold (0 to 9) and place (from 1, in the order of a hash of doc_id) of at most `rows` labelled documents, written to the shared folder.

    Labels of remainders that `kept` refuses are never read further. Which rows:
    those of the least hash of doc_id, so the choice doesn't depend on order.
    Several labels of one doc_id: the greatest; several texts: the least.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & kept(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus))
    known = known.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    total = known.count()
    if total > 4 * rows:  # hashes are even, so the least `rows` lie well within twice their share; what is beyond needn't be sorted
        known = known.filter(F.xxhash64("doc_id") <= F.lit(-(1 << 63) + int((1 << 64) * 2 * rows / total)))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids: a proven bound for the window and the broadcast
    known = known.withColumn("place", F.row_number().over(W.orderBy(F.xxhash64("doc_id"), "doc_id")).cast("long"))
    found = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "y", "place")), "doc_id")
    found = found.groupBy("doc_id", "y", "place").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return cut(found.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).cast("int").alias("fold"), "place"), "labelled")
