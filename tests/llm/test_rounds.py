"""Hash ranges of the Jaccard join in rounds, and shuffle files that go with the query they were made for."""

import os
import time

from cloudstrata import session
from cloudstrata.llm import jaccard


def test_rounds_of_ranges(spark, monkeypatch):
    """Several rounds give what one gives, also for shingles that are frequent in a block."""
    monkeypatch.setattr(jaccard, "FREQUENT", 20)
    texts = [" ".join(f"w{(k * 7 + j) % 90}" for j in range(40 + k % 3)) for k in range(60)] + ["a few words of text that all share"] * 30 + ["", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(jaccard.jaccard_components(docs).collect())
    turns, plain = [], jaccard._shred
    monkeypatch.setattr(jaccard, "_shred", lambda words, bits, turn=0, rounds=1: turns.append((turn, rounds)) or plain(words, bits, turn, rounds))
    monkeypatch.setattr(jaccard, "RANGE_BYTES", 1000)
    assert sorted(jaccard.jaccard_components(docs).collect()) == one
    assert turns == [(0, 3), (1, 3), (2, 3)]


def test_shuffle_files_go(spark):
    """A cut leaves no shuffle files behind, and the session's setting as it was."""
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, setting = held(), spark.conf.get(session.CLEANED, None)
    session.cut(spark.range(5000).repartition(4, "id"), "test")
    until = time.monotonic() + 20
    while not held() <= before and time.monotonic() < until:
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(session.CLEANED, None) == setting
