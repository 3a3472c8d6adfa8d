"""Lexical search against scoring every document, and blocks against every way of cutting."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cloudstrata.llm import queries, search
from cloudstrata.session import new_folder

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """item, rank, doc and score of (id, text) pairs."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, df = sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * len(counted) // total
            score = sum(n * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query(spark, sf_dir):
    got = rows(queries.op12_search(spark, sf_dir))
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        assert got == sorted(c.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op12_search']})").fetchall(), key=repr)
        assert got == brute(c.execute("SELECT doc_id, text FROM documents").fetchall(), c.execute("SELECT item_id, text FROM benchmark").fetchall(), 20)


def test_terms():
    for text in ("Ab-c 9É_é\x00ß　 x\x7fy", "", None, "...", "ÀB İ straße ²"):
        assert [t.decode() for t in search.terms_of(text)] == terms(text)


@pytest.mark.parametrize("seed", range(3))
def test_shards_and_ties(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(30)] + ["É", "x1"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(200, texts[0]), (200, texts[0]), (None, texts[0]), (None, texts[1]), (201, None), (202, ""), (203, "..."), (204, "w1 " * 5_000), (-5, texts[0].upper())]
    items = [(k, " ".join(rng.choice(words, 6))) for k in range(12)] + [(50, None), (51, "- -"), (52, "unseen"), (None, "w1 w2"), (53, texts[0] + " w1 w1")]
    monkeypatch.setattr(search, "QUERIES", 5)
    monkeypatch.setattr(search, "PIVOTS", 7)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, shard int").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in [*items, items[0]]], "item_id long, text string, block int")
    for size in (100, 10**9):
        index = search.LexicalIndex.write(frame, new_folder(spark, "lexical-index"), shard_terms=size)
        assert rows(index.search(asked, 5)) == brute(docs, items, 5)


def test_text_ids_and_empty_tables(spark):
    index = search.LexicalIndex.write(spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string"), new_folder(spark, "lexical-index"))
    asked = spark.createDataFrame([("q", "two"), ("q", "zzz")], "item_id string, text string")
    assert [r[2] for r in rows(index.search(asked, 20))] == ["a", "b", None]
    none = spark.createDataFrame([], "item_id string, text string")
    assert rows(index.search(none, 20)) == []
    empty = search.LexicalIndex.write(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), new_folder(spark, "lexical-index"))
    assert rows(empty.search(asked, 20)) == []
    assert rows(search.LexicalIndex.write(spark.createDataFrame([], "doc_id long, text string"), new_folder(spark, "lexical-index")).search(asked, 20)) == []


def least_cost(s, longest, cost):
    best = [0] + [math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            best[j] = min(best[j], best[i] + sum(max(s[i:j]) - v for v in s[i:j]) + cost)
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_the_best(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 25)
    scores = rng.integers(1, 1000, lengths.sum())
    piece, longest, cost = 40, 9, int(rng.integers(50, 2000))
    ends = search.block_ends(scores, lengths, piece, longest, cost)
    at = 0
    for n in lengths.tolist():
        s, e = scores[at : at + n], ends[at : at + n]
        assert e[-1]
        got, begin = 0, 0
        for j in np.flatnonzero(e).tolist():
            assert j + 1 - begin <= longest
            got += int((s[begin : j + 1].max() - s[begin : j + 1]).sum()) + cost
            begin = j + 1
        assert got == sum(least_cost(s[b : b + piece].tolist(), longest, cost) for b in range(0, n, piece))
        at += n


def test_skipping_is_exact():
    rng = np.random.default_rng(9)
    for _ in range(30):
        lists, total = [], np.zeros(3000, np.int64)
        for _ in range(8):
            documents = np.sort(rng.choice(3000, rng.integers(1, 2000), replace=False)).astype(np.int32)
            scores = rng.integers(1, 500, len(documents)).astype(np.int32)
            ends = np.flatnonzero(search.block_ends(scores, np.array([len(documents)]), cost=300)) + 1
            tops = np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]]))
            w = int(rng.integers(0, 50))
            lists.append((w, search.PostingList(documents, scores, ends, tops)))
            total[documents] += w * scores.astype(np.int64)
        best, score = search.top_documents(lists, 3000, 10)
        order = np.lexsort((np.arange(3000), -total))[:10]
        order = order[total[order] > 0]
        assert best.tolist() == order.tolist() and score.tolist() == total[order].tolist()
