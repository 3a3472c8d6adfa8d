"""Trees, isotonic fits, the random field, and the two classifiers on held-out rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.llm import quality, toxicity
from cloudstrata.llm.crf import LinearChainCrf
from cloudstrata.llm.trees import BoostedTrees, Isotonic


def test_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees().fit(x[:1000], y[:1000])
    assert ((trees.raw(x[1000:]) > 0) == y[1000:]).mean() > 0.9
    p = Isotonic().fit(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]))
    assert np.all(np.diff(p(np.linspace(-1, 7, 50))) >= 0) and 0 <= p(np.array([-5.0]))[0] <= p(np.array([9.0]))[0] <= 1
    assert np.isfinite(Isotonic().fit(np.zeros(0), np.zeros(0))(np.array([1.0]))).all()


def enumerate_chain(field, x):
    emit = x @ field.weights
    best, score = None, -np.inf
    total, p = -np.inf, np.zeros(emit.shape)
    for s in itertools.product(range(field.states), repeat=len(x)):
        v = field.ends[0, s[0]] + field.ends[1, s[-1]] + sum(emit[t, k] for t, k in enumerate(s)) + sum(field.moves[a, b] for a, b in zip(s, s[1:], strict=False))
        if v > score:
            best, score = s, v
        total = np.logaddexp(total, v)
        for t, k in enumerate(s):
            p[t, k] += np.exp(v)
    return best, p / np.exp(total)


def test_field_against_enumeration():
    r = np.random.default_rng(2)
    field = LinearChainCrf(3, 4)
    field.weights, field.moves, field.ends = r.normal(size=(4, 3)), r.normal(size=(3, 3)), r.normal(size=(2, 3))
    lengths = np.array([3, 0, 5, 1, 5])
    x = r.normal(size=(14, 4))
    p, s = field.marginals(x, lengths), field.viterbi(x, lengths)
    at = 0
    for n in lengths:
        if n:
            best, want = enumerate_chain(field, x[at : at + n])
            assert tuple(s[at : at + n]) == best and np.allclose(p[at : at + n], want)
        at += n


def test_field_learns_neighbours():
    r = np.random.default_rng(3)
    y = np.repeat(r.integers(0, 2, 300), 4)
    x = np.column_stack([np.ones(1200), y + r.normal(size=1200) * 0.7])
    lengths = np.full(60, 20)
    field = LinearChainCrf(2, 2).fit(x, y, lengths)
    assert (field.viterbi(x, lengths) == y).mean() > 0.8 and field.moves[0, 0] > field.moves[0, 1]


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def ranked_right(rows, target):
    """The share of pairs of a 1 and a 0 that the score puts in order."""
    one, two = [r["score"] for r in rows if r[target] == 1], [r["score"] for r in rows if r[target] == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in two])


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert ranked_right(rows, "toxic") > 0.85
    assert not [r for r in rows if r["predicted"] and not r["toxic"]]


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert ranked_right(rows, "quality") > 0.95
    assert not [r for r in rows if not r["predicted"] and r["quality"]]


def test_held_out_labels_are_never_read(spark, labelled):
    docs, labels = labelled
    for module, fit, target, modulus, out in ((toxicity, toxicity.fit_toxicity, "toxic", 3, 1), (quality, quality.fit_quality, "quality", 5, 0)):
        hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == out
        other = labels.withColumn(target, F.when(hidden, 1 - F.col(target)).otherwise(F.col(target)))
        score = module.score_toxicity if module is toxicity else module.score_quality
        few = docs.limit(40)
        assert score(few, fit(docs, labels)).collect() == score(few, fit(docs, other)).collect()


def test_odd_rows(docs_of, spark):
    texts = [None, "", " \n\n ", "", "You are an idiot. " * 2000, "a" * 100_000, "fine words stand here.\nAnd more."]
    docs = docs_of(texts, [1, 2, None, 3, 4, 5, 5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 1), (5, 1, 0), (5, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for rows in (toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect(), quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()):
            assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    for kept in (toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, none)), quality.drop_poor(docs, quality.fit_quality(docs, none))):
        assert kept.columns == docs.columns and kept.count() == len(texts)
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), none)).count() == 0


def test_line_marginals(labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    text = "The words are of a plain kind and stand in lines.\n\nAnd%%% these&&& have### signs&&& all%%% over$$$ them***"
    row = quality.label_lines(docs.limit(1).withColumn("text", F.lit(text)), model).first()
    assert len(row["good"]) == 2 and row["good"][0] > row["good"][1]
