"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from cloudstrata.llm import jaccard


def brute(texts, ids):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(zip(ids, sets, strict=True))), key=repr)


def near_copies(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(r.choice(words) for _ in range(12))
    bases = [[r.choice(words) for _ in range(r.choice([6, 30, 90]))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w) if r.random() < 0.6 else common + "\n" + " ".join(w).upper())
    return out


@pytest.mark.parametrize("how", ["plain", "frequent", "blocks"])
def test_components(docs_of, monkeypatch, how):
    if how == "frequent":
        monkeypatch.setattr(jaccard, "FREQUENT", 3)
        monkeypatch.setattr(jaccard, "BLOCK", 500)
    if how == "blocks":
        monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 4)
        monkeypatch.setattr(jaccard, "FEW", 3)
    texts = [*near_copies(len(how)), None, "", " \n", "one two", "One  two", "a b c d e", "a b c d e"]
    ids = [*range(10, 10 + len(texts) - 2), None, 3]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs_of(texts, ids)).collect()), key=repr)
    assert got == brute(texts, ids)


def test_frequent_in_some_blocks_only(docs_of, monkeypatch):
    """Near copies some of which lie in blocks where their shingles are frequent, and some where they aren't."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    r = random.Random(3)
    base = [f"b{k}" for k in range(40)]
    texts = []
    for k in range(40):
        w = list(base)
        w[r.randrange(40)] = f"x{k}"
        texts.append(" ".join(w) if k % 3 == 0 or k < 14 else " ".join(f"o{k}-{j}" for j in range(60)))
    ids = [*range(len(texts))]
    got = sorted((tuple(x) for x in jaccard.jaccard_components(docs_of(texts, ids)).collect()), key=repr)
    assert got == brute(texts, ids)


def test_no_documents(docs_of):
    assert jaccard.jaccard_components(docs_of([])).count() == 0
    assert jaccard.jaccard_components(docs_of([None, ""])).count() == 2


def test_keep_one(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", "other words stand in here", None, "a b c d e f"], [5, 2, 7, 8, None])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "8"]


def test_keep_one_of_repeated_rows(docs_of):
    a, b, c = "a b c d e f", "other words stand in here now", "this text is there under no name at all"
    docs = docs_of([a, a, a, b, b, c, c, None, None, "", b + " x" * 60_000], [1, 1, None, 3, 3, None, None, 4, 4, None, 9])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:40]) for r in kept.collect()) == sorted([("1", a), ("3", b), ("None", c), ("4", ""), ("4", ""), ("None", ""), ("9", (b + " x" * 60)[:40])])
    one_id = docs_of([a, b, a + " g"], [5, 5, 5])  # different texts of one id, the first and last too far apart
    assert {r["text"] for r in jaccard.keep_one(one_id).collect()} == {a, b, a + " g"}


@pytest.mark.parametrize("few", [10])
def test_hot_keys(docs_of, monkeypatch, few):
    """A group of near copies that holds most rows, with salted joins."""
    from cloudstrata.functions import joins

    monkeypatch.setattr(joins, "FEW_ROWS", few)
    r = random.Random(5)
    base = [f"b{k}" for k in range(50)]
    texts = []
    for k in range(60):
        w = list(base)
        if k % 3:
            w[r.randrange(50)] = f"x{k}"
        texts.append(" ".join(w) if k % 6 else " ".join(f"o{k}-{j}" for j in range(20)))
    ids = [*range(len(texts))]
    got = sorted((tuple(x) for x in jaccard.jaccard_components(docs_of(texts, ids)).collect()), key=repr)
    assert got == brute(texts, ids)


def test_filters_never_lose_a_pair():
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.choice(2**40, 80, replace=False).astype(np.uint64)
        x, y = np.sort(r.choice(pool, r.integers(1, 70), replace=False)), np.sort(r.choice(pool, r.integers(1, 70), replace=False))
        both = len(np.intersect1d(x, y))
        assert jaccard.overlap(x, y) == both <= jaccard.suffix_bound(x, y)
        assert (100 * both >= 80 * (len(x) + len(y) - both)) == (both >= jaccard.needed(len(x), len(y)))
