"""Product codes against a plain version, and heaps against measuring everything."""

import hashlib

import duckdb
import numpy as np
import pytest

from cloudstrata.llm import codes, queries


def plain(rows, rounds=2, parts=16, entries=64):
    """vec_id, code, error, label_error and the digest of (id, vector, label) rows, without any bound."""
    kept = [(i, [int(np.floor(256 * c)) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    x = [cut(v) for _, v, _ in kept]
    books = [[v[p] for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assign():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [v[p] for v, o in zip(x, own, strict=True) if o[p][1] == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    own = assign()
    errors = [sum(d for d, _ in o) for o in own]
    by = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in o), e, by[y], digest) for (i, _, y), o, e in zip(kept, own, errors, strict=True)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def coded(df):
    out, books, measured = codes.compress(df)
    named = codes.codebooks_sha256(books) if books is not None else ""
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], named) for r in codes.label_errors(out).collect()), key=repr), books, measured


def test_query(spark, sf_dir):
    got = rows_of(queries.op13_codes(spark, sf_dir))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        assert got == plain(c.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall())
        assert got == sorted(c.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLES['op13_codes']})").fetchall(), key=repr)


@pytest.fixture
def made(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, code string, error int")

    return make


def test_cases(made, monkeypatch):
    monkeypatch.setattr(codes, "CHUNK", 37)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 32))
    rows = [(int(i), [float(c) for c in centres[i % 9] + 0.1 * rng.normal(size=32)], None if i % 5 == 0 else int(i % 3)) for i in range(400)]
    bad = [(1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [float("inf")] + [0.0] * 31, 1), (1003, [None] + [0.0] * 31, 1), (1004, [0.0] * 32, 2), (-9, [-0.001] * 32, 2), (5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[7][1], 0)]
    every = rows + bad
    assert coded(made(every).repartition(3))[0] == plain(every)
    odd = [(2000, [1.0] * 16, 1), (2001, [], 1)]  # of other dimensions
    assert coded(made(every + odd))[0] == plain(every)


def test_ties_and_few(made):
    equal = [(k, [0.5] * 16, 1) for k in range(70)]
    assert coded(made(equal))[0] == plain(equal)
    few = [(k, [float(k % 3)] * 16, None) for k in range(5)]
    assert coded(made(few))[0] == plain(few)
    one = [(1, [1e5] * 16, None)]
    assert coded(made(one))[0] == plain(one)
    assert coded(made([])) == ([], None, []) and coded(made([(1, None, 1)]))[0] == []


def test_errors(made):
    with pytest.raises(ValueError, match="16 parts"):
        codes.compress(made([(1, [1.0] * 17, 1)]))
    with pytest.raises(ValueError, match="or more"):
        codes.compress(made([(1, [float(1 << 20)] * 16, 1)]))


@pytest.mark.parametrize("seed", range(3))
def test_heaps(seed):
    """After every move of the entries, heaps hold each part at its nearest entry, and most parts weren't measured again."""
    rng = np.random.default_rng(seed)
    x = np.floor(256 * (rng.integers(0, 12, (1500, 16, 1)) + 0.05 * rng.normal(size=(1500, 16, 3)))).astype(np.int64)
    books = np.ascontiguousarray(x[:20].transpose(1, 0, 2))
    heaps, drift = codes.Heaps.empty(20), np.zeros((16, 20))
    total = np.zeros((16, 20, 4), np.int64)
    for step in range(6):
        moved, measured = codes.settle(x, books, heaps, drift)
        total += moved
        for p in range(16):
            own = heaps.assigned(p)
            assert (own == codes.squared_distances(x[:, p], books[p]).argmin(1)).all()
            ends = np.cumsum(heaps.sizes[p])
            assert all((np.diff(heaps.keys[p][e - n : e]) >= 0).all() for n, e in zip(heaps.sizes[p], ends, strict=True))
            assert (np.bincount(own, minlength=20) == total[p, :, 3]).all()
            assert (total[p, :, :3] == [x[own == k, p].sum(0) for k in range(20)]).all()
        assert measured == x.shape[0] * 16 if step == 0 else measured < x.shape[0] * 16
        after = books + rng.integers(-3, 4, books.shape)
        drift, books = drift + codes.drifts(books, after), after


def test_large_components():
    x, b = np.array([[1 << 28, -(1 << 28)]]), np.array([[0, 0], [1, (1 << 28) - 1]])
    assert codes.squared_distances(x, b).tolist() == [[2 << 56, ((1 << 28) - 1) ** 2 + ((1 << 29) - 1) ** 2]]


def test_decode():
    books = np.arange(16 * 64 * 2).reshape(16, 64, 2)
    assert (codes.decode("".join(f"{k:02x}" for k in range(16)), books) * 256 == np.concatenate([books[p, p] for p in range(16)])).all()
