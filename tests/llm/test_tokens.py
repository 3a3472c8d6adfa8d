"""BPE and the token store against the library, crc32 and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cloudstrata.llm import bpe, token_store
from cloudstrata.session import new_folder

PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "中", "1", "23", "'s", "'ll", "<|endoftext|>", "\xa0", " ", "\x1c", "\x85", "​", "!", "...", "😀", "́", "Ⅷ", "½", "\r\n", "\0", "<|", "|>", "_", "x" * 70]


def texts(seed=1, n=3000):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", " ", "  a", "a  "]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def test_same_ids_as_the_library(vocabulary, library):
    own = bpe.BpeCodec(vocabulary)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), t


def test_small_caches_change_nothing(vocabulary, library):
    own = bpe.BpeCodec(vocabulary)
    own.words.entries = own.pieces.entries = 3
    for t in texts(2, 300):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_one_very_long_word(vocabulary, library):
    own, t = bpe.BpeCodec(vocabulary), "ab" * 30_000
    assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_library_encoder(vocabulary, library):
    some = [None, *texts(3)]
    ids, ends = token_store.LibraryEncoder(vocabulary).encode(pa.array(some, pa.string()))
    for t, b, e in zip(some, ends, ends[1:], strict=False):
        assert ids[b:e].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_library_encoder_forgets(vocabulary, library):
    encoder = token_store.LibraryEncoder(vocabulary, 40)
    r = random.Random(4)
    for _ in range(30):
        t = " ".join("".join(r.choice("abcdeé") for _ in range(5)) + r.choice(["", ",", "!"]) for _ in range(20))
        assert encoder.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(encoder.words) <= 60


def test_library_encoder_puts_pieces_together(vocabulary, library):
    words, marks = ["", "word", "Ab", "it", "s", "ll", "é", "x\u0301"], ["", "'", "''", ".'", "\n", "\n\n", ".\n", "'\n", "1.", "<|", "..\n", "***"]
    some = [f"q {a}{m}{b}{n}{c} end" for a in words for m in marks for b in words for n in marks for c in ["", "s"]] + ["a b<|endoftext|>c d", "b<|endoftext|>c\x00", "\nA b", "'s a"]
    some += [t[2:] for t in some]
    ids, ends = token_store.LibraryEncoder(vocabulary).encode(pa.array(some))
    for t, e, b, c in zip(some, library.encode_batch(some, add_special_tokens=False), ends, ends[1:], strict=False):
        assert ids[b:c].tolist() == e.ids, t


def test_words_with_marks_go_to_the_library_by_parts(vocabulary, monkeypatch):
    encoder, sent = token_store.LibraryEncoder(vocabulary), []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda some: sent.extend(some) or whole(some))
    r = random.Random(8)
    for _ in range(3):
        encoder.encode(pa.array([" ".join("".join(r.choice("abcdeé") for _ in range(8)) + r.choice(["***", ".\nThen", "?!", "-", ""]) for _ in range(900))]))
    assert len(sent) < 20  # before: a piece of its own for each word with marks, about 2,000


def test_encode_documents(docs_of, vocabulary, library):
    some = [None, "", "Hello there.\nYou", "x " * 5000, "Hello there.\nYou"]
    rows = bpe.encode_documents(docs_of(some, [4, 3, None, 2, 4]), vocabulary, tuple(bpe.OUTPUTS)).collect()
    assert len(rows) == 5
    for t, r in zip(some, rows, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs_of([]), vocabulary).count() == 0


def test_crc32_join():
    r = random.Random(5)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 40)), r.randbytes(r.randint(0, 40))
        assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_depend_on_nearby_ids_only():
    r = np.random.default_rng(6)
    shared = r.integers(0, 50_000, 20_000).astype(np.uint16)
    a = token_store.cuts(shared)
    b = [c - 777 for c in token_store.cuts(np.concatenate([r.integers(0, 50_000, 777).astype(np.uint16), shared]))]
    assert a[-1] == len(shared) and all(0 < e - s <= token_store.MOST for s, e in zip([0, *a], a, strict=False))
    assert len({*a} & {*b}) > 0.9 * len(a)


def test_store_round_trip(spark, docs_of, vocabulary, library):
    r = random.Random(7)
    long = " ".join(r.choice(["alpha", "beta", "gamma,", "delta"]) for _ in range(9000))
    some = [long, None, "", "Hello", long, "Hello"]
    ids = [9, 2, None, 7, 1, 7]
    folder = token_store.write_store(docs_of(some, ids), new_folder(spark, "test-store"), vocabulary)
    got = sorted(token_store.verify_store(spark, folder).collect(), key=lambda x: x["start"])
    order = sorted(range(6), key=lambda k: (ids[k] is not None, ids[k] or 0))
    start = 0
    for k, row in zip(order, got, strict=True):
        whole = [*library.encode(some[k] or "", add_special_tokens=False).ids, 0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"], row["intact"]) == (ids[k], start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()), True)
        start += len(whole)
    chunks = token_store.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    back = {x["start"]: x["ids"] for x in token_store.read_ids(spark, folder).collect()}
    assert sum(map(len, back.values())) == start
    assert spark.read.parquet(f"{folder}/manifest").groupBy().sum("documents", "tokens").first()[:] == (6, start)


def test_empty_store(spark, docs_of, vocabulary):
    folder = token_store.write_store(docs_of([]), new_folder(spark, "test-store"), vocabulary)
    assert token_store.verify_store(spark, folder).count() == 0
