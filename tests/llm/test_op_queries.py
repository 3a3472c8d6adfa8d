"""The registered queries over whole tables, against brute force."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from cloudstrata.llm import queries
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def rows_of(sf_dir):
    return lambda name: duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").to_df().to_dict("records")


@pytest.mark.parametrize(("name", "modulus", "out", "least"), [("op1_toxicity", 3, 1, 0.7), ("op9_quality", 5, 0, 0.3)])
def test_scores(spark, sf_dir, rows_of, name, modulus, out, least):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert set(got) == {d["doc_id"] for d in rows_of("documents")}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_neighbours(spark, sf_dir, rows_of):
    rows = rows_of("embeddings")
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict[int, list] = {}
    for r in queries.op2_neighbours(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        found = sorted(got[ids[k]])
        assert [a for a, _ in found] == list(range(1, 21))
        hit += len({b for _, b in found} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_main_text(spark, sf_dir, rows_of):
    got = {r["page_id"]: r for r in queries.op3_main_text(spark, sf_dir).collect()}
    for p in rows_of("pages"):
        inner = p["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])


def test_tokens(spark, sf_dir, rows_of, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    ids = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids for d in rows_of("documents")}
    for r in queries.op4_bpe(spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        decoded = library.decode(own, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    stored = {r["doc_id"]: r for r in queries.op8_token_store(spark, sf_dir).collect()}
    start = 0
    for i in sorted(ids):
        whole = [*ids[i], 0]
        assert (stored[i]["start"], stored[i]["n_tokens"], stored[i]["ids_crc32"], stored[i]["intact"]) == (start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()), True)
        start += len(whole)


def test_contamination(spark, sf_dir, rows_of):
    items = {b["item_id"]: b["text"] for b in rows_of("benchmark")}
    want = {(d["doc_id"], i) for d in rows_of("documents") for i, t in items.items() if t in (d["text"] or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, sf_dir).collect()}


def test_licenses(spark, sf_dir, rows_of):
    want = {d["doc_id"] for d in rows_of("documents") if re.search("licensed under|released under the mit", d["text"] or "", re.I)}
    assert {r["doc_id"] for r in queries.op6_licenses(spark, sf_dir).collect()} == want


def test_jaccard(spark, sf_dir, rows_of):
    docs = rows_of("documents")
    got = sorted((tuple(r)[:3] for r in queries.op7_jaccard(spark, sf_dir).collect()), key=repr)
    assert got == brute([d["text"] for d in docs], [d["doc_id"] for d in docs])
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert sorted(c.execute(queries.ORACLES["op7_jaccard"]).fetchall(), key=repr) == got


def test_chats(spark, sf_dir, rows_of):
    talks: dict[int, list] = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in rows_of("conversations"):
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, sf_dir).collect()}
    assert set(got) == set(talks)
    for i, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (got[i]["n_turns"], got[i]["loss_chars"]) == (len(turns), len(loss))
        assert (got[i]["turns_sha256"], got[i]["loss_sha256"]) == tuple(hashlib.sha256(v.encode()).hexdigest() for v in (whole, loss))
