"""The registered queries of this subpackage, each thin over its operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudstrata.llm import bpe, chat, codes, decontaminate, html_text, jaccard, language, licenses, neighbours, quality, search, token_store, toxicity
from cloudstrata.session import new_folder


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary: in CLOUDSTRATA_TOKENIZERS, or where the installed package has it."""
    folder = os.environ.get("CLOUDSTRATA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, 20)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_store(_table(spark, sf_dir, "documents"), new_folder(spark, "token-store"), vocabulary())
    return token_store.verify_store(spark, folder)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))]))
    )
    return chat.read_back(chat.format_chats(rows.unionByName(extra)), in_order=True)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.fit_languages(docs))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.LexicalIndex.write(_table(spark, sf_dir, "documents"), new_folder(spark, "lexical-index"))
    return index.search(_table(spark, sf_dir, "benchmark"), 20)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = codes.compress(_table(spark, sf_dir, "embeddings"))
    named = F.lit(None if books is None else codes.codebooks_sha256(books)).cast("string")
    return codes.label_errors(coded).select("vec_id", "code", "error", "label_error", named.alias("codebooks_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_main_text": op3_main_text,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_jaccard": op7_jaccard,
    "op8_token_store": op8_token_store,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_language": op11_language,
    "op12_search": op12_search,
    "op13_codes": op13_codes,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (n - shared)),
r AS (SELECT a AS i, b AS j FROM l UNION SELECT r.i, l.b FROM r JOIN l ON r.j = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(j) FROM r WHERE r.i = s.doc_id), doc_id)) AS component_id FROM s"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SEARCH = f"""WITH k AS (SELECT * FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM k),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM k) GROUP BY doc_id, n, term),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
p AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

_ASSIGN = "SELECT x.id, x.p, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, b.v)]), e := b.e)) AS m, any_value(x.v) AS v FROM x JOIN {book} b ON b.p = x.p GROUP BY x.id, x.p"
_UPDATE = """SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM (SELECT p, m.e AS e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c
FROM {assigned}, generate_series(1, 1024) g(i) WHERE i <= len(v) GROUP BY p, m.e, i) GROUP BY p, e) u ON u.p = b.p AND u.e = b.e"""
_CODES = f"""WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS v, len(embedding) // 16 AS w FROM embeddings
WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR isnan(c) OR isinf(c)]) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM k),
x AS (SELECT id, p, v[p * w + 1 : p * w + w] AS v FROM n, generate_series(0, 15) g(p)),
b0 AS (SELECT p, id AS e, v FROM x WHERE id < 64),
a1 AS ({_ASSIGN.format(book="b0")}), b1 AS ({_UPDATE.format(book="b0", assigned="a1")}),
a2 AS ({_ASSIGN.format(book="b1")}), b2 AS ({_UPDATE.format(book="b1", assigned="a2")}),
a3 AS ({_ASSIGN.format(book="b2")}),
c AS (SELECT id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a3 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN n USING (id), h"""

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op7_jaccard": _JACCARD, "op12_search": _SEARCH, "op13_codes": _CODES}
