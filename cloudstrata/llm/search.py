"""Ranked lexical search: an index of shards with variable blocks, searched by block-max WAND.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters of a
text, with A-Z lower-cased. Tasks that read documents cut them into shards of about
SHARD_TERMS terms. A shard holds, for each of its terms, the documents with the term in
ascending order and what the term adds to their scores, without its weight. Dynamic programming
cuts each such list into blocks of at most LONGEST postings: over all ways of cutting
a run of PIECE postings, the sum of what block maxima exceed their postings by, and
BLOCK_COST for each block, is least.

A query is searched shard by shard. The maxima of the blocks that cover a document,
times the weights, bound its score, and change only where a block begins or ends. The
documents of the greatest bounds give a first threshold; then pivots, the next
documents whose bounds reach the threshold, are taken in order, and what lies between is skipped. The
threshold is that of the best k so far, so results are exact. The best k of
each shard are ranked together.

With N documents that have a term, L terms of all documents and n of this one, df
documents with the term and tf occurrences here, a term adds
w * (1000000000 tf div (1000 tf + 12 m)), w = floor(1000 ln((2N + 2) / (2df + 1))),
m = 75 + (25 n N div L), as often as the query has it; N, L and df are counted over all documents.

Null and empty texts have no terms and are found by nothing; queries without terms find nothing. Texts
are taken whole, at any length; a document longer than a shard is one by itself. Repeated rows are
documents each; equal scores are ordered by doc_id, null last. Of queries with one id that with the least text counts.
Empty tables give no rows. Columns of other names aren't read, so they may be called anything. Ids may be of any type that has an order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc
from cloudstrata.session import cut

#: Terms of a shard, from which it is closed; postings that blocks are chosen among at a time; the longest block; the cost of a block, in units of a term's part of a score.
SHARD_TERMS, PIECE, LONGEST, BLOCK_COST = 4_000_000, 256, 64, 1_000_000
#: Queries that are searched together; terms of queries up to which they are sent to all tasks; pivots that are scored at a time; documents of the greatest bounds that give the first threshold, times k.
QUERIES, FEW_TERMS, PIVOTS, PROBES = 1024, 200_000, 1024, 4

#: Keeps bytes of terms, lower-cases A-Z, and makes all others spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def block_ends(scores: np.ndarray, lengths: np.ndarray, piece: int = PIECE, longest: int = LONGEST, cost: int = BLOCK_COST) -> np.ndarray:
    """Whether each posting ends a block. scores: lists one after another; lengths: of the lists."""
    out = np.zeros(len(scores), bool)
    first = np.cumsum(lengths) - lengths
    parts = -(-lengths // piece)
    begin = np.repeat(first, parts) + piece * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(piece, np.repeat(first + lengths, parts) - begin)
    out[begin[size == 1]] = True
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size > 1)]
    at = 0
    while at < len(order):  # pieces of like sizes are cut together, a row each
        wide = int(size[order[at]])
        rows = order[at : at + max(1, 400_000 // wide)]
        at += len(rows)
        n, b = size[rows], begin[rows]
        inner = np.arange(wide) < n[:, None]
        s = np.zeros((len(rows), wide), np.int64)
        s[inner] = scores[(b[:, None] + np.arange(wide))[inner]]
        top = s.copy()  # top[:, i] is the greatest from i to where the block would end
        best = np.zeros((len(rows), wide + 1), np.int64)
        back = np.zeros((len(rows), wide + 1), np.int32)
        for j in range(1, wide + 1):
            low = max(0, j - longest)
            np.maximum(top[:, low:j], s[:, j - 1 : j], out=top[:, low:j])
            total = top[:, low:j] * np.arange(j - low, 0, -1) + best[:, low:j]
            back[:, j] = total.argmin(1)
            best[:, j] = np.take_along_axis(total, back[:, j : j + 1].astype(np.int64), 1)[:, 0] + cost
            back[:, j] += low
        end, row = n.copy(), np.arange(len(rows))
        while len(row):
            out[b[row] + end[row] - 1] = True
            end[row] = back[row, end[row]]
            row = row[end[row] > 0]
    return out


class _Shard:
    """Documents of one task until they are enough, then their postings."""

    def __init__(self, documents: int, terms: int, id_type: pa.DataType):
        self.documents, self.terms, self.id_type = documents, terms, id_type
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, name, text: str | None) -> None:
        words = terms_of(text)
        if words:
            numbers = self.numbers
            for w in set(words).difference(numbers):
                numbers[w] = len(numbers)
            self.ids.append(name)
            self.tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def close(self, number: int) -> Iterator[pa.RecordBatch]:
        """Rows of the shard: a row of ids, and one of postings for each term, in the order of terms."""
        if not self.ids:
            return
        ids = pa.array(self.ids, self.id_type)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()  # numbers of documents follow their ids
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        size = np.array([len(t) for t in self.tokens], np.int64)
        key, tf = np.unique(rank[np.concatenate(self.tokens)] * len(order) + np.repeat(place, size), return_counts=True)
        term, document = np.divmod(key, len(order))
        m = np.empty(len(order), np.int64)
        m[place] = [75 + 25 * n * self.documents // self.terms for n in size.tolist()]
        score = 1_000_000_000 * tf // (1000 * tf + 12 * m[document])
        df = np.bincount(term, minlength=len(names))
        ends = np.flatnonzero(block_ends(score, df))
        tops = np.maximum.reduceat(score, np.concatenate([[0], ends[:-1] + 1]))
        blocks = np.bincount(term[ends], minlength=len(names))
        first = np.cumsum(df) - df
        within = ends + 1 - first[term[ends]]  # where each block ends in its own list
        none = pa.nulls(1, pa.binary())
        yield _rows(pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([0], pa.int32()), none, none, none, none, pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(self.id_type)))
        cells = [_cells(document, df), _cells(score, df), _cells(within, blocks), _cells(tops, blocks)]
        whole = _rows(pa.array(np.full(len(names), number), pa.int64()), pa.array([w.decode() for w in names], pa.string()), pa.array(df, pa.int32()), *cells, pa.nulls(len(names), pa.list_(self.id_type)))
        for at in range(0, len(names), 20_000):
            yield whole.slice(at, 20_000)


def _cells(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary cell of 32-bit numbers for each length."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.astype(np.int32))]).cast(pa.binary())


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["shard", "term", "df", "documents", "scores", "ends", "tops", "ids"])


class LexicalIndex:
    """An index in a folder: its postings, N documents with terms, and L terms in all."""

    def __init__(self, postings: DataFrame, documents: int, terms: int):
        self.postings, self.documents, self.terms = postings, documents, terms

    @staticmethod
    def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> LexicalIndex:
        """Indexes every document; the folder must be new and shared by all executors."""
        from pyspark.sql.pandas.types import to_arrow_type

        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [len(terms_of(t)) for b in batches for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(v > 0 for v in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["documents", "terms"])

        spark = docs.sparkSession
        rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).write.parquet(f"{folder}/counts")
        counts = spark.read.parquet(f"{folder}/counts").first()
        n_documents, n_terms, id_type = counts["documents"], counts["terms"], to_arrow_type(rows.schema["id"].dataType)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with calm_gc():
                shard, number = _Shard(n_documents, n_terms, id_type), TaskContext.get().partitionId() << 32
                for batch in batches:
                    for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        shard.add(name, text)
                        if shard.size >= shard_terms:
                            yield from shard.close(number)
                            shard.clear()
                            number += 1
                yield from shard.close(number)

        kind = rows.schema["id"].dataType.simpleString()
        rows.mapInArrow(build, f"shard long, term string, df int, documents binary, scores binary, ends binary, tops binary, ids array<{kind}>").write.parquet(f"{folder}/postings")
        return LexicalIndex.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> LexicalIndex:
        counts = spark.read.parquet(f"{folder}/counts").first()
        return LexicalIndex(spark.read.parquet(f"{folder}/postings"), counts["documents"], counts["terms"])

    def search(self, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """The query's id, rank, doc_id and score of the k best documents of each query with a score above 0."""
        one = queries.groupBy(F.col(id_col).alias("item")).agg(F.min(text_col).alias("text"))
        parts = -(-one.count() // QUERIES)
        asked = cut(one.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, parts))).cast("int")), "search-queries")
        wanted = cut(asked.select("block", "text").mapInArrow(_query_terms, "block int, term string").distinct(), "search-terms")
        few = F.broadcast if wanted.count() <= FEW_TERMS else lambda df: df
        lists = self.postings.filter("term is not null")
        df = lists.select("term", "df").join(few(wanted.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = cut(wanted.join(df, "term").select("block", "term", weight.alias("weight")), "search-weights")
        lists = lists.join(few(weights), "term").select("shard", "block", "term", "weight", "documents", "scores", "ends", "tops")
        blocks = asked.groupBy("block").agg(F.collect_list(F.struct("item", "text")).alias("items"))  # about QUERIES rows each
        shards = self.postings.filter("term is null").select(F.col("shard").alias("of"), "ids").crossJoin(blocks)  # every shard is asked everything
        kinds = (dict(asked.dtypes)["item"], dict(self.postings.dtypes)["ids"].removeprefix("array<").removesuffix(">"))
        run = _searcher(k)
        found = lists.groupBy("shard", "block").cogroup(shards.groupBy("of", "block")).applyInArrow(run, f"item {kinds[0]}, doc_id {kinds[1]}, score long")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))  # k rows of each shard
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and term of queries."""
    for batch in batches:
        terms = {(b, w) for b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in terms_of(t)}
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in terms], pa.int32()), pa.array([w.decode() for _, w in terms], pa.string())], names=["block", "term"])


class PostingList:
    """A term's documents in a shard and its parts of their scores; firsts, lasts and tops of its blocks."""

    def __init__(self, documents: np.ndarray, scores: np.ndarray, ends: np.ndarray, tops: np.ndarray):
        self.documents, self.scores, self.tops = documents, scores.astype(np.int64), tops.astype(np.int64)
        self.firsts, self.lasts = documents[np.concatenate([[0], ends[:-1]])], documents[ends - 1]


def top_documents(lists: list[tuple[int, PostingList]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents with a score above 0, best first, ties by number, of lists with their weights."""
    lists = [(w, p) for w, p in lists if w > 0]
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    # what block maxima add up to, document by document: it changes at firsts and after lasts only
    step = np.zeros(documents + 1, np.int64)
    tops = np.concatenate([w * p.tops for w, p in lists])
    np.add.at(step, np.concatenate([p.firsts for _, p in lists]), tops)
    np.subtract.at(step, np.concatenate([p.lasts for _, p in lists]) + 1, tops)
    bound = np.cumsum(step[:-1])

    def exact(wanted: np.ndarray) -> np.ndarray:
        """Scores of documents, in ascending order."""
        total = np.zeros(len(wanted), np.int64)
        low, high = wanted[0], wanted[-1]
        place = None
        for w, p in lists:
            a, b = np.searchsorted(p.documents, (low, high + 1))
            if b - a > 8 * len(wanted):  # few of these postings are wanted
                at = a + np.searchsorted(p.documents[a:b], wanted)
                at[at == b] = a
                hit = p.documents[at] == wanted
                total[hit] += w * p.scores[at[hit]]
            elif a < b:
                if place is None:
                    place = np.full(high - low + 1, -1, np.int64)
                    place[wanted - low] = np.arange(len(wanted))
                at = place[p.documents[a:b] - low]
                total[at[at >= 0]] += w * p.scores[a:b][at >= 0]
        return total

    threshold = 1
    if documents > k:
        probes = min(PROBES * k, documents)
        probe = np.sort(np.argpartition(-bound, probes - 1)[:probes])
        threshold = max(1, int(np.partition(exact(probe), probes - k)[probes - k]))
    best, score = none, none
    pivots = np.flatnonzero(bound >= threshold)
    while len(pivots):
        now = pivots[:PIVOTS]
        got = exact(now)
        best, score = np.concatenate([best, now[got >= threshold]]), np.concatenate([score, got[got >= threshold]])
        order = np.lexsort((best, -score))[:k]
        best, score = best[order], score[order]
        if len(score) == k:
            threshold = max(threshold, int(score[-1]))
        pivots = pivots[PIVOTS:]
        pivots = pivots[bound[pivots] >= threshold]
    return best, score


def _searcher(k: int):
    numbers = lambda cell: np.frombuffer(cell, np.int32)

    def run(lists: pa.Table, shard: pa.Table) -> pa.Table:
        known = {}
        for r in lists.select(["term", "weight", "documents", "scores", "ends", "tops"]).to_pylist():
            known[r["term"].encode()] = (r["weight"], PostingList(*(numbers(r[c]) for c in ("documents", "scores", "ends", "tops"))))
        own, names = shard.column("items").combine_chunks().flatten(), shard.column("ids").combine_chunks().flatten()  # one row, or none
        item, documents, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, text in enumerate(own.field("text").to_pylist()):
            counts = Counter(terms_of(text))
            found, score = top_documents([(n * known[t][0], known[t][1]) for t, n in counts.items() if t in known], len(names), k)
            item.append(np.full(len(found), at))
            documents.append(found)
            scores.append(score)
        item, documents, scores = map(np.concatenate, (item, documents, scores))
        return pa.table({"item": own.field("item").take(pa.array(item)), "doc_id": names.take(pa.array(documents)), "score": pa.array(scores)})

    return run
