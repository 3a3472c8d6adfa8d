"""Language ID by word-first backoff.

A word that was learned is scored by the logarithm of its relative frequency in
each language. One that wasn't falls back to its character n-grams, with a space
at both ends: the longest of GRAMS letters first, and shorter ones while no n-gram
of a length is known; its score is the mean over the known n-grams of that length.
A text's score in a language is the sum over its words (runs of letters, lower-cased,
in composed form), repeats included; `score` is the share of the best language when these
sums are taken as log probabilities. A word without any known n-gram says nothing.

Learned from at most SAMPLE documents with a text and a lang, about as many of each language,
those of the least hash of doc_id: their words are counted whole by Spark, and the
most frequent WORDS words and GRAM_ROWS n-grams of each length are kept, fewer
where many languages would make the table larger than CELLS numbers. Languages
are whatever values lang has; more than LANGUAGES of them raise ValueError. Rows whose
crc32(doc_id as text) mod 4 is 2 are never learned from, nor are rows with a null id.

A null text, or one without a letter, gets `und` with score 0; so does every text
where nothing could be learned. Texts are read whole, at any length. Equal texts get equal results,
whatever their id, order or other columns, which aren't read; ties go to the language with more
documents, then to the first name. Repeated rows are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc
from cloudstrata.llm.labelled import held_out
from cloudstrata.session import cut

#: Documents that are learned from, languages, words and n-grams of each length at most; numbers in the table at most; the longest n-grams; what is added to each count.
SAMPLE, LANGUAGES, WORDS, GRAM_ROWS, CELLS, GRAMS, ADDED = 16_000, 256, 100_000, 30_000, 16_000_000, 5, 0.5
#: Words longer than this are scored by n-grams only; words that a worker remembers; words of a text that are summed at a time; the language of texts that have none.
LONG, REMEMBERED, PIECE, NONE = 48, 400_000, 20_000, "und"

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of word characters without digits, lower-cased, in composed form. Those with other signs than letters are cleaned by `letters`."""
    if not text:
        return []
    return _RUNS.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower()))


def letters(word: str) -> str:
    """The letters of a run; numerals such as ½ belong to runs, too."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word with a space at both ends."""
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class LanguageModel:
    """languages, and for words and n-grams the logarithms of their relative frequencies in each."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]], totals: np.ndarray):
        """words and grams hold counts by language; grams by length, from 1. totals: for words, then each length, all counts by language."""
        self.languages = languages
        logs = lambda table, total: {k: np.log((v + ADDED) / (total + ADDED * (len(table) + 1))).astype(np.float32) for k, v in table.items()}
        self.words = logs(words, totals[0])
        self.grams = [logs(g, t) for g, t in zip(grams, totals[1:], strict=True)]

    def of_word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a run by language; None if it has no letter."""
        word = letters(word)
        if not word:
            return None
        known = self.words.get(word)
        if known is not None:
            return known.astype(float)
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            found = [v for g in grams_of(word, n) if g.strip() and (v := table.get(g)) is not None]
            if found:
                return np.mean(np.array(found, float), axis=0)
        return np.zeros(len(self.languages))


class Judge(dict):
    """Rows of a table of log frequencies by run; begins anew between pieces of a text when it remembers too many. Row 0: no letter."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.table = model, np.zeros((1024, len(model.languages)))
        self.used = 1

    def __missing__(self, run: str) -> int:
        value = self.model.of_word(run)
        if value is None:
            self[run] = 0
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = value
        self[run] = self.used
        self.used += 1
        return self.used - 1

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and its share."""
        languages = self.model.languages
        if not languages:
            return NONE, 0.0
        total, any_letter, runs = np.zeros(len(languages)), False, words_of(text)
        for at in range(0, len(runs), PIECE):
            piece = runs[at : at + PIECE]
            rows = np.fromiter(map(self.__getitem__, piece), np.int64, len(piece))
            any_letter = any_letter or bool(rows.any())
            total += self.table[rows].sum(0)
            if len(self) > REMEMBERED or self.used > 2 * REMEMBERED:
                self.clear()
                self.used = 1
        if not any_letter:
            return NONE, 0.0
        best = int(total.argmax())
        return languages[best], float(1 / np.exp(total - total[best]).sum())


def _sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame | None, list[str]]:
    """lang and text of the learned documents, and the languages, most documents first. One row of each doc_id counts: that of the least lang and text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(id_col="id", modulus=4, remainder=2))
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None, []
    each = max(1, rows // len(sizes))
    # hashes are even, so the least `each` of a language lie well within twice their share; only these rows are shuffled
    reach = {r["lang"]: -(1 << 63) + int((1 << 64) * 2 * each / r["count"]) for r in sizes if r["count"] > 4 * each}
    h = F.xxhash64("id")
    if reach:
        limit = F.create_map(*[F.lit(v) for k, n in reach.items() for v in (k, n)])[F.col("lang")]
        own = own.filter(limit.isNull() | (h <= limit))
    one = cut(own.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select(h.alias("h"), "r.*"), "languages")
    found: dict[str, list[int]] = {}
    for r in one.select("lang", "h").collect():  # four numbers for each of `rows` at most
        found.setdefault(r["lang"], []).append(r["h"])
    last = {v: sorted(hashes)[each - 1] for v, hashes in found.items() if len(hashes) > each}
    if last:
        limit = F.create_map(*[F.lit(v) for k, n in last.items() for v in (k, n)])[F.col("lang")]
        one = one.filter(limit.isNull() | (F.col("h") <= limit))
    return one.select("lang", "text"), [r["lang"] for r in sizes]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and n: words of LONG letters at most, added up within the task while it has room."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = [*held]
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run, n in Counter(words_of(text)).items():
                word = letters(run)
                if 0 < len(word) <= LONG:
                    held[lang, word] += n
            if len(held) > REMEMBERED:
                yield out()
    if held:
        yield out()


def fit_languages(docs: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of at most `rows` documents (one of each language, if there are more languages); the same for the same rows, whatever their order and partitions."""
    sample, languages = _sample(docs, rows, id_col, text_col, lang_col)
    if sample is None:
        return LanguageModel([], {}, [], np.zeros((1, 0)))
    number = {v: k for k, v in enumerate(languages)}
    counts = cut(sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = [
        counts.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda k, n=n: F.substring(padded, k, F.lit(n)))).alias("gram")).filter((F.length("gram") == n) & (F.trim("gram") != ""))
        for n in range(1, GRAMS + 1)
    ]
    every = counts.select("lang", "n", F.lit(0).alias("kind"), F.col("word").alias("gram"))
    for n, g in enumerate(grams, 1):
        every = every.unionByName(g.select("lang", "n", F.lit(n).alias("kind"), "gram"))
    every = cut(every.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")), "language-grams")
    totals = np.zeros((GRAMS + 1, len(languages)))
    for r in every.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect():  # GRAMS + 1 rows for each language
        totals[r["kind"], number[r["lang"]]] = r["n"]
    kept: list[dict[str, np.ndarray]] = []
    for kind in range(GRAMS + 1):
        most = max(1, min(WORDS if kind == 0 else GRAM_ROWS, CELLS // (2 * len(languages) * (1 if kind == 0 else GRAMS))))
        by_gram = every.filter(F.col("kind") == kind).groupBy("gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).filter("total > 1")
        table: dict[str, np.ndarray] = {}
        for r in by_gram.orderBy(F.desc("total"), "gram").limit(most).collect():  # CELLS / 2 numbers at most
            row = np.zeros(len(languages))
            for lang, n in r["by"]:
                row[number[lang]] = n
            table[r["gram"]] = row
        kept.append(table)
    return LanguageModel(languages, kept[0], kept[1:], totals)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            judge = Judge(model)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    found = [judge.judge(t) for t in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
