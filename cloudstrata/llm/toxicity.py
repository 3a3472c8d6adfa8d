"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a general lexicon of insults and of a lexicon
learned from labelled rows (words, and word beginnings for languages that
compound), how near hits stand to second-person words, rates of capitals,
punctuation and obfuscation (digits and signs for letters, letters drawn apart).

Learned from at most SAMPLE labelled rows in FOLDS folds, and at any number of
rows in one way: the rows of a fold are described by words learned from the
other folds, and valued by trees fitted to the other folds; these values
calibrate, and the last words and trees are those of all rows. At most LEXICON
words and beginnings are kept, of ten times as many that most toxic rows have.
Labels are only read of rows whose crc32(doc_id as text) mod 3 isn't 1. With no
labelled rows at all, or one class only, every score is the mean label (0
without rows).

Scores are of whole texts, whatever their length, and depend on nothing but the
text: repeated rows and ties get equal scores, a null doc_id is scored like
others, and other columns aren't read. A null text is empty; an empty text gets
the score that the trees give to no words at all. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc, TwoGenerations
from cloudstrata.llm.labelled import held_out, training_rows
from cloudstrata.llm.trees import BoostedTrees, Isotonic
from cloudstrata.session import cut

#: Labelled rows that are learned from at most, learned words and beginnings at most, and the score that rejects.
SAMPLE, LEXICON, REJECT = 16_000, 4_000, 0.7
NEAR, FOLDS = 8, 3
BEGINNINGS = (4, 5, 6, 7)

#: General English insults; what a corpus really uses is learned.
INSULTS = frozenset(
    """arsehole ass asshole bastard bitch braindead bullshit clown coward creep cretin crap cunt damn degenerate dick dickhead dimwit disgusting douche dumb dumbass
    dunce filth filthy fool foolish freak fuck fucker fucking garbage halfwit hate hideous idiot idiotic ignorant imbecile jackass jerk kill liar loser lowlife lunatic
    moron moronic nasty nitwit parasite pathetic pig prick psycho rat retard retarded revolting rubbish scum scumbag shit shithead sickening slime slut stupid subhuman
    swine toxic trash traitor twat ugly useless vermin vile weak whore worthless wretch""".split()
)
#: Second-person words of the languages of the corpus.
YOU = frozenset("you your yours yourself ya u ur youre du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú usted ti tus su vosotros vuestro".split())
SIGNS = str.maketrans("013457@$!|€", "oieastasiie")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
APART = re.compile(r"[.*_\-~]")
REPEATED = re.compile(r"(.)\1{2,}")

FEATURES = 24
#: Columns of what is known of a word.
(CHARS, LETTERS, UPPER, PUNCT, EXCLAIM, DIGITS, INSULT, LEARNED, WEIGHT, BEGUN, BEGUN_WEIGHT, SECOND, HIDDEN, HIDDEN_HIT, SHOUT, HIT) = range(16)


def _plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def _undone(word: str) -> str:
    """A word without what hides it."""
    return REPEATED.sub(r"\1", APART.sub("", _plain(word.translate(SIGNS))))


class Words:
    """What the features need of each word, as rows of a table; a text is an array of row numbers."""

    def __init__(self, words: dict[str, float], begun: dict[str, float]):
        self.words, self.begun = words, begun
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 16))
        self.number = TwoGenerations(self.look, 120_000)

    def look(self, word: str) -> int:
        low = _plain(word)
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        weight = self.words.get(low, 0.0)
        begun = max((self.begun.get(low[:n], 0.0) for n in BEGINNINGS if len(low) >= n), default=0.0) if self.begun else 0.0
        insult = low in INSULTS
        hidden = hidden_hit = False
        if letters and not insult and not low.isalpha() or REPEATED.search(low):
            hidden = bool(re.search(r"[^\W\d_][\d@$!*|]+[^\W\d_]", word)) or bool(re.fullmatch(r"(\w[.*_\-~]){2,}\w", EDGES.sub("", word)))
            undone = _undone(word)
            hidden_hit = undone != low and (undone in INSULTS or self.words.get(undone, 0) > 1.5)
        row = (
            min(len(word), 40), min(letters, 40), min(upper, 40), min(len(word) - letters - digits, 20), min(word.count("!"), 5), min(digits, 20), insult, weight > 1.5, round(weight, 1),
            begun > 1.0, round(begun, 1), low in YOU, hidden or hidden_hit, hidden_hit, letters >= 3 and upper == letters, insult or weight > 1.5 or hidden_hit,
        )
        return self.rows.setdefault(row, len(self.rows))

    def features(self, texts: list[str | None]) -> np.ndarray:
        codes, sizes = [], []
        for text in texts:
            found = (text or "").split()
            codes.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
            sizes.append(len(found))
        if len(self.table) < len(self.rows):
            self.table = np.array([*self.rows], np.float64).reshape(-1, 16)
        return np.array([self._of(c) for c in codes]).reshape(len(texts), FEATURES)

    def _of(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        out = np.zeros(FEATURES)
        if not n:
            return out
        number, times = np.unique(codes, return_counts=True) if n < 64 else (lambda c: (np.flatnonzero(c), c[c > 0]))(np.bincount(codes))
        rows = self.table[number]
        s = times @ rows
        chars, letters = max(s[CHARS], 1), max(s[LETTERS], 1)
        hits = s[HIT]
        out[:18] = (
            np.log1p(n), 100 * s[INSULT] / n, np.log1p(s[INSULT]), 100 * s[LEARNED] / n, np.log1p(s[LEARNED]), 100 * s[WEIGHT] / n, rows[:, WEIGHT].max(), 100 * s[BEGUN] / n, np.log1p(s[BEGUN]),
            100 * s[BEGUN_WEIGHT] / n, rows[:, BEGUN_WEIGHT].max(), s[UPPER] / letters, s[SHOUT] / n, s[PUNCT] / chars, s[EXCLAIM] / n, s[DIGITS] / chars, s[HIDDEN] / n, np.log1p(s[HIDDEN_HIT]),
        )
        out[18] = 100 * s[SECOND] / n
        if hits or s[BEGUN]:
            hit = self.table[:, HIT][codes] + self.table[:, BEGUN][codes] > 0
            at, you = np.flatnonzero(hit), np.flatnonzero(self.table[:, SECOND][codes])
            if len(you):
                k = np.searchsorted(you, at)
                gap = np.minimum(np.abs(at - you[np.clip(k, 0, len(you) - 1)]), np.abs(at - you[np.clip(k - 1, 0, len(you) - 1)]))
                out[19], out[20] = np.exp(-gap.min() / NEAR), (gap <= NEAR).mean()
            run = np.concatenate([[0], np.cumsum(hit)])
            width = min(64, n)
            out[21] = (run[width:] - run[:-width]).max()
            out[22] = len(np.unique(codes[at]))
            out[23] = np.log1p(len(at))
        return out


def _units(text: str) -> tuple[set[str], set[str]]:
    words = {w for w in map(_plain, set(text.split())) if w}
    return words, {w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def _learn_words(rows: DataFrame, most: int) -> list[tuple[dict[str, float], dict[str, float]]]:
    """Log odds of at most `most` words and word beginnings, of those that enough toxic rows have: for each fold those of the rows outside it, and last those of all rows.

    Units are counted once by fold, where the rows are; the counts of toxic rows choose what is counted in the others.
    """
    fold = F.col("fold") % FOLDS
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]

    def counted(known: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words, begun = _units(text)
                    units = {"=" + w for w in words} | {"^" + b for b in begun}
                    total.update((k, u) for u in (units if known is None else units & known))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([u for _, u in total]), pa.array([*total.values()], pa.int64())], names=["fold", "unit", "n"])

        return run

    def counts(y: int, known: frozenset | None) -> DataFrame:
        return rows.filter(F.col("y") == y).select("text", fold.cast("int").alias("fold")).mapInArrow(counted(known), "fold int, unit string, n long").groupBy("unit").agg(*by_fold)

    sizes = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("y", fold.alias("fold")).count().collect():
        sizes[r["y"], r["fold"]] = r["count"]
    inside = [*np.eye(FOLDS, dtype=bool), np.zeros(FOLDS, bool)]
    toxic_counts = cut(counts(1, None), "toxic-units")
    chosen: list[dict[str, int]] = []
    for out in inside:
        bad = int(sizes[1, ~out].sum())
        n = sum((F.col(f"n{k}") for k in range(FOLDS) if not out[k]), F.lit(0))
        top = toxic_counts.select("unit", n.alias("n")).filter(F.col("n") >= max(2, bad // 150)).orderBy(F.desc("n"), "unit").limit(10 * most)
        chosen.append({r["unit"]: r["n"] for r in top.collect()} if bad and sizes[0, ~out].sum() else {})
    known = frozenset().union(*chosen)
    clean_counts = {r["unit"]: np.array(r[1:]) for r in counts(0, known).select("unit", *[f"n{k}" for k in range(FOLDS)]).collect()} if known else {}
    learned = []
    for out, toxic in zip(inside, chosen, strict=True):
        bad, good = int(sizes[1, ~out].sum()), int(sizes[0, ~out].sum())
        clean = {u: int(clean_counts[u][~out].sum()) if u in clean_counts else 0 for u in toxic}
        odds = {u: float(np.log((n + 0.5) / (bad + 1)) - np.log((clean[u] + 0.5) / (good + 1))) for u, n in toxic.items()}
        # a word of few rows must be all the rarer in clean ones
        kept = sorted(((w - 2 / np.sqrt(toxic[u]), u) for u, w in odds.items() if w > 0), reverse=True)[:most]
        learned.append(tuple({u[1:]: round(w, 2) for w, u in kept if u[0] == sign and w > 0.5} for sign in "=^"))
    return learned


class ToxicityModel:
    """Words, trees and calibration; small, so it goes to every task."""

    def __init__(self, words: dict, begun: dict, trees: BoostedTrees | None, calibrate: Isotonic | None, mean: float):
        self.words, self.begun, self.trees, self.calibrate, self.mean = words, begun, trees, calibrate, mean

    def score(self, table: Words, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.mean)
        return np.clip(self.calibrate(self.trees.raw(table.features(texts))), 0, 1)


def _features(rows: DataFrame, words: dict[str, float], begun: dict[str, float]) -> list:
    """y, fold and features of sampled rows: FEATURES numbers for each of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(words, begun)
        for batch in batches:
            x = table.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    return rows.select("text", "y", "fold").mapInArrow(run, "y int, fold int, x array<double>").collect()


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, lexicon: int = LEXICON) -> ToxicityModel:
    """The model of at most `rows` labelled rows and `lexicon` words: no row is described by words, or valued by trees, that were learned from it."""
    sample = training_rows(docs, labels, "toxic", 3, lambda r: r != 1, rows)
    fold_of = F.col("fold") % FOLDS
    *of_folds, (words, begun) = _learn_words(sample, lexicon)
    found = [r for k, known in enumerate(of_folds) for r in _features(sample.filter(fold_of == k), *known)]
    if not found or len({r["y"] for r in found}) < 2:
        return ToxicityModel(words, begun, None, None, float(np.mean([r["y"] for r in found])) if found else 0.0)
    found.sort(key=lambda r: (r["fold"], r["y"], r["x"]))
    x, y, fold = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float), np.array([r["fold"] for r in found]) % FOLDS
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        out = fold == k
        if out.any() and not out.all():
            raw[out] = BoostedTrees().fit(x[~out], y[~out]).raw(x[out])
    return ToxicityModel(words, begun, BoostedTrees().fit(x, y), Isotonic().fit(raw, y), float(y.mean()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.7) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            table = Words(model.words, model.begun)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    score = model.score(table, part.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= REJECT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text isn't rejected."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            table = Words(model.words, model.begun)
            for batch in batches:
                for begin in range(0, batch.num_rows, 500):
                    part = batch.slice(begin, 500)
                    yield part.filter(pa.array(model.score(table, part.column(at).to_pylist()) < REJECT))

    return docs.mapInArrow(run, docs.schema)
