"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features are its own rates (runs of signs, capitals, separators,
repeated words, digits, function words and so on) and those of the lines before
and after it. The marginal of "good" from forward-backward, weighted by the
lengths of lines, is a document's quality, which isotonic regression turns into
a probability.

Learned from at most SAMPLE labelled rows, taken whole: of each label the row of
fewest lines, then, in the order of a hash of doc_id, all rows with which they have at most
SAMPLE_LINES lines together. A row that doesn't fit is passed over, so a very long
labelled row neither ends the sample nor leaves one label only. Lines take the label of their document. Every row is
valued by a field that was fitted on the other FOLDS - 1 folds; these values
calibrate, and the last field is that of all rows. Labels are only read of rows
whose crc32(doc_id as text) mod 5 isn't 0. Without labelled rows, or with one
class only, every score is the mean label (1 without rows).

Scores are of whole texts, whatever their length, and depend on nothing but the
text: repeated rows and ties get equal scores, a null doc_id is scored like
others, and other columns aren't read. A null, empty or blank text has no good
line: its quality before calibration is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc, TwoGenerations
from cloudstrata.llm.crf import LinearChainCrf
from cloudstrata.llm.labelled import held_out, training_rows
from cloudstrata.llm.trees import Isotonic
from cloudstrata.session import cut

#: Labelled rows that are learned from at most, and lines of them together; lines of a chain in fitting; folds of the calibration; the score from which a document is kept.
SAMPLE, SAMPLE_LINES, CHAIN, FOLDS, KEEP = 6_000, 300_000, 128, 3, 0.3

#: Stands for the end of a line among words: it has a space, which no word has.
LINE = " \n"
COMMON = frozenset(
    """the of and to in is it that was for on are as with be by at from this an or he she they we you not have has had but which their
    der die das und ist in den von zu mit sich des auf für im nicht ein eine dem als auch es an werden aus er
    le la les de des et un une du en que qui dans pour par sur au ce il elle est pas avec plus se
    el los las y del se con una no su al lo como más por para esta son""".split()
)
#: Columns of what is known of a word.
CHARS, LETTERS, UPPER, DIGITS, SIGNS, SIGN_RUN, BAR, FUNCTION, STOP, WORD, LONG = range(11)
OWN, NEAR_OF = 18, (1, 2, 3, 4, 5, 8)
FEATURES = OWN + 2 * len(NEAR_OF) + 2


class Lines:
    """Features of the lines of texts."""

    def __init__(self) -> None:
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 11))
        self.number = TwoGenerations(self.look, 120_000)

    def look(self, word: str) -> int:
        letters = sum(map(str.isalpha, word))
        digits = sum(map(str.isdigit, word))
        signs = len(word) - letters - digits
        run = signs >= 2 and any(a == b and not a.isalnum() for a, b in zip(word, word[1:], strict=False))
        row = (
            min(len(word), 60), min(letters, 60), min(sum(map(str.isupper, word)), 60), min(digits, 60), min(signs, 60), run, word in ("|", "||", "•", "·", "/", "-", "–", "»", "*"),
            word.strip(".,;:!?").lower() in COMMON, word[-1] in ".!?…", 1, len(word) > 25,
        )
        return self.rows.setdefault(row, len(self.rows))

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and characters of every line that has words, and the number of such lines of each text."""
        words: list[str] = []
        marks: list[int] = []
        line_ends: list[int] = []
        for text in texts:
            for line in (text or "").split("\n"):
                words += line.split()
                words.append(LINE)
                line_ends.append(len(words) - 1)
            marks.append(len(words) - 1)
        n = len(words)
        codes = np.fromiter(map(self.number.__getitem__, words), np.int64, n)
        names = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        if len(self.table) < len(self.rows):
            self.table = np.array([*self.rows], np.float64)
        ends = np.array(line_ends, np.int64)
        begin = np.concatenate([[0], ends[:-1] + 1])
        size = ends - begin
        doc_of_line = np.searchsorted(np.array(marks), ends)
        full = size > 0
        begin, size, doc = begin[full], size[full], doc_of_line[full]
        lines = np.bincount(doc, minlength=len(texts))
        if not len(begin):
            return np.zeros((0, FEATURES)), np.zeros(0), lines
        # sums over lines: the end mark's own row is taken out by ending before it
        inside = np.ones(n, bool)
        inside[ends] = False
        at = np.cumsum(inside) - 1
        begin = at[begin]
        codes, names = codes[inside], names[inside]
        s = np.stack([np.add.reduceat(self.table[:, c][codes], begin) for c in range(self.table.shape[1])], 1)
        line = np.repeat(np.arange(len(begin)), size)
        again = np.zeros(len(codes))
        for lag in (1, 2, 3):
            again[lag:] = np.maximum(again[lag:], (names[lag:] == names[:-lag]) & (line[lag:] == line[:-lag]))
        again = np.add.reduceat(again, begin)
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
        name = np.add.reduceat(names * (2 * place + np.uint64(1)), begin)
        order = np.lexsort((np.arange(len(name)), name, doc))
        seen = np.zeros(len(name))
        seen[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        w, chars, letters = s[:, WORD], np.maximum(s[:, CHARS], 1), np.maximum(s[:, LETTERS], 1)
        sign, upper, bar, rep, stop = s[:, SIGN_RUN] / w, s[:, UPPER] / letters, s[:, BAR] / w, again / w, s[:, FUNCTION] / w
        x = np.zeros((len(begin), FEATURES))
        x[:, :OWN] = np.stack(
            [
                np.ones(len(begin)), sign, upper, bar, rep, stop, s[:, DIGITS] / chars, s[:, SIGNS] / chars, seen, np.minimum(chars / w / 10, 3), np.log1p(chars) / 8, chars < 40,
                s[:, STOP] / w, sign > 0.2, upper > 0.5, bar > 0.2, rep > 0.15, s[:, LONG] / w,
            ], 1,
        )
        same = doc[1:] == doc[:-1]
        k = len(NEAR_OF)
        x[1:, OWN : OWN + k] = x[:-1, NEAR_OF] * same[:, None]
        x[:-1, OWN + k : OWN + 2 * k] = x[1:, NEAR_OF] * same[:, None]
        x[0, -2] = x[-1, -1] = 1
        x[1:, -2] = x[:-1, -1] = ~same
        return x, chars, lines


def _document_values(p_good: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted means of the marginals; 0 without lines."""
    doc = np.repeat(np.arange(len(lines)), lines)
    return np.bincount(doc, p_good * chars, len(lines)) / np.maximum(np.bincount(doc, chars, len(lines)), 1)


class QualityModel:
    """The field and its calibration; small, so it goes to every task."""

    def __init__(self, field: LinearChainCrf | None, calibrate: Isotonic | None, mean: float):
        self.field, self.calibrate, self.mean = field, calibrate, mean

    def lines(self, table: Lines, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The marginal of good and the characters of each line, and the lines of each text."""
        x, chars, lines = table.features(texts)
        return self.field.marginals(x, lines)[:, 1], chars, lines

    def score(self, table: Lines, texts: list[str | None]) -> np.ndarray:
        if self.field is None:
            return np.full(len(texts), self.mean)
        return np.clip(self.calibrate(_document_values(*self.lines(table, texts))), 0, 1)


def _whole_rows(rows: list[tuple[int, int, int]], lines: int) -> list[int]:
    """The places of the rows (place, lines, label) that are taken: the shortest of each label in any case, and in order those that fit with the others into `lines`."""
    shortest = {y: min((n, place) for place, n, label in rows if label == y) for y in {r[2] for r in rows}}
    taken = {place for _, place in shortest.values()}
    total = sum(n for n, _ in shortest.values())
    for place, n, _ in sorted(rows):
        if place not in taken and total + n <= lines:
            taken.add(place)
            total += n
    return sorted(taken)


def _field(rows: list[tuple[np.ndarray, int]]) -> LinearChainCrf:
    """The field fitted to all lines of rows. A chain of more than CHAIN lines is fitted as several in a row, so that a few long texts don't make the steps of all."""
    lines = np.array([len(x) for x, _ in rows], np.int64)
    x = np.concatenate([x for x, _ in rows]) if rows else np.zeros((0, FEATURES))
    chains = np.array([size for n in lines.tolist() for size in [CHAIN] * (n // CHAIN) + [n % CHAIN] * (n % CHAIN > 0)], np.int64)
    return LinearChainCrf(2, FEATURES).fit(x, np.repeat(np.array([y for _, y in rows], np.int64), lines), chains)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, lines: int = SAMPLE_LINES) -> QualityModel:
    """The model of at most `rows` labelled rows with `lines` lines; the same for the same rows, whatever their order and partitions."""
    sample = training_rows(docs, labels, "quality", 5, lambda r: r != 0, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lines()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                x, chars, lines = table.features(part.column(0).to_pylist())
                ends = np.cumsum(lines)
                out = [(x[e - n : e].astype(np.float32).tobytes(), chars[e - n : e].astype(np.float32).tobytes()) for n, e in zip(lines.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), part.column(3), pa.array(lines, pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
                    names=["y", "fold", "place", "lines", "x", "chars"],
                )

    features = cut(sample.select("text", "y", "fold", "place").mapInArrow(run, "y int, fold int, place long, lines long, x binary, chars binary"), "quality-features")
    # three numbers for each of `rows` rows, then at most `lines` lines of FEATURES numbers, or the shortest row of each label
    taken = _whole_rows([tuple(r) for r in features.select("place", "lines", "y").collect()], lines)
    found = features.filter(F.col("place").isin(taken)).collect() if taken else []
    if not found or len({r["y"] for r in found}) < 2:
        return QualityModel(None, None, float(np.mean([r["y"] for r in found])) if found else 1.0)
    found.sort(key=lambda r: r["place"])
    data = [(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float), r["y"]) for r in found]
    chars = [np.frombuffer(r["chars"], np.float32).astype(float) for r in found]
    y, fold = np.array([r["y"] for r in found]), np.array([r["fold"] for r in found]) % FOLDS
    value = np.zeros(len(y))
    for k in range(FOLDS):
        out = np.flatnonzero(fold == k)
        if len(out):
            size = np.array([len(data[i][0]) for i in out], np.int64)
            p = _field([d for d, f in zip(data, fold, strict=True) if f != k]).marginals(np.concatenate([data[i][0] for i in out]), size)[:, 1]
            value[out] = _document_values(p, np.concatenate([chars[i] for i in out]), size)
    return QualityModel(_field(data), Isotonic().fit(value, y), float(y.mean()))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.3) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            table = Lines()
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    score = model.score(table, part.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= KEEP).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def label_lines(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The marginals of good of each document's lines that have words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lines()
        for batch in batches:
            p, _, lines = model.lines(table, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in np.split(p, np.cumsum(lines)[:-1])], pa.list_(pa.float64()))], names=[id_col, "good"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, good array<double>")


def drop_poor(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that are predicted good."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            table = Lines()
            for batch in batches:
                for begin in range(0, batch.num_rows, 200):
                    part = batch.slice(begin, 200)
                    yield part.filter(pa.array(model.score(table, part.column(at).to_pylist()) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
