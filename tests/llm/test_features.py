"""Features of lines and texts, and the values of documents, against plain loops."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudstrata.llm import quality, toxicity
from cloudstrata.llm.crf import LinearChainCrf
from cloudstrata.llm.trees import BoostedTrees, Isotonic
from tests.llm.test_models import enumerate_chain

TEXTS = [
    "The words are plain here.\n\nAnd%%% these&&& have | | signs &&& the the THE\nShort.\nShort.\n", None, "", " \n \n", "one", "ab  c\n", "ALL CAPS ARE HERE 123 456!\nx" + "y" * 40 + "\n" * 3 + "der die das",
    "You are an 1d10t and an i.d.i.o.t, you stuuupid fool!!! " * 3, "idiot " * 30 + "far away from your own " + "w " * 20, "Damn. grumbling grumbled grumbler zorbax",
]


def line_rows(text):
    """The features of each line with words, by the words that the module uses for them."""
    lines = [w for line in (text or "").split("\n") if (w := line.split())]
    own, sizes = [], []
    for k, words in enumerate(lines):
        n = len(words)
        chars, letters = max(sum(min(len(w), 60) for w in words), 1), max(sum(min(sum(map(str.isalpha, w)), 60) for w in words), 1)
        digits = [sum(map(str.isdigit, w)) for w in words]
        signs = [len(w) - sum(map(str.isalpha, w)) - d for w, d in zip(words, digits, strict=True)]
        runs = sum(s >= 2 and any(a == b and not a.isalnum() for a, b in zip(w, w[1:], strict=False)) for w, s in zip(words, signs, strict=True)) / n
        upper = sum(min(sum(map(str.isupper, w)), 60) for w in words) / letters
        bars = sum(w in ("|", "||", "•", "·", "/", "-", "–", "»", "*") for w in words) / n
        again = sum(any(i >= lag and words[i - lag] == words[i] for lag in (1, 2, 3)) for i in range(n)) / n
        common = sum(w.strip(".,;:!?").lower() in quality.COMMON for w in words) / n
        stops, longs = sum(w[-1] in ".!?…" for w in words) / n, sum(len(w) > 25 for w in words) / n
        own.append(
            [1, runs, upper, bars, again, common, sum(min(d, 60) for d in digits) / chars, sum(min(s, 60) for s in signs) / chars, words in lines[:k], min(chars / n / 10, 3), math.log1p(chars) / 8, chars < 40,
             stops, runs > 0.2, upper > 0.5, bars > 0.2, again > 0.15, longs]
        )
        sizes.append(chars)
    none = [0] * len(quality.NEAR_OF)
    near = lambda k: [own[k][j] for j in quality.NEAR_OF] if 0 <= k < len(own) else none
    return [o + near(k - 1) + near(k + 1) + [k == 0, k == len(own) - 1] for k, o in enumerate(own)], sizes


def test_lines():
    x, chars, lines = quality.Lines().features(TEXTS)
    want = [line_rows(t) for t in TEXTS]
    assert lines.tolist() == [len(s) for _, s in want] and chars.tolist() == [c for _, s in want for c in s]
    assert np.allclose(x, np.array([r for rows, _ in want for r in rows], float))


def test_value_of_a_document():
    r = np.random.default_rng(3)
    field = LinearChainCrf(2, quality.FEATURES)
    field.weights, field.moves, field.ends = r.normal(size=field.weights.shape) * 0.3, r.normal(size=(2, 2)), r.normal(size=(2, 2))
    calibrate = Isotonic().fit(np.linspace(0, 1, 9), np.array([0, 0, 1, 0, 0, 1, 1, 1, 1]))
    got = quality.QualityModel(field, calibrate, 0.5).score(quality.Lines(), TEXTS)
    for text, score in zip(TEXTS, got, strict=True):
        rows, chars = line_rows(text)
        good = enumerate_chain(field, np.array(rows, float))[1][:, 1] if rows else np.zeros(0)
        value = float((good * chars).sum() / sum(chars)) if rows else 0.0
        assert score == pytest.approx(float(np.clip(calibrate(np.array([value])), 0, 1)[0]))


def test_whole_rows():
    assert quality._whole_rows([], 5) == []
    assert quality._whole_rows([(1, 2, 0), (2, 3, 0), (3, 1, 0)], 5) == [1, 3] and quality._whole_rows([(1, 2, 0), (2, 2, 0), (3, 1, 0)], 5) == [1, 2, 3]
    for first in range(3):  # a row that never fits is passed over, wherever it is
        rows = [(k, 2, k % 2) for k in range(9)]
        rows[first] = (first, 300_001, first % 2)
        assert quality._whole_rows(rows, 300_000) == [k for k in range(9) if k != first]
    assert quality._whole_rows([(1, 4, 0), (2, 4, 0), (3, 90, 1), (4, 80, 1)], 8) == [1, 4]  # both labels, in any case


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("place", [0, 1, 2])
def test_a_very_long_labelled_row(spark, label, place):
    """A labelled row of more lines than all others may have, first, second or third in the order of hashes, doesn't silence either classifier."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 3 != 1][:120]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    order = [r["doc_id"] for r in frame.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    good, bad = "The words of this line are plain and easy to read.\n" * 4, "%%% ||| $$$ XX 99 || 12 //\n||| %% 77\n" * 3
    rows, labels = [], []
    for i in ids:
        y = i % 2 if i != order[place] else label
        text = (good if y else bad) + f"number {i}" if i != order[place] else "a line\n" * 300_001
        rows.append((i, text))
        labels.append((i, y, 1 - y))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, known)
    assert model.field is not None
    kept = {r["doc_id"] for r in quality.drop_poor(docs, model).select("doc_id").collect()}
    assert {i for i in ids if i != order[place]} & kept == {i for i in ids if i % 2 and i != order[place]}
    if place == 1:
        scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)).collect()}
        assert min(scores[i] for i in ids if not i % 2 and i != order[place]) > max(scores[i] for i in ids if i % 2 and i != order[place])


def test_learned_words(spark):
    """Words and beginnings by fold against plain counts."""
    r = random.Random(5)
    pool = [f"w{k}tail{k % 7}" for k in range(40)] + ["Zorbax!", "zorbaxes", "calm"]
    rows = [(" ".join(r.choice(pool[20:] if k % 3 == 0 else pool[:30]) for _ in range(12)), int(k % 3 == 0), k % 10) for k in range(240)]
    got = toxicity._learn_words(spark.createDataFrame(rows, "text string, y int, fold int").repartition(5), 25)
    assert len(got) == toxicity.FOLDS + 1
    for out, learned in enumerate(got):
        inside = [(t, y) for t, y, f in rows if f % toxicity.FOLDS != out]
        size = [sum(y == v for _, y in inside) for v in (0, 1)]
        count = [Counter(), Counter()]
        for t, y in inside:
            words = {w for w in map(toxicity._plain, t.split()) if w}
            count[y].update({"=" + w for w in words} | {"^" + w[:n] for w in words for n in toxicity.BEGINNINGS if len(w) > n})
        top = sorted((u for u, n in count[1].items() if n >= max(2, size[1] // 150)), key=lambda u: (-count[1][u], u))[:250]
        odds = {u: math.log((count[1][u] + 0.5) / (size[1] + 1)) - math.log((count[0][u] + 0.5) / (size[0] + 1)) for u in top}
        kept = sorted(((w - 2 / math.sqrt(count[1][u]), u) for u, w in odds.items() if w > 0), reverse=True)[:25]
        for sign, found in zip("=^", learned, strict=True):
            assert found == pytest.approx({u[1:]: round(w, 2) for w, u in kept if u[0] == sign and w > 0.5}, abs=0.011)


WORDS, BEGUN = {"zorbax": 2.0, "grumbled": 1.2, "idiot": 3.0}, {"grum": 1.5, "zorb": 0.7}


def text_row(text):
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * toxicity.FEATURES
    low = [toxicity._plain(w) for w in words]
    letters = [sum(map(str.isalpha, w)) for w in words]
    digits = [sum(map(str.isdigit, w)) for w in words]
    upper = [sum(map(str.isupper, w)) for w in words]
    weight = [round(WORDS.get(v, 0.0), 1) for v in low]
    begun = [round(max([BEGUN.get(v[:k], 0.0) for k in toxicity.BEGINNINGS if len(v) >= k], default=0.0), 1) for v in low]
    insult = [v in toxicity.INSULTS for v in low]
    hidden_hit, hidden = [], []
    for w, v, i, a in zip(words, low, insult, letters, strict=True):
        odd = bool(a and not i and not v.isalpha() or toxicity.REPEATED.search(v))
        undone = toxicity._undone(w)
        hit = odd and undone != v and (undone in toxicity.INSULTS or WORDS.get(undone, 0) > 1.5)
        core = toxicity.EDGES.sub("", w)
        apart = len(core) >= 5 and len(core) % 2 == 1 and all(c in ".*_-~" for c in core[1::2]) and all(c.isalnum() or c == "_" for c in core[::2])
        inner = any(p < k and words_letter(w[p]) and all(c in "0123456789@$!*|" for c in w[p + 1 : k]) and k > p + 1 and words_letter(w[k]) for p in range(len(w)) for k in range(p + 2, len(w)))
        hidden_hit.append(hit)
        hidden.append(hit or odd and (inner or apart))
    chars = max(sum(min(len(w), 40) for w in words), 1)
    all_letters = max(sum(min(a, 40) for a in letters), 1)
    learned, begins, second = [w > 1.5 for w in weight], [b > 1.0 for b in begun], [v in toxicity.YOU for v in low]
    shout = sum(a >= 3 and u == a for a, u in zip(letters, upper, strict=True))
    punct = sum(min(len(w) - a - d, 20) for w, a, d in zip(words, letters, digits, strict=True))
    hit = [i or l or h for i, l, h in zip(insult, learned, hidden_hit, strict=True)]
    out = [
        math.log1p(n), 100 * sum(insult) / n, math.log1p(sum(insult)), 100 * sum(learned) / n, math.log1p(sum(learned)), 100 * sum(weight) / n, max(weight), 100 * sum(begins) / n, math.log1p(sum(begins)),
        100 * sum(begun) / n, max(begun), sum(min(u, 40) for u in upper) / all_letters, shout / n, punct / chars, sum(min(w.count("!"), 5) for w in words) / n, sum(min(d, 20) for d in digits) / chars,
        sum(hidden) / n, math.log1p(sum(hidden_hit)), 100 * sum(second) / n, 0.0, 0.0, 0.0, 0.0, 0.0,
    ]
    at, you = [k for k in range(n) if hit[k] or begins[k]], [k for k in range(n) if second[k]]
    if at:
        if you:
            gaps = [min(abs(k - y) for y in you) for k in at]
            out[19], out[20] = math.exp(-min(gaps) / toxicity.NEAR), sum(g <= toxicity.NEAR for g in gaps) / len(gaps)
        width = min(64, n)
        out[21] = max(sum(b <= k < b + width for k in at) for b in range(n - width + 1))
        out[23] = math.log1p(len(at))
    return out


def words_letter(c):
    return c.isalpha()


def test_texts():
    r = random.Random(8)
    pool = ["You", "your", "idiot", "1d10t", "i.d.i.o.t", "grumbling", "zorbax!", "ZORBAX", "calm", "day", "№5", "stuuupid", "a1b", "!!!", "über-gut", "Gr8", "f*ol"]
    texts = TEXTS + [" ".join(r.choice(pool) for _ in range(r.choice([1, 5, 40, 200]))) for _ in range(60)]
    got = toxicity.Words(WORDS, BEGUN).features(texts)
    want = np.array([text_row(t) for t in texts])
    distinct = 22  # how many kinds of hits: rows of the table, so a number of at most the hits
    assert np.allclose(np.delete(got, distinct, 1), np.delete(want, distinct, 1))
    assert (got[:, distinct] <= np.expm1(want[:, 23]) + 1e-9).all() and ((got[:, distinct] > 0) == (want[:, 23] > 0)).all()


def test_score_is_calibrated_trees():
    r = np.random.default_rng(4)
    trees = BoostedTrees(trees=5).fit(r.random((200, toxicity.FEATURES)), r.integers(0, 2, 200).astype(float))
    calibrate = Isotonic().fit(np.linspace(-2, 2, 30), (np.linspace(-2, 2, 30) > 0).astype(float))
    model = toxicity.ToxicityModel(WORDS, BEGUN, trees, calibrate, 0.1)
    for text, score in zip(TEXTS, model.score(toxicity.Words(WORDS, BEGUN), TEXTS), strict=True):
        x, total = text_row(text), trees.base
        x[22] = toxicity.Words(WORDS, BEGUN).features([text])[0][22]
        for t in range(trees.trees):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + (x[trees.feature[t, node]] > trees.edge[t, node])
            total += trees.value[t][node - (2**trees.depth - 1)]
        assert score == pytest.approx(float(np.clip(calibrate(np.array([total])), 0, 1)[0]))
