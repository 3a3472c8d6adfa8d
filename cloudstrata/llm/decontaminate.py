"""Benchmark decontamination by templates.

A text becomes a sequence of tokens in which numbers, names and units are typed
placeholders; everything else is lower-cased words without punctuation. Windows
of eight tokens of documents and benchmark items are hash-joined, so a question
is found again when its numbers and names have been changed. Matched windows of
a document and an item then tell how its slots were filled: filled the same
way wherever they recur, it is the item with other parameters; filled at random,
it is text of the same shape.

A document is contaminated by an item if the matched windows cover at least
COVERAGE of the item's windows and its slots are consistent, in one occurrence
of the item (matches at one shift, or at shifts that differ by a few tokens) or
in the whole document (an item in pieces). Documents meet a bitmap of the item
windows first (sized by their number, 32 MB at most, without false negatives),
so only windows that may match reach the join; a window that very many documents
hold is dealt over many tasks there.

Windows that are mostly placeholders say nothing as templates; with what fills
the placeholders in the hash they match verbatim copies. An item of such alone
is found when copied verbatim, not with other parameters. The item's windows
that have to be covered are its templates, or all of them. An item shorter than a window
is one window; it is found in longer texts, too, by windows of its size: anywhere with SAYS
plain words or more, else where its end is the end of a
sentence, line or text. With fewer than SAYS plain words beside placeholders it is
found there by verbatim copies only, anywhere from SAYS tokens on. Null and empty texts have no windows.

Each row is judged by its own text: rows with one doc_id, or with a null one,
that say different things are different documents, and repeated rows get the
same judgement. Very long texts are taken whole. Of equally covered places of an
item in a document the one of the higher consistency, then the first is told.
Columns of other names aren't read, and an empty table has no matches. Ids are taken
as 64-bit numbers; a text id raises an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.joins import join_hot
from cloudstrata.llm.bpe import calm_gc, TwoGenerations
from cloudstrata.llm.texts import TEXT_NAME, text_name
from cloudstrata.session import cut

WINDOW, COVERAGE, CONSISTENT = 8, 0.6, 0.8
#: Of a window at most so many tokens are placeholders.
SLOTS = WINDOW // 2
#: A shorter window within a text has so many plain words at least, if it has placeholders.
SAYS = 3
#: The least and the greatest number of bits of the bitmap, as powers of two; 4096 bits for each window in between, as each false hit costs a row.
BITMAP_BITS = (24, 28)

#: The end of a line among words, and what stands for that character where a text has it.
LINE, OTHER = "\ue000", "\ue001"
CLOSING = "\"'”’»)]}*_"
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER = re.compile(r"[+\-−]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
WITH_UNIT = re.compile(r"([+\-−]?\d+(?:[.,]\d+)*)([a-zA-Z°µ%]{1,4})")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty hundred thousand million billion dozen half twice".split())
UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg kilograms grams lb lbs pounds oz ounces ton tons ms s sec seconds second min minutes minute h hr hours hour day days week
    weeks month months year years l ml liter liters litres gallons cups m2 m3 kmh mph km/h m/s hz khz mhz v w kw kwh j kj cal kcal pa kpa k °c °f % percent degrees dollars euros cents usd eur gbp
    kilometers meters metres centimeters""".split()
)
SIGNS = {"$": "$", "€": "€", "£": "£"}
WORD, NUM, NAME, UNIT, NONE = range(5)
#: The codes of placeholders among the hashes of words.
SLOT_CODE = np.array([0, 0x1F0F_7A5C_91D3_6E21, 0x2B7E_1516_28AE_D2A6, 0x3C6E_F372_FE94_F82B, 0], np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Factors of the words of a name, the first being 1; the words beyond share the last.
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)
#: Tells hashes of what is written from hashes of templates.
_EXACT = np.uint64(0x5851_F42D_4C95_7F2D)


class Canonical:
    """Templates of texts. What a word may be is kept by word; what it is depends on the words before it."""

    def __init__(self) -> None:
        self.number = TwoGenerations(self.look, 200_000)

    def look(self, word: str) -> int:
        """59 bits of a word's hash, whether a sentence ends after it and closing marks, three bits of its kind as it stands alone, and whether a sentence ends after it."""
        last = word[-1]
        core = word if word.isalpha() else word[:-1] if last in ".,;:!?" and word[:-1].isalpha() else None
        if core is not None:  # letters alone, with one mark at most: no number, and nothing else at the edges
            low = core.lower()
            kind = NUM if low in NUMBER_WORDS else UNIT if low in UNITS else NAME if core[0].isupper() and not (len(core) > 1 and core.isupper()) else WORD
            ends = last in ".!?:;"
            return xxhash.xxh3_64_intdigest(low) >> 5 << 5 | ends << 4 | kind << 1 | ends
        core = EDGES.sub("", word)
        low = core.lower()
        ends = last in ".!?:;…" or word == LINE
        if word == LINE or not core and "%" not in word:
            kind = NONE
        elif NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            kind = NUM
        elif WITH_UNIT.fullmatch(core) and WITH_UNIT.fullmatch(core)[2].lower() in UNITS:
            kind = NUM
        elif low in UNITS or not core:
            kind = UNIT
        elif core[0].isupper() and not (len(core) > 1 and core.isupper()):
            kind = NAME
        else:
            kind = WORD
        stops = ends or word.rstrip(CLOSING)[-1:] in set(".!?:;…")
        return xxhash.xxh3_64_intdigest(low) >> 5 << 5 | stops << 4 | kind << 1 | ends

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Codes, codes of what is written, kinds and word numbers of the tokens, whether a sentence or the text ends with them, and the words."""
        text = text or ""
        if LINE in text:  # a text's own private-use character ends no line
            text = text.replace(LINE, OTHER)
        words = text.replace("\n", f" {LINE} ").split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, bool), words
        known = np.fromiter(map(self.number.__getitem__, words), np.uint64, n)
        code, kind, ends = known >> np.uint64(5) << np.uint64(5), (known >> np.uint64(1) & np.uint64(7)).astype(np.int8), known & np.uint64(1) == 1
        starts = np.concatenate([[True], ends[:-1]])
        kind[(kind == NAME) & starts] = WORD
        kept = np.flatnonzero(kind != NONE)
        kind, code = kind[kept], code[kept]
        if len(kind):
            after_number = np.concatenate([[False], kind[:-1] == NUM])
            kind[(kind == UNIT) & ~after_number] = WORD
            first = np.concatenate([[True], ~((kind[1:] == NAME) & (kind[:-1] == NAME))])  # a run of names is one name
            at = np.flatnonzero(first)
            code = np.add.reduceat(code * _ODD[np.minimum(np.arange(len(code)) - np.repeat(at, np.diff(at, append=len(code))), len(_ODD) - 1)], at)
            kind, kept = kind[first], kept[first]
        stopped = np.concatenate([[0], np.cumsum(known >> np.uint64(4) & np.uint64(1))])
        stops = stopped[np.append(kept[1:], n)] > stopped[kept] if len(kept) else np.zeros(0, bool)
        stops[-1:] = True
        return np.where(kind == WORD, code, SLOT_CODE[kind]), code, kind, kept, stops, words

    @staticmethod
    def windows(tokens: tuple, sizes: tuple[int, ...] = (), both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows, where they begin, their sizes, and whether what is written is hashed, as it is where a template would say nothing.

        Windows have WINDOW tokens, or all if there are fewer; those of `sizes` that say little end as sentences do. both: for an item
        shorter than a window that is a template to whole texts only, also what is written.
        """
        code, written, kind, _, stops, _ = tokens
        n = len(code)
        filled = np.concatenate([[0], np.cumsum(kind != WORD)])
        whole = min(WINDOW, n)
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for size in (whole, *(k for k in sizes if k < whole)) if n else ():
            slots = filled[size:] - filled[: n - size + 1]
            good, says = slots <= (SLOTS if size == WINDOW else size // 2), (slots == 0) | (size - slots >= SAYS)
            ends = stops[size - 1 :] | (size - slots >= SAYS) if size < whole else np.ones(n - size + 1, bool)
            written_ends = ends | (size >= SAYS)
            exact = ~good | ~says if size < whole or both and size < WINDOW else ~good
            if size < whole:
                good &= says
            for chosen, of, salt in ((good & ends, code, np.uint64(0)), (exact & written_ends, written, _EXACT)):
                at = np.flatnonzero(chosen)
                if len(at):
                    h = of[at]
                    for k in range(1, size):
                        h ^= h >> np.uint64(31)
                        h *= _FOLD
                        h += of[at + k]
                    h = ((h ^ (h >> np.uint64(29))) * _FOLD + np.uint64(size)) ^ salt
                    out.append((h, at, np.full(len(at), size), np.full(len(at), salt != 0)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    @staticmethod
    def slots(at: int, size: int, tokens: tuple) -> list[str]:
        """The slots of the window at a place: the kind and what fills it."""
        _, _, kind, kept, _, words = tokens
        out = []
        for k in range(at, at + size):
            if kind[k] != WORD:
                end = kept[k + 1] if k + 1 < len(kept) else kept[k] + 1
                value = words[kept[k] : end] if kind[k] == NAME else words[kept[k] : kept[k] + 1]
                out.append("?#@~"[kind[k]] + " ".join(EDGES.sub("", w).lower() for w in value if w != LINE).strip())
        return out


_WINDOWS = "id long, t1 long, t2 long, window long, at int, slots array<string>, tokens int, exact boolean"


def _window_rows(items: bool, bitmap: np.ndarray | None = None, sizes: tuple[int, ...] = ()):
    """Rows of the windows. items: texts are items, whose first word may be a name elsewhere; otherwise those that `bitmap` may hold, also of `sizes` (of items shorter than a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            canonical = Canonical()
            for batch in batches:
                rows_of, windows, places, slots, tokens, exact = [], [], [], [], [], []

                def add(row, found, h, at, size, written):
                    exact.extend(written.tolist())
                    for w, a, s in zip(h.view(np.int64).tolist(), at.tolist(), size.tolist(), strict=True):
                        rows_of.append(row)
                        windows.append(w)
                        places.append(a)
                        slots.append(canonical.slots(a, s, found))
                        tokens.append(s)

                for i, text in enumerate(batch.column(3).to_pylist()):
                    found = canonical.tokens(text)
                    rows = canonical.windows(found, sizes, items)
                    if bitmap is not None and len(rows[0]):
                        low = rows[0] & np.uint64(8 * len(bitmap) - 1)
                        hit = (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        rows = [r[hit] for r in rows]
                    add(i, found, *rows)
                    if items and len(found[0]) and found[2][0] == WORD and text.split()[0][:1].isupper():
                        # the first word of an item may be a name to what stands before it elsewhere
                        *parts, words = canonical.tokens("a " + text)
                        if len(parts[0]) > 1 and parts[2][1] == NAME:
                            found = (*(p[1:] for p in parts), words)
                            rows = canonical.windows(found, (), True)
                            add(i, found, *(r[rows[1] == 0] for r in rows))
                named = [batch.column(c).take(pa.array(rows_of, pa.int64())) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*named, pa.array(windows, pa.int64()), pa.array(places, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(tokens, pa.int32()), pa.array(exact, pa.bool_())], names=["id", *TEXT_NAME, "window", "at", "slots", "tokens", "exact"]
                )

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all windows; a task sends its bits, of a bounded size, and eight tasks do it."""
    least, most = BITMAP_BITS
    bits_of = min(most, max(least, (4096 * windows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (bits_of - 3), np.uint8)
        for batch in batches:
            low = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits_of) - 1)
            np.bitwise_or.at(bits, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (bits_of - 3), np.uint8)
    for row in windows.select("window").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """doc_id and name of the text (t1, t2), item_id, matched and all windows of the item, coverage, slots and consistency, of each contaminated text of an id and item."""
    spark = docs.sparkSession
    none = [F.lit(None).cast("long").alias(c) for c in TEXT_NAME]
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), *none, F.col(item_text).alias("text"))
    items = cut(items.mapInArrow(_window_rows(True), _WINDOWS), "items")
    short = tuple(sorted(r["tokens"] for r in items.filter(F.col("tokens") < WINDOW).select("tokens").distinct().collect()))  # seven at most
    bits = spark.sparkContext.broadcast(_bitmap(items))  # 32 MB at most, whatever the benchmark's size

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _window_rows(False, bits.value, short)(batches)

    hits = docs.select(F.col(id_col).cast("long").alias("id"), *text_name(text_col), F.col(text_col).alias("text")).mapInArrow(probe, _WINDOWS)
    hits = cut(hits.select(F.col("id").alias("doc_id"), *TEXT_NAME, "window", F.col("slots").alias("doc_slots"), F.col("at").alias("doc_at")), "window-hits")
    item = items.select(F.col("id").alias("item_id"), "window", F.col("slots").alias("item_slots"), F.col("at").alias("item_at"), "exact")
    pairs = cut(join_hot(hits, item, ["window"]).select("doc_id", *TEXT_NAME, "item_id", "item_at", "doc_at", "doc_slots", "item_slots", "exact"), "window-pairs")
    template = F.when(~F.col("exact"), F.col("at"))
    size = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("at").alias("windows"), F.countDistinct(template).alias("templates"))
    # shifts in one cell of a grid, or of the grid half a cell on, are one occurrence; cells are never wider than the item
    shift, cell = F.col("doc_at") - F.col("item_at"), F.least(F.lit(WINDOW), F.col("windows"))
    kinds = [(0, F.lit(0)), (1, shift), (2, F.floor(shift / cell)), (3, F.floor((shift + F.floor(cell / 2)) / cell))]
    places = F.array(*[F.struct(F.lit(k).alias("kind"), at.cast("long").alias("at")) for k, at in kinds])
    each_place = pairs.join(size, "item_id").withColumn("place", F.explode(places))
    key = ["doc_id", *TEXT_NAME, "item_id", "place"]
    found = each_place.groupBy(*key).agg(
        F.countDistinct("item_at").alias("matched"), F.countDistinct(F.when(~F.col("exact"), F.col("item_at"))).alias("as_templates"), F.min("doc_at").alias("first_token"), F.first("windows").alias("windows"), F.first("templates").alias("templates")
    )
    # an item with other parameters matches by templates only, a copy by all windows
    whole = F.col("matched") * F.greatest("templates", F.lit(1)) >= F.col("as_templates") * F.col("windows")
    found = found.withColumns({"matched": F.when(whole, F.col("matched")).otherwise(F.col("as_templates")), "windows": F.when(whole, F.col("windows")).otherwise(F.col("templates"))})
    found = found.filter(F.col("matched") >= COVERAGE * F.col("windows"))
    filled = each_place.select(*key, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*key, F.col("s.item_slots").alias("a"), F.col("s.doc_slots").alias("b"))
    each = filled.groupBy(*key, "a", "b").count()
    # how often a slot is filled as it mostly is, by the item's value and by the document's
    best = each.withColumn("of_a", F.max("count").over(W.partitionBy(*key, "a"))).withColumn("of_b", F.max("count").over(W.partitionBy(*key, "b")))
    slots = best.groupBy(*key).agg(F.sum("count").alias("slots"), F.sum(F.when((F.col("count") == F.col("of_a")) & (F.col("count") == F.col("of_b")), F.col("count")).otherwise(0)).alias("same"))
    other = {c: f"__{c}" for c in key}
    slots = slots.withColumnsRenamed(other)
    same_place = F.lit(True)
    for c, o in other.items():
        same_place = same_place & F.col(c).eqNullSafe(F.col(o))
    out = found.join(slots, same_place, "left").select(
        *key, "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"), "first_token", F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce(F.col("same") / F.col("slots"), F.lit(1.0)).alias("consistency"),
    )
    # of a document and an item, the place that is covered best
    row = F.struct("matched", "windows", "coverage", "first_token", "slots", "consistency")
    rank = F.struct("coverage", "consistency", -F.col("first_token"), -F.col("place.kind"))
    return out.filter(F.col("consistency") >= CONSISTENT).groupBy("doc_id", *TEXT_NAME, "item_id").agg(F.max_by(row, rank).alias("r")).select("doc_id", *TEXT_NAME, "item_id", "r.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched and all windows of the item, coverage, first token, slots and consistency, of each contaminated document and item."""
    return _matches(docs, benchmark, id_col, text_col, item_id, item_text).drop(*TEXT_NAME)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, whose text isn't contaminated by any item."""
    bad = _matches(docs, benchmark, "doc_id", "text", "item_id", "text").select(*[F.col(c).alias(f"__{c}") for c in TEXT_NAME]).distinct()
    bad = cut(bad, "contaminated")
    names = text_name(docs["text"])
    return docs.join(bad, (names[0] == bad["__t1"]) & (names[1] == bad["__t2"]), "left_anti")
