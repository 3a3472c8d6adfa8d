"""Vector code compression: product codebooks by Heap Lloyd, in whole numbers.

A component x becomes floor(256 x); a vector is cut into PARTS equal consecutive
parts. The codebook of each part position starts as that part of the ENTRIES kept vectors of
smallest id (ties: smaller vector). A round assigns every part to the nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each entry by the componentwise floor
of its parts' mean; entries without parts stay. After ROUNDS rounds parts are assigned again.

Vectors are dealt once into chunks, which keep, for each position and entry, a heap of the
entry's parts. A part's key is the distance to its second nearest entry less that to its own,
plus what the entry's drift had come to when it was put there. Drift is cumulative: in each round, how
far the entry moved and the farthest move of any other. While the least key is above
the drift, no part of the heap can have a nearer entry, and none is looked at.
Parts with smaller keys are popped, measured against all entries exactly and put into the
heaps where they belong. A heap is kept in full order, which is a heap whose
pops are its beginning. Keys are rounded down, so ties are always measured. A round's chunks are
written to the shared folder with the sums that moved; the driver gets no more than one number
for each component of each entry.

Vectors that are null, or hold null, NaN or infinite components, take no part and give no row;
nor do those of another dimension than most (of equally common ones the
smallest), or empty ones. Repeated rows and equal ids are rows each; null ids are kept, and are the greatest.
Fewer than ENTRIES vectors make fewer entries. Labels are compared as text, nulls being equal. Without
vectors there are no rows. Other columns aren't read. A dimension that PARTS doesn't divide, or
a component of 2^20 or more, raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.joins import join_hot
from cloudstrata.session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk at most; components are smaller than this in size.
CHUNK, LARGEST = 8_192, 1 << 20


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows: in doubles where all steps stay below 2^53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None].astype(np.int64) - entries[:, k].astype(np.int64)
        out += d * d
    return out


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each position and entry: how far it moved and the farthest move of any other, rounded up."""
    moved = np.sqrt(((after - before).astype(float) ** 2).sum(2)) * (1 + 1e-12)
    other = np.zeros_like(moved)
    if moved.shape[1] > 1:
        order = np.argsort(-moved, axis=1, kind="stable")
        first, second = order[:, :1], order[:, 1:2]
        other[:] = np.take_along_axis(moved, first, 1)
        np.put_along_axis(other, first, np.take_along_axis(moved, second, 1), 1)
    return moved + other


class Heaps:
    """Heaps of the parts of one chunk: for each position and entry rows and keys, least key first."""

    def __init__(self, rows: list[np.ndarray], keys: list[np.ndarray], sizes: np.ndarray):
        """rows and keys by position, heap after heap; sizes of heaps by position and entry."""
        self.rows, self.keys, self.sizes = rows, keys, sizes

    @staticmethod
    def empty(entries: int) -> Heaps:
        return Heaps([np.zeros(0, np.uint16)] * PARTS, [np.zeros(0, np.float32)] * PARTS, np.zeros((PARTS, entries), np.int64))

    def assigned(self, at: int) -> np.ndarray:
        """The entry of each row at a position."""
        out = np.empty(len(self.rows[at]), np.int64)
        out[self.rows[at]] = np.repeat(np.arange(self.sizes.shape[1]), self.sizes[at])
        return out

    def pop(self, at: int, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the parts whose keys the drift of their entries has reached: rows and entries."""
        keys, ends = self.keys[at], np.cumsum(self.sizes[at])
        gone = np.array([np.searchsorted(keys[e - n : e], d, "right") for n, e, d in zip(self.sizes[at].tolist(), ends.tolist(), drift.tolist(), strict=True)], np.int64)
        if not gone.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = ends - self.sizes[at]
        out = np.repeat(first, gone) + np.arange(gone.sum()) - np.repeat(np.cumsum(gone) - gone, gone)
        rows = self.rows[at][out].astype(np.int64)
        self.rows[at], self.keys[at] = np.delete(self.rows[at], out), np.delete(keys, out)
        self.sizes[at] -= gone
        return rows, np.repeat(np.arange(len(gone)), gone)

    def push(self, at: int, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        """Puts rows into the heaps of entries."""
        order = np.lexsort((rows, keys, entries))
        rows, entries, keys = rows[order].astype(np.uint16), entries[order], keys[order]
        ends = np.cumsum(self.sizes[at])
        added = np.bincount(entries, minlength=self.sizes.shape[1])
        new_at = np.cumsum(added) - added
        place = [e - n + np.searchsorted(self.keys[at][e - n : e], keys[b : b + k]) for e, n, b, k in zip(ends.tolist(), self.sizes[at].tolist(), new_at.tolist(), added.tolist(), strict=True) if k]
        where = np.concatenate(place)
        self.rows[at], self.keys[at] = np.insert(self.rows[at], where, rows), np.insert(self.keys[at], where, keys)
        self.sizes[at] += added


def settle(x: np.ndarray, books: np.ndarray, heaps: Heaps, drift: np.ndarray) -> tuple[np.ndarray, int]:
    """Assigns the parts of a chunk: those that no heap has yet, and those whose keys the drift has reached. Returns what sums and counts of entries change by, and how many parts were measured.

    x: vectors by part by component; books: entries by position; drift: cumulative, by position and entry.
    """
    entries, width = books.shape[1:]
    moved, measured = np.zeros((PARTS, entries, width + 1), np.int64), 0
    for at in range(PARTS):
        fresh = not len(heaps.rows[at])
        rows, old = (np.arange(len(x)), None) if fresh else heaps.pop(at, drift[at])
        if not len(rows):
            continue
        measured += len(rows)
        part = x[rows, at]
        d = squared_distances(part, books[at])
        own = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(rows)), own].astype(float))
        if entries > 1:
            d = d.astype(float)
            d[np.arange(len(rows)), own] = np.inf
            lower = np.sqrt(d.min(1))
        else:
            lower = np.full(len(rows), np.inf)
        key = lower - upper + drift[at][own]
        key -= 1e-12 * (np.where(np.isinf(lower), 0, lower) + upper + drift[at][own])
        heaps.push(at, rows, own, np.where(np.isinf(key), np.inf, np.nextafter(key.astype(np.float32), np.float32(-np.inf))).astype(np.float32))
        change = np.ones(len(rows), bool) if fresh else own != old
        with_one = np.concatenate([part[change], np.ones((change.sum(), 1), np.int64)], 1)
        np.add.at(moved[at], own[change], with_one)
        if not fresh:
            np.subtract.at(moved[at], old[change], with_one)
    return moved, measured


_STATE = ("ids", "labels", "parts", "rows", "keys", "sizes", "moved", "measured")


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: Heaps, moved: np.ndarray, measured: int) -> pa.RecordBatch:
    """A chunk as one row."""
    small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x.astype(np.int32)
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    cells = [small.tobytes(), np.concatenate(heaps.rows).tobytes(), np.concatenate(heaps.keys).tobytes(), heaps.sizes.astype(np.int32).tobytes(), moved.tobytes()]
    return pa.RecordBatch.from_arrays([whole(ids), whole(labels), *[pa.array([c], pa.binary()) for c in cells], pa.array([measured], pa.int64())], names=[*_STATE])


def _read(row: pa.RecordBatch, width: int, entries: int) -> tuple[pa.Array, pa.Array, np.ndarray, Heaps]:
    """A chunk from its row."""
    ids, labels = row.column(0).flatten(), row.column(1).flatten()
    n, cell = len(ids), lambda k: row.column(k)[0].as_py()
    raw = cell(2)
    x = np.frombuffer(raw, np.int16 if len(raw) == 2 * n * PARTS * width else np.int32).reshape(n, PARTS, width).astype(np.int64)
    rows, keys = (np.frombuffer(cell(k), kind).reshape(PARTS, n) for k, kind in ((3, np.uint16), (4, np.float32)))
    return ids, labels, x, Heaps([*rows], [*keys], np.frombuffer(cell(5), np.int32).reshape(PARTS, entries).astype(np.int64))


def _sums(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """What sums and counts change by in all chunks; the driver gets a number for each component of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.frombuffer(cell.as_py(), np.int64).reshape(shape)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total.ravel()[there], pa.int64())], names=["slot", "value"])

    out = np.zeros(shape, np.int64)
    for r in state.select("moved").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out.ravel()[r["slot"]] = r["value"]
    return out


def compress(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """vec_id, label, code and error of every kept vector; the final entries by position, entry and component (None without vectors); how many parts each assignment measured."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    kept = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))))  # NaN is above infinity
    kinds = rows.schema
    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    sizes = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema), None, []
    dimension = sizes[0]["size"]
    if dimension % PARTS:
        raise ValueError(f"{PARTS} parts don't divide {dimension} components")
    width = dimension // PARTS
    kept = kept.filter(F.size("v") == dimension)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()
    books = _whole(np.array([r["v"] for r in first])).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    entries = len(first)
    drift, totals, measured = np.zeros((PARTS, entries)), np.zeros((PARTS, entries, width + 1), np.int64), []

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _whole(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, PARTS, width)
                heaps = Heaps.empty(entries)
                yield _state(part.column(0), part.column(2), x, heaps, *settle(x, books, heaps, drift))

    kinds_of_state = f"ids array<{kinds['vec_id'].dataType.simpleString()}>, labels array<{kinds['label'].dataType.simpleString()}>, parts binary, rows binary, keys binary, sizes binary, moved binary, measured long"
    state = cut(kept.mapInArrow(begin, kinds_of_state), "codes") if rounds else None
    for k in range(rounds):
        measured.append(state.agg(F.sum("measured")).first()[0])
        totals = totals + _sums(state, totals.shape)
        used = totals[:, :, -1:]
        after = np.where(used > 0, totals[:, :, :-1] // np.maximum(used, 1), books)
        drift, books = drift + drifts(books, after), after
        if k + 1 < rounds:
            state = cut(state.mapInArrow(_again(books, drift, width), kinds_of_state), "codes")
    if state is None:
        state = kept.mapInArrow(begin, kinds_of_state)
    coded = cut(state.mapInArrow(_coded(books, drift, width), f"{schema}, measured long"), "codes")
    measured.append(coded.agg(F.sum("measured")).first()[0])
    return coded.drop("measured"), books, measured


def _whole(v: np.ndarray) -> np.ndarray:
    if np.abs(v).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of {LARGEST} or more")
    return np.floor(SCALE * v).astype(np.int64)


def _again(books: np.ndarray, drift: np.ndarray, width: int):
    """Chunks after another assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, heaps = _read(batch.slice(k, 1), width, books.shape[1])
                yield _state(ids, labels, x, heaps, *settle(x, books, heaps, drift))

    return run


def _coded(books: np.ndarray, drift: np.ndarray, width: int):
    """Codes and errors after the last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, heaps = _read(batch.slice(k, 1), width, books.shape[1])
                _, measured = settle(x, books, heaps, drift)
                own = np.stack([heaps.assigned(at) for at in range(PARTS)], 1)
                away = x - books[np.arange(PARTS), own]
                digits = own.astype(np.uint8).tobytes().hex()
                code = [digits[a : a + 2 * PARTS] for a in range(0, len(digits), 2 * PARTS)]
                seen = np.zeros(len(ids), np.int64)
                seen[0] = measured
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array((away * away).sum((1, 2)), pa.int64()), pa.array(seen)], names=["vec_id", "label", "code", "error", "measured"])

    return run


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all entries' components in decimal digits, by position, entry and component."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))]) / SCALE


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over rows of the same label. A label may have most rows."""
    keyed = cut(coded.withColumns({"__label": F.coalesce(F.col("label").cast("string"), F.lit("")), "__none": F.col("label").isNull()}), "coded")
    by = keyed.groupBy("__label", "__none").agg(F.sum("error").alias("label_error"), F.count("*").alias("count"))
    by = cut(by, "label-errors")
    total = by.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return join_hot(keyed, by.drop("count"), ["__label", "__none"], counts=by.drop("label_error"), total=total).drop("__label", "__none")
