"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 percent or more.

Rare-first prefix filtering (Chaudhuri et al. 2006; Bayardo et al. 2007; Xiao et
al. 2008): shingles are ordered by how many texts hold them, rarest first. Two
sets as similar as asked must share a shingle among the first
n - ceil(0.8 n) + 1 of each, so only those prefixes are joined. A shingle that
only one text has comes first and joins nothing; most texts have enough of
those to drop out before any join.

Steps, each written to the shared folder:

1. shred: texts to sorted 64-bit shingle hashes. A block of texts leaves a task
   as one binary row per hash range; equal texts of a block leave once.
2. count: each hash range counts the texts of its shingles and returns those
   that two or more hold. A shingle that is frequent within a block sends its
   count to its range, and its texts elsewhere, so no task gets them all.
3. order: each text gets its shared shingles, rarest first, and its prefix.
4. join: prefixes are joined on the shingle. First every text is compared with
   one text only, that with the least share of shingles of its own among those it
   shares most prefix shingles with. Shingles whose texts are all linked then
   need nothing more. Texts that share any other prefix shingle form clusters;
   clusters are cut into blocks of at most BLOCK_TEXTS by size and hash, and for
   each pair of blocks whose sizes can match, a task joins the prefixes, applies
   the length, positional and suffix filters and verifies each pair that isn't
   linked yet, once.
5. components over the links.

A word is what lies between ASCII white space, with A-Z lower-cased. A text of
fewer words than a shingle is one shingle; null, empty and blank texts have none
and link with nothing. Rows with one doc_id are different documents; a null
doc_id takes part but never names a component that has another id. Texts with
equal sets are one class, by a 64-bit hash of the set. Repeated rows are rows of
one class; very long texts are sets like others; other columns, whatever their
names, aren't read. An empty table has no components. Ids are taken as 64-bit numbers; a text id raises an error.
Shingles are compared by their whole 64-bit hashes, and sets are named by one, too: among 10^8 different texts two
sets have one name with a chance of about 3 in 10,000, among 10^10 nearly always some have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.graph import connected_components
from cloudstrata.functions.joins import SALT, copied, dealt, hot_keys, join_hot
from cloudstrata.llm.bpe import calm_gc
from cloudstrata.llm.texts import TEXT_NAME, same_row, text_name
from cloudstrata.session import cut

WORDS, SIMILAR = 5, 80
#: Shingles of a block; bytes of text for a hash range (a text's name goes to each range that it has shingles in, so small ranges cost disk); texts of a block from which a shingle counts as frequent there.
BLOCK, RANGE_BYTES, FREQUENT = 1_000_000, 24 << 20, 256
#: A large table's hash ranges are counted in so many rounds, each over all texts: the shuffle files of a round are gone before the next, so they take a third of the disk at a time.
ROUNDS = 3
#: Counts of shingles are told up to this number; beyond, they are equally frequent, and in the order of their hashes.
MOST_COUNT = 65_535
#: Texts of a block of a cluster, and of its candidate pairs how many are verified one by one rather than by a matrix product.
BLOCK_TEXTS, FEW = 256, 400

_U = np.uint64
_FOLD = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _MIX
    h ^= h >> _U(29)
    h *= _MIX
    h ^= h >> _U(32)
    return h


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    size = min(words, n)
    h = w[: n - size + 1].copy()
    for k in range(1, size):
        h ^= h >> _U(31)
        h *= _FOLD
        h += w[k : n - size + 1 + k]
    h += _U(size)
    h = _mixed(h)
    h.sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return begin, np.diff(np.append(begin, len(sorted_values)))


def _pack(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, *columns: np.ndarray) -> bytes:
    return np.uint32(len(keys)).tobytes() + keys.tobytes() + sizes.astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes() + b"".join(c.tobytes() for c in columns)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    at = 4 + 8 * n
    return np.frombuffer(data, np.uint64, n, 4), np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint32, n, at + 4 * n), at + 8 * n


_ROWS = "bucket long, kind string, payload binary, doc_id long, key long, n long, t1 long, t2 long"
_ROWS_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("payload", pa.binary()), *((c, pa.int64()) for c in ("doc_id", "key", "n", *TEXT_NAME))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of _ROWS; those of other kinds than "doc" may end before the name of a text."""
    rows = [r if len(r) == 8 else (*r, None, None) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _ROWS_ARROW.types, strict=True)], schema=_ROWS_ARROW)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield _batch(rows)


def _width(bits: int) -> int:
    """Bytes of a hash beside those bits that its range tells."""
    return -(-(64 - bits) // 8)


def _shred_block(sets: list[np.ndarray], keys: list[int], bits: int, salt: int, least: int, turn: int = 0, rounds: int = 1) -> list[tuple]:
    """The rows of a block of sets: what the range doesn't tell of each hash, by range, or counts and texts of what `least` texts of the block or more have. Only hashes of this turn's ranges."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    if rounds > 1:
        own = (hashes >> _U(64 - bits)) % _U(rounds) == turn
        hashes, owner = hashes[own], owner[own]
    names = np.array(keys, np.int64).view(np.uint64)
    rows: list[tuple] = []
    slots = (hashes & _U((1 << 21) - 1)).astype(np.int64)
    often = np.bincount(slots, minlength=1 << 21)[slots] >= least
    if often.any():
        where = np.flatnonzero(often)
        where = where[np.argsort(hashes[where], kind="stable")]
        begin, count = _runs(hashes[where])
        for b, c in zip(begin.tolist(), count.tolist(), strict=True):
            if c >= least:
                own = where[b : b + c]
                h = hashes[own[0]]
                rows.append((int(h >> _U(64 - bits)) if bits else 0, "frequent", h.tobytes(), None, None, c))
                rows.append((hash((salt, int(h))) % (1 << bits), "texts", _pack(names[owner[own]], sizes[owner[own]], np.ones(c), hashes[own[:1]]), None, int(h.astype(np.int64)), None))
            else:
                often[where[b : b + c]] = False
        hashes, owner = hashes[~often], owner[~often]
    bucket = (hashes >> _U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(hashes), np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    low = hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(bits)]
    begin, count = _runs(bucket)
    for b, c in zip(begin.tolist(), count.tolist(), strict=True):
        own = owner[b : b + c]
        first, times = _runs(own)
        who = own[first]
        rows.append((int(bucket[b]), "some", _pack(names[who], sizes[who], times, low[b : b + c]), None, None, None))
    return rows


def _shred(words: int, bits: int, turn: int = 0, rounds: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with calm_gc():
            task = TaskContext.get()
            salt = (task.partitionId() if task else 0) << 20
            parts = 1 << bits
            sets: list[np.ndarray] = []
            keys: dict[int, None] = {}
            held = 0
            for batch in batches:
                docs: list[tuple] = []
                for doc_id, text, *name in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    found = shingle_set(text, words)
                    key = set_key(found)
                    docs.append((doc_id % parts if doc_id is not None else key & (parts - 1), "doc", None, doc_id, key, len(found), *name))
                    if len(found) and key not in keys:
                        keys[key] = None
                        sets.append(found)
                        held += len(found)
                        if held >= BLOCK:
                            salt += 1
                            yield from _batches(_shred_block(sets, [*keys], bits, salt, FREQUENT, turn, rounds))
                            sets, held = [], 0
                            keys.clear()
                if docs and not turn:
                    yield _batch(docs)
            if sets:
                yield from _batches(_shred_block(sets, [*keys], bits, salt + 1, FREQUENT, turn, rounds))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of one bucket after another; they come sorted by bucket."""
    at, held = None, []
    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", *columns)]
        for bucket, *row in zip(*values, strict=True):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append(tuple(row))
    if held:
        yield at, held


def _route(keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Rows that bring (hash, count) to the bucket of each key."""
    order = np.argsort(keys, kind="stable")
    keys, sizes, hashes, counts = keys[order], sizes[order], hashes[order], counts[order]
    target = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    rows = []
    for b, c in zip(*map(np.ndarray.tolist, _runs(target)), strict=True):
        part = slice(b, b + c)
        first, times = _runs(keys[part])
        rows.append((int(target[b]), "shared", _pack(keys[part][first], sizes[part][first], times, hashes[part], np.minimum(counts[part], MOST_COUNT).astype(np.uint16)), None, None, None))
    return rows


def _count(bits: int):
    """Of each hash range, what two or more texts hold, routed to the texts; and how many hold what was frequent in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, ("kind", "payload", "doc_id", "key", "n", *TEXT_NAME)):
            out = [(bucket, *r) for r in rows if r[0] in ("doc", "texts")]
            frequent: dict[int, int] = {}
            for kind, payload, _, _, n, *_ in rows:
                if kind == "frequent":
                    h = int(np.frombuffer(payload, np.uint64)[0])
                    frequent[h] = frequent.get(h, 0) + n
            parts = [_unpack(r[1]) for r in rows if r[0] == "some"]
            data = [r[1] for r in rows if r[0] == "some"]
            known = np.array(sorted(frequent), np.uint64)
            extra = np.array([frequent[h] for h in sorted(frequent)], np.int64)
            if parts:
                keys, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                owner = np.repeat(np.arange(len(keys), dtype=np.int32), np.concatenate([p[2] for p in parts]))
                width = _width(bits)
                low = np.concatenate([np.frombuffer(d, np.uint8, offset=p[3]).reshape(-1, width) for d, p in zip(data, parts, strict=True)])
                wide = np.zeros((len(low), 8), np.uint8)
                wide[:, :width] = low
                hashes = wide.view("<u8").ravel()
                if bits:  # the lowest byte may hold some bits of the range, too
                    hashes &= _U((1 << (64 - bits)) - 1)
                    hashes |= _U(bucket) << _U(64 - bits)
                del low, wide, parts, data
                order = np.argsort(hashes)
                hashes = hashes[order]
                begin, times = _runs(hashes)
                shared = np.repeat((times >= 2) | np.isin(hashes[begin], known), times)
                hashes, owner = hashes[shared], owner[order[shared]]
                name, size = keys[owner], sizes[owner]
                order = np.lexsort((name, hashes))
                hashes, name, size = hashes[order], name[order], size[order]
                if len(hashes):  # a text that several blocks hold counts once
                    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (name[1:] != name[:-1])])
                    hashes, name, size = hashes[new], name[new], size[new]
                    begin, times = _runs(hashes)
                    total = times.copy()
                    if len(known):
                        at = np.clip(np.searchsorted(known, hashes[begin]), 0, len(known) - 1)
                        hit = known[at] == hashes[begin]
                        total = total + np.where(hit, extra[at], 0)
                        for h, t in zip(known[at][hit].tolist(), times[hit].tolist(), strict=True):
                            frequent[h] += t
                    total = np.repeat(total, times)
                    keep = total >= 2
                    out += _route(name[keep], size[keep], hashes[keep], total[keep], bits)
            out += [(bucket, "count", None, None, int(np.uint64(h).astype(np.int64)), n) for h, n in frequent.items()]
            if out:
                for at in range(0, len(out), 2000):
                    yield _batch(out[at : at + 2000])

    return run


def _join_frequent(bits: int):
    """Texts of frequent shingles with their counts, routed like the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, sizes, _, at = _unpack(payload)
                h = np.frombuffer(payload, np.uint64, 1, at)
                yield _batch(_route(keys, sizes, np.repeat(h, len(keys)), np.full(len(keys), min(n, 2**32 - 1), np.uint32), bits))

    return run


_ORDERED = "kind string, shingle long, key long, n int, alone int, prefix binary, hashes binary"
_ORDERED_ARROW = pa.schema([("kind", pa.string()), ("shingle", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("alone", pa.int32()), ("prefix", pa.binary()), ("hashes", pa.binary())])


def _order(similar: int):
    """Each text's shared shingles, rarest first: its prefix, and its set of shared shingles if the prefix isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches, ("payload",)):
            parts = [(r[0], _unpack(r[0])) for r in rows]
            key = np.concatenate([np.repeat(p[0], p[2]) for _, p in parts])
            size = np.concatenate([np.repeat(p[1], p[2]) for _, p in parts]).astype(np.int64)
            hashes = np.concatenate([np.frombuffer(d, np.uint64, int(p[2].sum()), p[3]) for d, p in parts])
            count = np.concatenate([np.frombuffer(d, np.uint16, offset=p[3] + 8 * int(p[2].sum())) for d, p in parts])
            # a frequent shingle may bring one text from several blocks
            order = np.lexsort((hashes, count, key))
            key, size, hashes, count = key[order], size[order], hashes[order], count[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])])
            key, size, hashes = key[new], size[new], hashes[new]
            begin, times = _runs(key)
            n = size[begin]
            alone = n - times
            prefix = n - -(-similar * n // 100) + 1
            take = np.clip(prefix - alone, 0, times)
            rank = np.arange(len(key)) - np.repeat(begin, times)
            inside = rank < np.repeat(take, times)
            m = int(inside.sum())
            none = pa.nulls
            if m:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["prefix"] * m), pa.array(hashes[inside].view(np.int64)), pa.array(key[inside].view(np.int64)), pa.array(size[inside].astype(np.int32)),
                        pa.array(np.repeat(alone, times)[inside].astype(np.int32)), none(m, pa.binary()), none(m, pa.binary()),
                    ], schema=_ORDERED_ARROW,
                )
                kept = np.flatnonzero(take > 0)
                for at in range(0, len(kept), 1000):
                    own = kept[at : at + 1000]
                    first = [hashes[b : b + t].tobytes() for b, t in zip(begin[own].tolist(), take[own].tolist(), strict=True)]
                    data = [np.sort(hashes[b : b + t]).tobytes() for b, t in zip(begin[own].tolist(), times[own].tolist(), strict=True)]
                    k = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(["set"] * k), none(k, pa.int64()), pa.array(key[begin[own]].view(np.int64)), pa.array(n[own].astype(np.int32)), pa.array(alone[own].astype(np.int32)),
                            pa.array(first, pa.binary()), pa.array(data, pa.binary()),
                        ], schema=_ORDERED_ARROW,
                    )

    return run


def needed(nx: int, ny: int, similar: int = SIMILAR) -> int:
    """The least overlap of two sets of these sizes that is similar enough."""
    return -(-similar * (nx + ny) // (100 + similar))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least the overlap of two sorted sets, by halving them at a common pivot."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    at = int(np.searchsorted(x, pivot))
    return suffix_bound(x[:at], y[: len(y) // 2], depth - 1) + suffix_bound(x[at:], y[len(y) // 2 :], depth - 1)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _verify(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """a, b of the pairs that are similar enough. Many a may have one b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(c) for c in range(2, 6))
            keep = []
            for nx, ny, x, y in zip(na.to_pylist(), nb.to_pylist(), xa, xb, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least = needed(nx, ny, similar)
                keep.append(suffix_bound(x, y) >= least and overlap(x, y) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("xa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("xb"))
    hot, on = hot_keys(pairs, ["b"]), ["b"]
    if hot is not None:
        pairs, two, on = dealt(pairs, on, hot), copied(two, on, hot), ["b", SALT]
    return pairs.join(one, "a").join(two, on).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


class _Block:
    """Texts of a block: names, sizes, labels, and prefixes and sets with the number of the text beside each shingle."""

    def __init__(self, rows: list[dict]):
        self.key = np.array([r["key"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.hub = np.array([r["hub"] if r["hub"] is not None else r["key"] for r in rows], np.int64)
        self.sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        prefixes = [np.frombuffer(r["prefix"], np.uint64) for r in rows]
        counts = [len(p) for p in prefixes]
        self.prefix = np.concatenate(prefixes)
        self.owner = np.repeat(np.arange(len(rows)), counts)
        self.pos = np.concatenate([np.arange(c) + r["alone"] for c, r in zip(counts, rows, strict=True)])
        order = np.argsort(self.prefix, kind="stable")
        self.prefix, self.owner, self.pos = self.prefix[order], self.owner[order], self.pos[order]


def _candidates(x: _Block, y: _Block, same: bool, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers that share a prefix shingle and pass the length and positional filters, without those that are linked or were compared."""
    begin, end = np.searchsorted(y.prefix, x.prefix, "left"), np.searchsorted(y.prefix, x.prefix, "right")
    found: list[np.ndarray] = []
    times = end - begin
    ends = np.cumsum(times)
    at = 0
    while at < len(times):  # a bounded number of matches at a time
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
        t = times[at:upto]
        i = np.repeat(np.arange(at, upto), t)
        j = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(begin[at:upto], t)
        a, b = x.owner[i], y.owner[j]
        na, nb = x.n[a], y.n[b]
        bound = 1 + np.minimum(na - x.pos[i], nb - y.pos[j]) - 1
        keep = (100 * np.minimum(na, nb) >= similar * np.maximum(na, nb)) & (bound >= -(-similar * (na + nb) // (100 + similar))) & (x.label[a] != y.label[b])
        if same:
            keep &= a < b
        found.append(np.unique(a[keep] * len(y.key) + b[keep]))
        at = upto
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    a, b = pairs // max(len(y.key), 1), pairs % max(len(y.key), 1)
    new = (x.hub[a] != y.key[b]) & (y.hub[b] != x.key[a])
    return a[new], b[new]


def _overlaps(x: _Block, y: _Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlaps of all texts of two blocks, as a product of their incidence matrices, some shingles at a time."""
    ua, ub = np.unique(a), np.unique(b)
    hx, hy = np.concatenate([x.sets[k] for k in ua]), np.concatenate([y.sets[k] for k in ub])
    ox, oy = np.repeat(np.arange(len(ua)), [len(x.sets[k]) for k in ua]), np.repeat(np.arange(len(ub)), [len(y.sets[k]) for k in ub])
    both = np.intersect1d(hx, hy)
    px, py = np.searchsorted(both, hx), np.searchsorted(both, hy)
    px[px == len(both)] = py[py == len(both)] = 0
    kx, ky = (both[px] == hx, both[py] == hy) if len(both) else (np.zeros(len(hx), bool), np.zeros(len(hy), bool))
    px, ox, py, oy = px[kx], ox[kx], py[ky], oy[ky]
    total = np.zeros((len(ua), len(ub)), np.float32)
    for at in range(0, len(both), 8192):
        mx, my = np.zeros((len(ua), 8192), np.float32), np.zeros((len(ub), 8192), np.float32)
        inx, iny = (px >= at) & (px < at + 8192), (py >= at) & (py < at + 8192)
        mx[ox[inx], px[inx] - at] = 1
        my[oy[iny], py[iny] - at] = 1
        total += mx @ my.T
    return total[np.searchsorted(ua, a), np.searchsorted(ub, b)].astype(np.int64)


def block_links(x: _Block, y: _Block, same: bool, similar: int = SIMILAR, few: int = FEW) -> list[tuple[int, int]]:
    """Links between texts of two blocks that connect all that its similar pairs connect."""
    a, b = _candidates(x, y, same, similar)
    if not len(a):
        return []
    least = -(-similar * (x.n[a] + y.n[b]) // (100 + similar))
    if len(a) <= few:
        good = np.array([suffix_bound(x.sets[i], y.sets[j]) >= m and overlap(x.sets[i], y.sets[j]) >= m for i, j, m in zip(a.tolist(), b.tolist(), least.tolist(), strict=True)], bool)
    else:
        good = _overlaps(x, y, a, b) >= least
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    out = []
    for ka, kb, la, lb in zip(x.key[a[good]].tolist(), y.key[b[good]].tolist(), x.label[a[good]].tolist(), y.label[b[good]].tolist(), strict=True):
        ra, rb = find(la), find(lb)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((ka, kb))
    return out


def _verify_blocks(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                x = _Block(one.as_py())
                rows = two.as_py()
                out += block_links(x, x if rows is None else _Block(rows), rows is None, similar, FEW)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return run


def _links(prefixes: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links a, b between texts that connect all that similar pairs connect."""
    hub = F.min(F.struct((F.col("alone") * 100 / F.col("n")).cast("int").alias("own"), "key", "n")).alias("hub")
    groups = cut(prefixes.groupBy("shingle").agg(F.count("*").alias("count"), hub).filter("count > 1"), "jaccard-groups")
    counts = groups.select("shingle", "count")
    members = join_hot(prefixes, groups, ["shingle"], counts=counts)
    members = cut(members.select("shingle", "key", "n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "jaccard-members")
    near = members.filter(f"key <> hub and 100 * least(n, hub_n) >= {similar} * greatest(n, hub_n)")
    best = near.groupBy("key", "hub").count().groupBy("key").agg(F.max(F.struct("count", "hub")).alias("best"))
    tried = cut(best.select(F.col("key").alias("a"), F.col("best.hub").alias("b")), "jaccard-tried")
    links = cut(_verify(tried, sets, similar), "jaccard-links")
    labels = cut(connected_components(links, "a", "b").withColumnsRenamed({"node": "key", "component": "label"}), "jaccard-labels")
    labelled = cut(members.select("shingle", "key").join(labels, "key", "left").select("shingle", "key", F.coalesce("label", "key").alias("label")), "jaccard-labelled")
    # shingles whose texts have several labels; their texts form the clusters
    ends = labelled.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("key").alias("first")).filter("least <> most")
    edges = cut(join_hot(labelled, ends.select("shingle", "first"), ["shingle"], counts=counts).select("key", "first").distinct(), "jaccard-edges")
    clusters = cut(connected_components(edges, "key", "first").withColumnsRenamed({"node": "key", "component": "cluster"}), "jaccard-clusters")
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("texts"))
    # sizes whose quotient is at least `similar` percent are in the same or the next bin; small clusters are one block
    bins = F.floor(F.log("n") / F.lit(float(-1.001 * np.log(similar / 100))))
    rows = sets.join(clusters, "key").join(counts, "cluster").join(labels, "key", "left").join(tried.select(F.col("a").alias("key"), F.col("b").alias("hub")), "key", "left")
    rows = rows.withColumn("bin", F.when(F.col("texts") > BLOCK_TEXTS, bins).otherwise(0)).withColumn("part", F.when(F.col("texts") > BLOCK_TEXTS, F.pmod(F.xxhash64("key", "cluster"), F.ceil(2 * F.col("texts") / BLOCK_TEXTS))).otherwise(0))
    text = F.struct("key", "n", "alone", F.coalesce("label", "key").alias("label"), "hub", "prefix", "hashes")
    blocks = cut(rows.groupBy("cluster", "bin", "part").agg(F.collect_list(text).alias("rows")), "jaccard-blocks")
    names = blocks.select("cluster", "bin", "part")
    one, two = names.withColumnsRenamed({"bin": "bin1", "part": "part1"}), names.withColumnsRenamed({"bin": "bin2", "part": "part2"})
    pairs = one.join(two, "cluster").filter("(bin2 = bin1 and part2 > part1) or bin2 = bin1 + 1")
    left = blocks.withColumnsRenamed({"bin": "bin1", "part": "part1", "rows": "rows1"})
    right = blocks.withColumnsRenamed({"bin": "bin2", "part": "part2", "rows": "rows2"})
    across = pairs.join(left, ["cluster", "bin1", "part1"]).join(right, ["cluster", "bin2", "part2"]).select(F.hash("cluster", "bin1", "part1", "bin2", "part2").alias("deal"), "rows1", "rows2")
    within = blocks.select(F.hash("cluster", "bin", "part").alias("deal"), F.col("rows").alias("rows1"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("rows2"))
    more = within.unionByName(across).repartition("deal").select("rows1", "rows2").mapInArrow(_verify_blocks(similar), "a long, b long")
    return links.unionByName(cut(more, "jaccard-links"))


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with a shingle or more (doc_id, t1, t2, n, label, component_id), and those without (doc_id, t1, t2, n). Rows of a component have one label."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (max(1, size // RANGE_BYTES) - 1).bit_length())
    parts = max(n, 1 << bits)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *text_name(text_col))
    counted, rounds = None, ROUNDS if size > 2 * RANGE_BYTES else 1
    for turn in range(rounds):
        shredded = named.mapInArrow(_shred(words, bits, turn, rounds), _ROWS)
        part = cut(shredded.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(bits), _ROWS), "jaccard-counted")
        counted = part if counted is None else counted.unionByName(part)
    frequent = counted.filter("kind = 'count'").groupBy("key").agg(F.sum("n").alias("total"))
    texts = join_hot(counted.filter("kind = 'texts'").select("key", "payload"), frequent, ["key"]).select("payload", "total").mapInArrow(_join_frequent(bits), _ROWS)
    shared = counted.filter("kind = 'shared'").unionByName(texts)
    ordered = cut(shared.select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_order(similar), _ORDERED), "jaccard-ordered")
    links = _links(ordered.filter("kind = 'prefix'").select("shingle", "key", "n", "alone"), ordered.filter("kind = 'set'").select("key", "n", "alone", "prefix", "hashes"), similar)
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    rows = counted.filter("kind = 'doc'").select("doc_id", *TEXT_NAME, "key", "n")
    some = rows.filter("n > 0")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, "key", "left").select("key", "least", F.coalesce("component", "key").alias("label"))
    classes = cut(classes, "jaccard-classes")
    whole = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = join_hot(classes, whole, ["label"]).select("key", "label", "component_id")
    return join_hot(some, found, ["key"]).select("doc_id", *TEXT_NAME, "n", "label", "component_id"), rows.filter("n = 0").select("doc_id", *TEXT_NAME, "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links of 100 * overlap >= similar * union reach, of every row of docs."""
    linked, empty = _components(docs, id_col, text_col, words, similar)
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row of docs, unchanged, of each component, and all rows without a shingle.

    Of a component the row of the least doc_id stays, a null one being the greatest;
    of rows with one doc_id that of the least text name, and of rows that
    are equal in both any one.
    """
    rows = cut(_components(docs, "doc_id", "text", words, similar)[0].select("doc_id", *TEXT_NAME, "label"), "jaccard-rows")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *TEXT_NAME)
    several = rows.groupBy("label").agg(F.count("*").alias("rows"), F.min(name).alias("first")).filter("rows > 1").drop("rows")
    judged = join_hot(rows, several, ["label"]).groupBy("doc_id", *TEXT_NAME).agg(F.count("*").alias("rows"), F.max(name == F.col("first")).alias("stays"))
    judged = judged.filter("not stays or rows > 1").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", *TEXT_NAME)], "stays")
    judged = cut(judged, "jaccard-gone")
    kept = docs.join(judged, same_row(docs, judged), "left_anti")
    again = judged.filter("stays")  # rows that are there several times
    if not again.limit(1).count():
        return kept
    copies = docs.join(again, same_row(docs, again), "left_semi")
    keys = dict(zip(("__doc_id", "__t1", "__t2"), (F.col("doc_id"), *text_name("text")), strict=True))
    return kept.unionByName(copies.withColumns(keys).dropDuplicates([*keys]).drop(*keys))
