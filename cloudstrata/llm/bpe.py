"""BPE encoding and decoding.

Merging keeps the symbols of a word in a doubly linked list and the ranks of
its adjacent pairs in a heap. A merge leaves old heap entries behind; they are
recognised as stale, because each left symbol remembers the rank of its pair.
So a word of n bytes costs n log n, also where a text is one word of megabytes.

Results are those of the tokenizers library with the same file, with
add_special_tokens=False and without truncation and padding: its special
tokens are found in texts first, the rest is split by the byte-level pattern.

Null and empty texts have no ids and decode to the empty text; rows keep their
order, number and repetition; a null doc_id stays null. An empty table has no rows;
columns of other names aren't read.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import heapq
import json
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed by the file format: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of a generation of the caches, and the longest piece that is cached.
CACHE_ENTRIES = 240_000
OTHER_ENTRIES = 40_000
CACHE_CHARS = 48


class TwoGenerations(dict):
    """A cache of bounded size: a full generation becomes the old one, and what is asked for again moves to the new one."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            self[key] = value
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@contextmanager
def calm_gc():
    """No cyclic collection within: traversing large caches is costly, and nothing here makes cycles while it runs.

    What earlier tasks of the process left is collected first, and free memory goes
    back to the system before and after, as workers live on between stages.
    """
    gc.collect()
    release_memory()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        release_memory()


def release_memory() -> None:
    """Gives back what Arrow's pool and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class SpaceAtEdge(ValueError):
    """A piece whose neighbours must be encoded together with it."""


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.of_byte = [vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 20 | vocab[right]] = k
            self.merged.append(vocab[left + right])
        self.find = regex.compile(PATTERN).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words = TwoGenerations(self.merge, OTHER_ENTRIES)
        self.pieces = TwoGenerations(self.piece)

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        symbols = [*map(self.of_byte.__getitem__, word.encode())]
        n = len(symbols)
        rank = self.rank.get
        pair_rank = [rank(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        heap = [r * n + i for i, r in enumerate(pair_rank) if r >= 0]
        if not heap:
            return tuple(symbols)
        heapq.heapify(heap)
        pair_rank.append(-1)
        after, before, merged = [*range(1, n + 1)], [*range(-1, n - 1)], self.merged
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            entry = pop(heap)
            r = entry // n
            i = entry - r * n
            if pair_rank[i] != r:
                continue  # stale: the pair at i has changed or is gone
            j = after[i]
            new = symbols[i] = merged[r]
            symbols[j] = pair_rank[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair_rank[i] = q = rank(new << 20 | symbols[k], -1)
                if q >= 0:
                    push(heap, q * n + i)
            else:
                pair_rank[i] = -1
            h = before[i]
            if h >= 0:
                pair_rank[h] = q = rank(symbols[h] << 20 | new, -1)
                if q >= 0:
                    push(heap, q * n + h)
        return tuple([s for s in symbols if s >= 0])

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a space and a piece; SpaceAtEdge if it begins or ends with white space or is empty."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise SpaceAtEdge
        if piece.isalpha():
            return self.merge(" " + piece)
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        return tuple(self.encode_part(" " + piece))

    def encode_part(self, text: str) -> list[int]:
        """The ids of a text by the pattern, with nothing assumed about it."""
        words, out = self.words, []
        for k, part in enumerate(self.cut_special(text) if self.cut_special and any(t in text for t in self.special) else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(map(words.__getitem__, self.find(part)))
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text.

        A space between two characters that aren't white space always begins a
        pre-token, so the pieces between such spaces can be looked up whole.
        """
        if not text:
            return []
        first, *rest = text.split(" ")
        if not rest:
            return self.encode_part(text)
        if first and not first[-1].isspace():
            try:
                return [*self.encode_part(first), *chain.from_iterable(map(self.pieces.__getitem__, rest))]
            except SpaceAtEdge:
                pass
        out, run = [], [first]
        ends = not first or first[-1].isspace()
        for p in rest:
            if ends or not p or p[0].isspace():
                run.append(p)
            else:
                out += self.run_ids(run, not out and run[0] is first)
                run = [p]
            ends = not p or p[-1].isspace()
        return out + self.run_ids(run, not out and run[0] is first)

    def run_ids(self, run: list[str], at_start: bool) -> list[int]:
        if at_start:
            return self.encode_part(" ".join(run))
        return self.encode_part(" " + " ".join(run))

    def decode(self, ids) -> str:
        """The text of ids: their vocabulary strings, one after another."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def id_text(self, ids) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a file, built once in a process."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


#: What encode_documents can return for each document.
OUTPUTS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the outputs, each of OUTPUTS. Other columns of docs aren't read."""
    id_type = dict(docs.dtypes)[id_col]
    kinds = [OUTPUTS[o] for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        with calm_gc():
            decodes = {"decoded", "decoded_sha256"} & {*outputs}
            for batch in batches:
                made: dict[str, list] = {o: [] for o in outputs}
                for text in batch.column(1).to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids) if decodes else None
                    for o, values in made.items():
                        values.append(
                            ids if o == "ids" else len(ids) if o == "n_tokens" else decoded if o == "decoded"
                            else hashlib.sha256((bpe.id_text(ids) if o == "ids_sha256" else decoded).encode()).hexdigest()
                        )
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[o], kind) for o, (kind, _) in zip(outputs, kinds, strict=True))], names=[id_col, *outputs])

    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{o} {sql}" for o, (_, sql) in zip(outputs, kinds, strict=True))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
