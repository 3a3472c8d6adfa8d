"""Token-ID output as a content-addressed store.

Each document's ids end with id 0. A rolling hash over the ids cuts the stream
of a document into chunks, so equal passages give equal chunks wherever they
stand. Every unique chunk is stored once, under the hash of its ids; a document
is a recipe, the list of its chunks' hashes; a Merkle root over them sits in the
recipe, and one over the roots of each recipe part in the manifest.

The store is three Parquet tables in one folder:

    staged/kind=chunk/   digest, n_ids, payload (little-endian unsigned 16- or 32-bit ids)
    recipes/             part, doc_id, start, n_tokens, chunks, lengths, root; ascending doc_id
    manifest/            part, documents, tokens, first start, Merkle root

staged/kind=recipe/ has the recipes as tasks wrote them, before they were put in order; nothing reads it afterwards.

Ids are taken as 64-bit numbers; a text id raises an error. Null doc_ids come first, equal doc_ids by their token counts and roots. A null
or empty text is the end id alone. An empty table gives an empty store. Two
rows with one doc_id are two documents, repeated rows too. A text of any length is cut into chunks like
others; its recipe is one row. Columns of other names aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudstrata.functions.joins import join_hot
from cloudstrata.llm.bpe import byte_alphabet, calm_gc
from cloudstrata.session import drop_folder

END_ID = 0
#: Ids that the rolling hash sees, the bits that must be zero at a cut, and the least and greatest chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
DIGEST_BYTES = 16
#: Digests a task remembers, so that a chunk that many documents share leaves a task a few times only.
SEEN = 200_000

_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def marks_of(ids: np.ndarray) -> np.ndarray:
    """The places after which a chunk may end. The hash of a place is a sum over the WINDOW ids before it, shifted by age, so it doesn't depend on what came earlier."""
    rolling = _GEAR[ids]
    span = 1
    while span < WINDOW:  # doubling: the sum over 2k ids from the sums over k
        earlier = rolling[:-span] << np.uint64(span)
        rolling[span:] += earlier
        span *= 2
    return np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + 1


def ends_of(marks: list[int], n: int) -> list[int]:
    """Where the chunks of n ids end: at marks that are LEAST or more behind the last end, and at MOST ids."""
    ends, last = [], 0
    for c in [*marks, n]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    if last < n:
        ends.append(n)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks of one stream end."""
    return ends_of(marks_of(ids & 0xFFFF).tolist(), len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves, in order; an odd one moves up alone. Leaves and inner nodes are hashed with different prefixes."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _shift_tables(n: int) -> np.ndarray:
    """crc32 of x followed by n zero bytes, without its constant part, by byte of the crc: four tables of 256."""
    rows = np.zeros(32, np.uint32)
    base = zlib.crc32(bytes(n), 0)
    for bit in range(32):
        rows[bit] = zlib.crc32(bytes(n), 1 << bit) ^ base
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            v = np.uint32(0)
            for bit in range(8):
                if b >> bit & 1:
                    v ^= rows[8 * k + bit]
            tables[k, b] = v
    return tables


_shifts: dict[int, list[list[int]]] = {}


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """crc32(a + b) of crc32(a), crc32(b) and len(b)."""
    if right_bytes not in _shifts:
        _shifts[right_bytes] = _shift_tables(right_bytes).tolist()
    t = _shifts[right_bytes]
    return t[0][left & 255] ^ t[1][left >> 8 & 255] ^ t[2][left >> 16 & 255] ^ t[3][left >> 24] ^ right


#: Bytes of text that are encoded together.
BLOCK_BYTES = 6 << 20


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BLOCK_BYTES of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
    at = 0
    for n in np.unique(block, return_counts=True)[1].tolist():
        yield batch.slice(at, n)
        at += n


_tokenizers: dict = {}


class LibraryEncoder:
    """The ids of texts by the tokenizers library.

    A space between two characters that aren't white space always begins a
    pre-token of the byte-level pattern, and pre-tokens are encoded one by one.
    So pieces between such spaces are looked up whole. A piece of letters, marks,
    letters and marks is put together from these: words go to the library's model
    once and are kept, with and without a space before them; so do runs of marks, by the whole
    library, of which there are few. All other pieces go through the whole library.
    """

    #: Letters (to be looked at again, if not ASCII), marks and digits, one line feed, letters, marks and digits.
    PARTS = r"^(?P<a>[^\x00-@\[-`{-\x7f]*)(?:(?P<m>[!-@\[-`{-~]+\n?|\n)(?:(?P<b>[^\x00-@\[-`{-\x7f]+)(?P<n>[!-@\[-`{-~]*))?)?$"

    def __init__(self, path: str, entries: int = 1_100_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.kind = "<u4" if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as a character
        self.letters = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.space = byte_alphabet()[32]
        self.entries = entries
        #: Words and their ids as bytes; a word without a space before it has a line feed there.
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.large_binary())
        self.others: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> pa.Array:
        """The ids of new words by the library's model."""
        tokenize, space, letters = self.model.tokenize, self.space, self.letters
        found = []
        for w in words.to_pylist():
            before, w = ("", w[1:]) if w[0] == "\n" else (space, w)
            found.append([t.id for t in tokenize(before + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of different words; new ones are kept, and beyond `entries` the older ones go."""
        # the table is looked up in the words, as that hashes the fewer of the two
        at = pc.index_in(self.words, words)
        place = np.full(len(words), -1, np.int64)
        place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            place[unknown] = len(self.words) + np.arange(len(unknown))
            new = words.take(pa.array(unknown))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self._learn(new)])
        found = self.ids.take(pa.array(place))
        if len(self.words) > self.entries:
            older = len(self.words) - self.entries // 2
            self.words, self.ids = self.words.slice(older), self.ids.slice(older)
        return found

    def _others(self, parts: pa.Array) -> pa.Array:
        """The ids of different parts, each taken alone by the whole library."""
        if len(self.others) > 100_000:
            self.others = {}
        known, parts = self.others, parts.to_pylist()
        new = [p for p in parts if p not in known]
        fresh = dict(zip(new, self.whole(new), strict=True))
        known.update((p, d) for p, d in fresh.items() if len(p) <= 64)
        return pa.array([fresh[p] if p in fresh else known[p] for p in parts], pa.large_binary())

    def _pieces(self, pieces: pa.Array, space: str) -> tuple[pa.Array, np.ndarray]:
        """The ids of a space (or nothing) and each piece, as bytes, and which pieces can't be taken alone after a space."""
        none = pa.scalar(None, pa.string())
        found = pc.extract_regex(pieces, self.PARTS)
        a, m, b, n = (pc.if_else(pc.equal(part, ""), none, part) for part in found.flatten())
        letters = pc.and_(pc.fill_null(pc.utf8_is_alpha(a), True), pc.fill_null(pc.utf8_is_alpha(b), True))
        # an apostrophe may belong to the letters behind it, a line feed at an end to the space there
        apart = pc.invert(pc.and_(pc.fill_null(pc.ends_with(m, "'"), False), b.is_valid()))
        inner = pc.invert(pc.or_(pc.or_(pc.starts_with(pieces, "\n"), pc.ends_with(pieces, "\n")), pc.equal(pieces, "")))
        fits = pc.and_(pc.and_(found.is_valid(), letters), pc.and_(apart, inner))
        for t in self.special:
            fits = pc.and_(fits, pc.invert(pc.match_substring(pieces, t)))
        rest = np.flatnonzero(~fits.to_numpy(zero_copy_only=False))
        odd = np.zeros(len(pieces), bool)
        if space:
            odd[rest] = [not p or p[0].isspace() or p[-1].isspace() for p in pieces.take(pa.array(rest)).to_pylist()]
        a, b, n = (pc.if_else(fits, part, none) for part in (a, b, n))
        m = pc.if_else(pa.array(odd), none, pc.if_else(fits, m, pieces))

        def after(before: str, part: pa.Array) -> pa.Array:
            return pc.binary_join_element_wise(before, part, "") if before else part

        words = pa.concat_arrays([a if space else after("\n", a), after("\n", b)]).dictionary_encode()
        others = pa.concat_arrays([pc.if_else(a.is_valid(), m, after(space, m)), n]).dictionary_encode()
        word_ids = self._words(words.dictionary).take(words.indices).fill_null(b"")
        other_ids = self._others(others.dictionary).take(others.indices).fill_null(b"")
        k = len(pieces)
        return pc.binary_join_element_wise(word_ids[:k], other_ids[:k], word_ids[k:], other_ids[k:], pa.scalar(b"", pa.large_binary())), odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and the last ends."""
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        codes, ends = coded.indices.to_numpy().copy(), split.offsets.to_numpy()
        data, odd = self._pieces(coded.dictionary, " ")
        whole = np.zeros(len(texts), bool)
        if odd.any():
            bad = odd[codes]
            bad[ends[:-1]] = False
            whole = np.add.reduceat(bad, ends[:-1]) > 0
        # the first piece of a text has no space before it, and its end may be white space
        first = split.values.take(pa.array(ends[:-1]))
        whole |= np.array([not h or h[-1].isspace() for h in first.to_pylist()], bool)
        heads = first.filter(pa.array(~whole)).dictionary_encode()
        head_data, _ = self._pieces(heads.dictionary, "")
        at_head = np.zeros(len(texts), np.int32)
        at_head[~whole] = len(data) + heads.indices.to_numpy()
        at_head[whole] = len(data) + len(head_data) + np.arange(whole.sum())
        codes[np.repeat(whole, np.diff(ends))] = len(data) + len(head_data) + whole.sum()  # nothing
        codes[ends[:-1]] = at_head
        whole_data = pa.array([*self.whole(texts.filter(pa.array(whole)).to_pylist()), b""], pa.large_binary())
        taken = pa.concat_arrays([data, head_data, whole_data]).take(pa.array(codes))
        _, offsets, ids = taken.buffers()
        width = np.dtype(self.kind).itemsize
        total = np.frombuffer(offsets, np.int64, len(codes) + 1)[ends] // width
        return np.frombuffer(ids or b"", self.kind, int(total[-1])), total


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = LibraryEncoder(path)
    return _tokenizers[path]


_STAGED = "kind string, key binary, digest binary, doc_id long, n_ids int, payload binary, chunks array<binary>, lengths array<int>"
_STAGED_ARROW = pa.schema(
    [("kind", pa.string()), ("key", pa.binary()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("chunks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))]
)


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of docs' texts by the vocabulary at path, and returns the folder.

    One pass encodes and cuts; one shuffle brings equal chunks together, each
    task having sent a chunk once; recipes travel along and are then put in order.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(path)
        with calm_gc():
            task = TaskContext.get()
            serial = (task.partitionId() if task else 0) << 40
            end_id = np.array([END_ID], encoder.kind).tobytes()
            width = len(end_id)
            seen: set[bytes] = set()
            for batch in batches:
                for part in blocks(batch, 1):
                    ids, ends = encoder.encode(part.column(1))
                    # no chunk ends within LEAST ids of a document's begin, so no mark that counts has seen ids of another
                    marks = marks_of(ids & 0xFFFF)
                    of_doc = np.searchsorted(marks, ends, "right").tolist()
                    marks = marks.tolist()
                    rows: list[tuple] = []
                    for doc_id, b, e, m, k in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist(), of_doc, of_doc[1:], strict=False):
                        data = ids[b:e].tobytes() + end_id
                        names, lengths, begin = [], [], 0
                        for end in ends_of([x - b for x in marks[m:k]], e - b + 1):
                            chunk = data[width * begin : width * end]
                            names.append(name := digest(chunk))
                            lengths.append(end - begin)
                            if name not in seen:
                                seen.add(name)
                                rows.append(("chunk", name, name, None, end - begin, chunk, None, None))
                            begin = end
                        serial += 1
                        rows.append(("recipe", serial.to_bytes(9, "big"), merkle(names), doc_id, len(data) // width, None, names, lengths))
                    if len(seen) > SEEN:
                        seen.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _STAGED_ARROW.types, strict=True)], schema=_STAGED_ARROW)

    staged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, _STAGED)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a recipe's key is its own; of a chunk's, at most one row for each task comes here
    once = staged.repartition(n, "key").withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("kind"))).filter("nth = 1")
    once.drop("nth", "key").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").partitionBy("kind").parquet(f"{folder}/staged")
    kept = spark.read.schema(_STAGED).parquet(f"{folder}/staged")
    _order_recipes(spark, kept.filter("kind = 'recipe'"), folder)
    return folder


def _order_recipes(spark: SparkSession, recipes: DataFrame, folder: str) -> None:
    """Recipes in ascending doc_id order with the ids before each. Parts are ranges of doc_id; only a count per part comes to the driver."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_ids"), F.col("digest")]
    parted = recipes.select("doc_id", "n_ids", "digest", "chunks", "lengths").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    parted.write.parquet(f"{folder}/parted")
    parted = spark.read.parquet(f"{folder}/parted")
    sums = sorted((r["part"], r["n"]) for r in parted.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, count in sums:
        starts[part] = total
        total += count
    first = F.lit(0).cast("long")
    if starts:
        first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.col("part").cast("long"))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    (
        parted.withColumn("start", first + F.coalesce(F.sum(F.col("n_ids").cast("long")).over(within), F.lit(0)))
        .select("part", "doc_id", "start", F.col("n_ids").cast("long").alias("n_tokens"), "chunks", "lengths", F.col("digest").alias("root"))
        .write.parquet(f"{folder}/recipes")
    )
    drop_folder(spark, f"{folder}/parted")
    _write_manifest(spark, folder)


def _write_manifest(spark: SparkSession, folder: str) -> None:
    """A row for each part: its counts and the Merkle root over the recipes' roots in order, built from groups of 1024 so that no task holds a part's recipes."""
    root = F.udf(lambda leaves: merkle([bytes(x) for x in leaves]), "binary")
    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "start", "n_tokens", "root")
    blocks = recipes.withColumn("block", F.floor((F.row_number().over(W.partitionBy("part").orderBy("start")) - 1) / 1024))
    groups = blocks.groupBy("part", "block").agg(
        F.sort_array(F.collect_list(F.struct("start", "root"))).alias("leaves"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("start").alias("start")
    )
    groups = groups.select("part", "block", "documents", "tokens", "start", root(F.expr("transform(leaves, x -> x.root)")).alias("root"))
    parts = groups.groupBy("part").agg(
        F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("block", "root"))).alias("leaves")
    )
    parts.select("part", "documents", "tokens", "start", root(F.expr("transform(leaves, x -> x.root)")).alias("root")).write.parquet(f"{folder}/manifest")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n_ids, payload of the store's unique chunks."""
    return spark.read.schema(_STAGED).parquet(f"{folder}/staged").filter("kind = 'chunk'").select("digest", "n_ids", "payload")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of every document, put together from recipes and chunks."""

    def join_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column(2).to_pylist():
                parts = sorted(parts, key=lambda p: p["pos"])
                ids.append(np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n_ids']}") for p in parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("pos", "digest"))
    joined = join_hot(recipes, read_chunks(spark, folder), ["digest"]).groupBy("doc_id", "start").agg(F.collect_list(F.struct("pos", "n_ids", "payload")).alias("parts"))
    return joined.mapInArrow(join_payloads, "doc_id long, start long, ids array<long>")


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and intact of every document, from the files.

    Each stored chunk is hashed again; its crc32 joins the recipes by digest, and
    the crc32 of a document follows from those of its chunks, so payloads don't
    travel. intact: all chunks are there, hold what their names say, have the
    lengths of the recipe, and their names have the recipe's Merkle root.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, data = (batch.column(c).to_pylist() for c in range(3))
            good = [digest(d) == n for n, d in zip(names, data, strict=True)]
            crc = [zlib.crc32(np.frombuffer(d, "<u2").astype("<u4")) if len(d) == 2 * c else zlib.crc32(d) for c, d in zip(counts, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(crc, pa.int64()), pa.array(good)], names=["digest", "n_ids", "crc", "good"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4)
            ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            inner = parts.flatten()
            numbers = [pc.fill_null(inner.field(k).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5)]
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            order = np.lexsort((numbers[0], doc))
            _, length, n_ids, crc, good = (v[order] for v in numbers)
            names = inner.field(1).take(pa.array(order)).to_pylist()
            sound = np.logical_and.reduceat((good == 1) & (length == n_ids), ends[:-1]) & (np.add.reduceat(length, ends[:-1]) == batch.column(2).to_numpy())
            crc, size = crc.tolist(), (4 * n_ids).tolist()
            crcs, intact = [], []
            for root, ok, b, e in zip(batch.column(3).to_pylist(), sound.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                total = crc[b]
                for k in range(b + 1, e):
                    total = crc32_join(total, crc[k], size[k])
                crcs.append(total)
                intact.append(ok and merkle(names[b:e]) == root)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64()), pa.array(intact)], names=["doc_id", "start", "n_tokens", "ids_crc32", "intact"])

    checked = read_chunks(spark, folder).select("digest", "n_ids", "payload").mapInArrow(check, "digest binary, n_ids int, crc long, good boolean")
    steps = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("chunks", "lengths")).alias("pos", "c"))
    steps = steps.select("doc_id", "start", "n_tokens", "root", "pos", F.col("c.chunks").alias("digest"), F.col("c.lengths").alias("length"))
    parts = join_hot(steps, checked, ["digest"], "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.collect_list(F.struct("pos", "digest", "length", "n_ids", "crc", "good")).alias("parts"))
    return parts.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long, intact boolean")
