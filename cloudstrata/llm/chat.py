"""Chat formatting with a grammar round trip.

A turn is rendered as "<turn role>\n" + text + "\n</turn>\n". Text that could
be read as markup is escaped by one backslash before the control string, and
text that already looks escaped gets one more, so nothing is lost. The parser
is deterministic and reads only what the renderer may have written.
After rendering, each conversation is parsed again and compared with its
source. Escaping goes from none (no control string inside) over escaping the
control strings to escaping every line, until what is recovered is identical.

Rows with a null conv_id form a conversation of their own. Turns come in order
of turn, nulls first; equal turns in order of role and text. A null text is
empty, a null role is the empty role. Roles may hold any characters. Repeated rows
are repeated turns, other columns aren't read, an empty table has no conversations. conv_id is
taken as a 64-bit number; a text id raises an error.

Turns are sorted by conversation and streamed: a conversation is written in parts
of about PART characters, nearly always one, so a task holds a part and never a
whole conversation, however many turns it has; a turn of any length is one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What could be read as markup: our own tags and the role headers of common chat templates, after any number of backslashes.
INNER = re.compile(r"(\\*)(</?turn\b[^>\n]*>|### (?:User|Assistant|System):|<\|[a-z_]+\|>)")
OPEN = re.compile(r"<turn ([^>\n]*)>")
CLOSE = "</turn>"
#: Characters from which a part of a conversation is full.
PART = 1_000_000
ROLE_ESCAPES = {"%": "%25", ">": "%3E", "\n": "%0A"}


def _role_text(role: str) -> str:
    return re.sub(r"[%>\n]", lambda m: ROLE_ESCAPES[m[0]], role)


def _role_of(text: str) -> str:
    for c, e in reversed(ROLE_ESCAPES.items()):
        text = text.replace(e, c)
    return text


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: a backslash more before each control string; 2: a backslash before each line."""
    if level == 0:
        return text
    return INNER.sub(r"\\\1\2", text) if level == 1 else "\\" + text.replace("\n", "\n\\")


def unescape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return re.sub(r"\\(\\*)" + INNER.pattern[len(r"(\\*)"):], r"\1\2", text)
    return text[1:].replace("\n\\", "\n")


def render_turns(turns: list[tuple[str, str]], level: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns without a header, and the spans of assistant texts in it: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {_role_text(role)}>\n", escape(text, level)
        parts += [head, body, f"\n{CLOSE}\n"]
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE) + 2
    return "".join(parts), spans


def header(level: int) -> str:
    return f"<chat {level}>\n"


def render(turns: list[tuple[str, str]], level: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of a whole conversation with its header, and its loss mask."""
    text, spans = render_turns(turns, level)
    return header(level) + text, [(a + len(header(level)), b + len(header(level))) for a, b in spans]


def parse_turns(formatted: str, level: int, at: int = 0) -> list[tuple[str, str]]:
    """The turns of a text from a place on; ValueError where there is no turn. It knows the grammar only, not the source."""
    turns = []
    while at < len(formatted):
        m = OPEN.match(formatted, at)
        if not m or formatted[m.end() : m.end() + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        end = formatted.find(f"\n{CLOSE}\n", m.end())
        if end < 0:
            raise ValueError(f"turn at {at} doesn't end")
        turns.append((_role_of(m[1]), unescape(formatted[m.end() + 1 : end] if end > m.end() else "", level)))
        at = end + len(CLOSE) + 2
    return turns


def parse_header(formatted: str) -> tuple[int, int]:
    """The escape level, and where the turns begin."""
    if not (m := re.match(r"<chat ([012])>\n", formatted)):
        raise ValueError("no chat header")
    return int(m[1]), m.end()


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a whole rendered conversation."""
    level, at = parse_header(formatted)
    return parse_turns(formatted, level, at)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """The rendered text, the loss spans and the escape level: the least whose parse gives back the turns, and no unescaped control string stays in a text."""
    least = 1 if any(INNER.search(text) for _, text in turns) else 0
    for level in range(least, 3):
        text, spans = render(turns, level)
        try:
            if parse(text) == turns:
                return text, spans, level
        except ValueError:
            pass
    raise AssertionError("line escapes always round trip")


def needed_level(role: str, text: str) -> int:
    """The least escape level at which a turn round trips and has no control string. Turns are parsed one after another, so what holds for each holds for all."""
    return format_turns([(role, text)])[2]


_TURNS = "conv_id long, kind int, turn long, role string, text string, level int"
_PARTS = "conv_id long, part int, formatted string, loss_spans array<struct<begin:long,end:long>>, escape_level int"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_START = object()


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns as rows of kind 1, and for those that need escapes a row of kind 0, which a conversation's turns are read after."""
    names = ["conv_id", "kind", "turn", "role", "text", "level"]
    for batch in batches:
        levels = [needed_level(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * n, pa.int32()), *batch.columns[1:4], pa.array(levels, pa.int32())], names=names)
        marked = [k for k, v in enumerate(levels) if v]
        if marked:
            m = len(marked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(marked)), pa.array([0] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.array([levels[k] for k in marked], pa.int32())],
                names=names,
            )


def _rendered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, full from `most` characters on; rows come sorted by conversation, kind and turn."""
    conv, level, part, held, chars = _START, 0, 0, [], 0
    rows: list[tuple] = []

    def finish() -> None:
        nonlocal part, chars
        text, spans = render_turns(held, level)
        if parse_turns(text, level) != held:
            raise AssertionError("turns round trip at the level that each needs, or a higher one")
        head = header(level) if not part else ""
        rows.append((conv, part, head + text, [{"begin": a + len(head), "end": b + len(head)} for a, b in spans], level))
        part, chars = part + 1, 0
        held.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), _SPANS, pa.int32()]
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "formatted", "loss_spans", "escape_level"])
        rows.clear()
        return out

    for batch in batches:
        for c, kind, role, text, need in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
            if c != conv or conv is _START:
                if conv is not _START:
                    finish()
                conv, level, part = c, 0, 0
            if kind == 0:
                level = max(level, need)
                continue
            held.append((role, text))
            chars += len(text)
            if chars >= most:
                finish()
                yield batch_of()
        if rows:
            yield batch_of()
    if conv is not _START:
        if held or not part:
            finish()
        if rows:
            yield batch_of()


def format_chats(conversations: DataFrame, part_chars: int = PART) -> DataFrame:
    """conv_id, part, formatted text, loss spans in it and escape level.

    The text of a conversation is that of its parts in order, one for nearly all;
    the first begins with the header, and no turn is in two. Parts of a conversation are next to each other and in order.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.mapInArrow(_levelled, _TURNS).repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(lambda batches: _rendered(batches, part_chars), _PARTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each conversation holds; rows come with the parts of a conversation in order."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, level, turns, loss_chars, chars, whole, loss = _START, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    rows: list[tuple] = []
    for batch in batches:
        for c, part, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            at = 0
            if part == 0:
                if conv is not _START:
                    rows.append((conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, turns, loss_chars, chars, whole, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                level, at = parse_header(text)
            found = parse_turns(text, level, at)
            whole.update("".join(f"{role}\n{t}\n" for role, t in found).encode())
            masked = "".join(unescape(text[s["begin"] : s["end"]], level) for s in spans)
            loss.update(masked.encode())
            turns, loss_chars, chars = turns + len(found), loss_chars + len(masked), chars + len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if conv is not _START:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """The digests of what the formatted texts hold, by the parser and the loss spans alone. in_order: the parts come as format_chats gives them; others, as from files, are sorted first."""
    rows = formatted.select("conv_id", "part", "formatted", "loss_spans")
    if not in_order:
        n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return rows.mapInArrow(_digests, _DIGESTS)
