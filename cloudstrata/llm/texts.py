"""Names of texts, for judging rows by what they say whatever their id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that text_name makes.
TEXT_NAME = ("t1", "t2")


def text_name(text: Column | str) -> list[Column]:
    """Two 64-bit hashes of a text, t1 and t2; a null text has a name, too. Made in the JVM, so a join on it needs no Python."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(F.lit(k), text).alias(n) for k, n in enumerate(TEXT_NAME)]


def same_row(docs, other, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The condition that a row of docs has the id (nulls being equal) and the text of a row of other: doc_id, t1, t2 with __ before."""
    names = text_name(docs[text_col])
    return docs[id_col].eqNullSafe(other["__doc_id"]) & (names[0] == other["__t1"]) & (names[1] == other["__t2"])
