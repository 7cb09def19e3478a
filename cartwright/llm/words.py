"""Notions of text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole_text(text: str | Column) -> Column:
    """The text, a missing one being empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns most operators need, so that further ones can't clash with theirs."""
    return docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that the rows don't have."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
