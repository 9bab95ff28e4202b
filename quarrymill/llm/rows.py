"""Names and keys of rows of tables whose columns aren't known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two whole numbers by which rows are told apart: the doc_id (of rows without one, a hash of the text) and a hash
    of doc_id and text. So rows of different doc_ids never share keys, and those that share both are equal rows."""
    return F.coalesce(df[doc_id].cast("long"), F.xxhash64(F.lit(7), df[text])), F.xxhash64(df[doc_id].cast("long"), df[text])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
