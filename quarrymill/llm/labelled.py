"""Bounded samples of labelled documents, for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import written


def fold(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: dict[int, int], longest: int) -> DataFrame:
    """(doc_id, text, _label) of labelled documents outside the held-out fold: at most ``most[c]`` rows of class c.

    Labels of documents that ``docs`` doesn't have don't count. The rows of least hash of each class are taken. Only their ids, a number with a fixed bound, are broadcast, so
    documents aren't shuffled. A doc_id with several labels is taken once, with the greatest; one with several texts
    once, with the least. Texts of more than ``longest`` bytes aren't taken, so what is collected has a bound.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held_out))
    rows = rows.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    rows = rows.groupBy("_id").agg(F.max("_label").alias("_label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    rows = written(rows.join(own.select(F.col("doc_id").alias("_id")), "_id", "left_semi"), "labelled")  # labels may be of other documents too
    picked = [rows.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(n) for c, n in most.items()]
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.union(more)
    found = own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
