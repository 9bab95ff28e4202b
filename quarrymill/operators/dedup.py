"""Keep-first duplicates, unions of sources, comparison of data sets, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.ordering import placed
from quarrymill.functions.scratch import written
from quarrymill.functions.text import fingerprint


def _settled(df: DataFrame, order: str) -> list[Column]:
    """An order of all rows: ``order``, rows without it last, then all else that can be hashed."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.col(order).asc_nulls_last(), F.xxhash64(*[F.col(c) for c in plain])]


def deduplicate(df: DataFrame, columns: list[str], order: str, within: list[str] | None = None) -> DataFrame:
    """The first row, by ``order``, of each group of rows with equal ``columns`` (and ``within``).

    One row of each group stays, also where ``order`` repeats or is null. Every task passes on one row a group, so a
    record that is there very often makes no large group.
    """
    first = Window.partitionBy(*(within or []), "_fp").orderBy(*_settled(df, order))
    rows = df.withColumn("_fp", fingerprint(columns)).withColumn("_n", F.row_number().over(first))
    return rows.where("_n = 1").drop("_fp", "_n")


def duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(index, duplicate_of, fingerprint): every row that an earlier one equals, the same rows that ``deduplicate`` drops.

    Rows without ``order`` come last, rows that share it are told apart by a digest of the whole row, and of rows equal
    in all one is the first. Equal rows are one row with a count until the end, and firsts are written before the join, so
    that a record that is there very often neither makes a large group nor a join that can't be split.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.select(F.col(order).alias("index"), fingerprint(columns).alias("fingerprint"), F.xxhash64(*plain).alias("_digest"))
    rows = rows.groupBy("index", "fingerprint", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    least = F.min(F.struct(F.col("index").isNull().alias("none"), F.col("index").alias("index"), F.col("_digest").alias("digest")))
    first = rows.groupBy("fingerprint").agg(least.alias("_first"), F.sum("_n").alias("_all")).where("_all > 1")
    found = rows.join(written(first, "firsts"), "fingerprint")
    own = F.col("index").eqNullSafe(F.col("_first.index")) & (F.col("_digest") == F.col("_first.digest"))
    found = found.withColumn("_more", F.col("_n") - own.cast("long")).where("_more > 0")
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_more"))))
    return found.select("index", F.col("_first.index").alias("duplicate_of"), "fingerprint")


def merge(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of all sources under the union of their columns, with their source's name and place."""
    named = [df.withColumn("_src", F.lit(name)).withColumn("_src_at", F.lit(i)) for i, (name, df) in enumerate(sources)]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def combine(sources: list[tuple[str, DataFrame]], columns: list[str], order: str, remove_duplicates: bool = True) -> DataFrame:
    """Merge, then keep the first of equal records in source order."""
    merged = merge(sources).withColumn("_at", F.struct("_src_at", order))
    if not remove_duplicates:
        return merged.drop("_at")
    least = Window.partitionBy(fingerprint(columns)).orderBy("_at")
    return merged.withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_n", "_at")


def compare(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sizes, and how many distinct records were removed and added."""
    tagged = before.select(fingerprint(columns).alias("fp"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(fingerprint(columns).alias("fp"), F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    each = tagged.groupBy("fp").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.agg(
        n(F.sum("b")).alias("before_records"),
        n(F.sum("a")).alias("after_records"),
        n(F.count_if(F.col("a") == 0)).alias("removed"),
        n(F.count_if(F.col("b") == 0)).alias("added"),
    )


def batches(df: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Add ``batch``: rows in order, ``size`` at a time, from 0."""
    numbered = placed(df, [F.col(order)], "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / max(1, size)).cast("long")).drop("_n")
