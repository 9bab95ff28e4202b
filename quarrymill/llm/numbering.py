"""Gapless numbers and running totals within groups of any size, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.scratch import written

#: Parts that every group is numbered in; a part of a group is the unit of work of one task.
PARTS = 1024
#: Equal rows that one row stands for until they are spelled out in several tasks.
CHUNK = 65_536


def numbered(df: DataFrame, group: list[str], order: list[str], size: str | None = None, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """Add ``_part``, ``_row``, ``_copy`` and ``_start``: the rows (or the sum of ``size``) of the group before this row.

    Equal rows are one until they have their numbers, so a row that is there very often is no hot key. Rows are dealt by
    hash of ``order`` to ``parts`` parts of each group, numbered there, and shifted by the totals of the parts before.
    Only (group, part) totals meet in one place: at most ``parts`` rows a group. Rows that tie in ``order`` but differ
    elsewhere are numbered in either order. ``df`` is computed once.
    """
    columns = df.columns
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = written(rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")), "numbered")
    amount = F.lit(1).cast("long") if size is None else F.col(size).cast("long")
    totals = rows.groupBy(*group, "_part").agg(F.sum(amount * F.col("_copies")).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum"))
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_before")
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    upto = F.sum(amount * F.col("_copies")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_row", F.row_number().over(within)).withColumn("_upto", upto - amount * F.col("_copies"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = rows.join(totals, [F.col("_part") == F.col("_p"), *same])
    joined = joined.select(*columns, "_part", "_row", "_copies", (F.col("_before") + F.col("_upto")).alias("_first"))
    few = joined.where(F.col("_copies") <= chunk).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    many = joined.where(F.col("_copies") > chunk).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))))
    many = many.repartition("_part", "_row", "_chunk")
    last = F.least((F.col("_chunk") + 1) * chunk, F.col("_copies")) - 1
    many = many.withColumn("_copy", F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_chunk")
    return few.union(many).select(*columns, "_part", "_row", "_copy", (F.col("_first") + F.col("_copy") * amount).alias("_start"))
