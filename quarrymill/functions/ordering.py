"""Dense numbers in a global order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.scratch import written


def dense_number(df: DataFrame, bucket: Column, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """Number rows from 1 by ``order`` (within the groups of ``within``), as ``name``.

    ``bucket`` must not fall along ``order``: buckets are numbered separately and shifted by the sizes of those
    before, so only one row a bucket meets in one place.
    """
    keys = list(within or [])
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.withColumn("_before", F.sum("_size").over(over) - F.col("_size")).drop("_size")
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_before")
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(before, [F.col("_bucket").eqNullSafe(F.col("_b")), *same])
    return joined.select(*df.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))


def by_digest(seed: int | str, key: str) -> tuple[Column, Column]:
    """A pseudorandom order of rows by a seeded digest of their key: (bucket, digest)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.substring(digest, 1, 3), digest


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 1 by ``order``, as ``name``: any type of key, repeated or null, and no task with more than its share.

    Ranges are laid by the engine's sample of the whole order: all its columns, then a digest of the row, then where the
    row stood. So a value that is there very often is cut between several ranges, as are strings with one beginning and
    structs whose first fields are equal. Ranges are sorted where they are and written to the shared folder (their
    bounds are drawn once, a lost executor costs a read); each is then shifted by the sizes of those before, which are
    one row a range. Rows that tie in ``order`` are numbered by their digest, equal rows in any order.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.withColumn("_digest", F.xxhash64(*plain) if plain else F.lit(0).cast("long")).withColumn("_stood", F.monotonically_increasing_id())
    keys = [*order, F.col("_digest"), F.col("_stood")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    rows = written(rows.drop("_digest", "_stood"), "placed")
    part = F.shiftrightunsigned("_place", 33)  # the number of the range; the lower bits count its rows
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select("_part", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
    out = rows.join(F.broadcast(before), part == F.col("_part"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + within + 1).alias(name))
