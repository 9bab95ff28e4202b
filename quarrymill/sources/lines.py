"""Lines of files of any size with their numbers, read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions.scratch import written
from quarrymill.functions.text import trimmed
from quarrymill.sources.readers import csv_cells, decoded

#: Blocks whose figures are sent to every task; beyond that they are joined like any table.
SENT_BLOCKS = 200_000

BOM = "\ufeff"


def plain_path(path: Column) -> Column:
    """A file's address in the form in which folders are listed."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), r"\+", "%2B"))


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_path, id, line): the lines of files that aren't blank, numbered from 1 within their file. LF, CRLF and CR end lines.

    Files are read in blocks, a large one by many tasks. Every line keeps its block and its place there, and the numbers
    of a block start after the lines of the blocks before it, which are one row a block. The lines are written to the
    shared folder once, so that both see the same blocks. Bytes that aren't UTF-8 become replacement characters; a byte
    order mark goes; files that begin with one of UTF-16 can't be cut into blocks and are decoded whole.
    """
    raw = spark.read.text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("_mark"), F.make_valid_utf8("value").alias("line"),
    )
    filled = trimmed(F.when(F.col("_block") == 0, F.regexp_replace("line", f"^{BOM}", "")).otherwise(F.col("line"))) != ""
    rows = written(raw.where(filled).withColumn("_place", F.monotonically_increasing_id()), "file-lines")
    blocks = rows.groupBy("_path", "_block").agg(F.min(F.struct("_place", "_mark")).alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("_path", "_block", F.col("first._place").alias("_first"), F.col("first._mark").alias("_head"), (F.sum("n").over(before) - F.col("n")).alias("_before"))
    blocks = written(blocks, "file-blocks")
    wide_block = (F.col("_block") == 0) & F.col("_head").isin("FFFE", "FEFF")
    wide = [r["_path"] for r in blocks.where(wide_block).select("_path").collect()]  # a subset of the files that were asked for
    if wide:
        rows, blocks = rows.where(~F.col("_path").isin(wide)), blocks.where(~F.col("_path").isin(wide))
    numbered = rows.join(F.broadcast(blocks) if blocks.count() <= SENT_BLOCKS else blocks, ["_path", "_block"])
    number = F.col("_before") + F.col("_place") - F.col("_first") + 1
    out = numbered.select("_path", number.alias("id"), F.when(number == 1, F.regexp_replace("line", f"^{BOM}", "")).otherwise(F.col("line")).alias("line"))
    if not wide:
        return out
    whole = spark.read.format("binaryFile").load(wide).select(F.col("path").alias("_path"), F.filter(F.split(decoded(F.col("content")), "\r\n?|\n"), lambda x: trimmed(x) != "").alias("lines"))
    return out.union(whole.select("_path", F.posexplode("lines").alias("at", "line")).select("_path", (F.col("at") + 1).cast("long"), "line"))


def text_rows(lines: DataFrame) -> DataFrame:
    """(_path, id, record, problem): a record of each line."""
    own = lines.select("_path", "id", trimmed(F.col("line")).alias("text"))
    return own.select("_path", "id", F.to_json(F.struct("id", "text")).alias("record"), F.lit(None).cast("string").alias("problem"))


def json_rows(lines: DataFrame) -> DataFrame:
    """(_path, id, record, problem): a JSON value of each line, or ``INVALID_JSONL``."""
    own = lines.select("_path", "id", trimmed(F.col("line")).alias("text"))
    good = F.try_parse_json("text").isNotNull()
    return own.select("_path", "id", F.when(good, F.col("text")).alias("record"), F.when(~good, "INVALID_JSONL").alias("problem"))


def csv_rows(lines: DataFrame) -> DataFrame:
    """(_path, id, record, problem): each line's cells by the names in its file's first line, as ``readers.parse_csv`` has them."""
    head = F.transform(csv_cells(F.col("line")), lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h))
    heads = lines.where("id = 1").select("_path", head.alias("_names"))
    rows = lines.where("id > 1").select("_path", "id", csv_cells(F.col("line")).alias("_cells")).join(heads, "_path")
    entries = F.transform("_names", lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get("_cells", i), F.lit("")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda l: l["key"] == e["key"]))
    return rows.select("_path", (F.col("id") - 1).alias("id"), F.to_json(F.map_from_entries(last)).alias("record"), F.lit(None).cast("string").alias("problem"))


ROWS = {"text": text_rows, "jsonl": json_rows, "csv": csv_rows}
