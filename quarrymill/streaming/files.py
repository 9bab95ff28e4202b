"""Structured Streaming: new files of JSON lines or text are cleaned, checked for repeats and written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.functions.text import fingerprint, normalize_whitespace
from quarrymill.operators.clean import CleanOptions, clean_value, is_empty_record
from quarrymill.operators.privacy import with_types


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    if form == "text":
        return spark.readStream.text(path).select(normalize_whitespace(F.col("value")).alias("text"))
    return spark.readStream.schema(schema).format(form).load(path)


def cleaned(df: DataFrame, columns: list[str], options: CleanOptions = CleanOptions()) -> DataFrame:
    """Stateless cleaning: values, empty records, and the types of sensitive values found."""
    values = [clean_value(F.col(c), df.schema[c].dataType, options).alias(c) if c in columns else F.col(c) for c in df.columns]
    out = df.where(~is_empty_record(df, columns)).select(*values)
    return with_types(out, columns)


def first_within(df: DataFrame, columns: list[str], at: str, delay: str = "10 minutes") -> DataFrame:
    """The first of equal records within the watermark; state goes once the watermark passes."""
    return df.withColumn("fingerprint", fingerprint(columns)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(df: DataFrame, at: str, by: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Records of each ``by`` in tumbling windows of event time."""
    return df.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("records")).select("w.start", "w.end", by, "records")


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has come so far, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
