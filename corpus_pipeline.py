"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import decontamination, mixing, near_dedup, sharding, toxicity
from quarrymill.llm.rows import fresh, row_keys
from quarrymill.llm.scratch import written

#: SQL can't express learned and hashed stages; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled documents, scores below 0.5.

    Null and empty texts are scored as such and repeated rows alike; texts of any length are scored whole. Without usable
    labels nothing is toxic and all stay. Other columns, whatever their names, stay as they are. Empty tables stay empty.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(toxicity.rejecting(model), docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id; rows equal in doc_id and text are one.

    Shingles of five words and a similarity of 0.8 make a link, as no contract says otherwise. Several texts under one
    doc_id are several documents, texts without words stay, and all columns do, whatever their names. Of rows equal in
    doc_id and text that differ elsewhere the one whose other columns hash least stays, in every run. Texts of any length
    are compared whole. An empty table stays empty.
    """
    a, b, row = fresh(docs, "key_a", "key_b", "row")
    groups = near_dedup.near_duplicates(docs, 5, 80)
    stays = groups.where("kept").select(F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct()
    own_a, own_b = row_keys(docs)
    kept = docs.withColumns({a: own_a, b: own_b}).join(stays, [a, b], "left_semi")
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))))
    once = kept.groupBy(a, b).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), others).alias(row))
    return once.select(f"{row}.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows equal in doc_id and text are judged alike, texts of any length whole. Other columns,
    whatever their names, stay as they are. Without documents or items nothing is dropped.
    """
    a, b = fresh(docs, "key_a", "key_b")
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keys = written(found.select(F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct(), "leaks")
    own_a, own_b = row_keys(docs)
    return docs.join(keys, (own_a == F.col(a)) & (own_b == F.col(b)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, as ``mixing.repeated`` says of null sources and empty texts.

    Rows that repeat are documents of their own. Other columns stay as they are. An empty table stays empty.
    """
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in 24 shards: nulls, repeats and columns as ``sharding.sharded`` says."""
    return sharding.sharded(docs, sharding.topology(24))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
