"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.numbering import numbered

#: Shards a rack and racks a region in the topology that ``topology`` lays out.
SHARDS_A_RACK, RACKS_A_REGION = 4, 2


class Leaf(NamedTuple):
    """A shard and its place in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Leaf]:
    """Equal shards in racks of four and regions of two racks, numbered in order."""
    return [
        Leaf(i // (SHARDS_A_RACK * RACKS_A_REGION), i // SHARDS_A_RACK % RACKS_A_REGION, i, 1.0) for i in range(shards)
    ]


def grown(leaves: list[Leaf]) -> list[Leaf]:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move into it only."""
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, 0, max(x.shard for x in leaves) + 1, 1.0)]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``, fixed by key and node; the least draw among siblings wins."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(unit) / F.lit(float(weight))


def winner(key: Column, nodes: dict[int, tuple[str, float]]) -> Column:
    """The id among siblings ``{id: (name, weight)}`` that wins the weighted draw."""
    live = {i: x for i, x in nodes.items() if x[1] > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct(draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in live.items()]
    return F.array_min(F.array(*draws))["i"]


def placed(df: DataFrame, key: Column, leaves: list[Leaf], names: tuple[str, str, str]) -> DataFrame:
    """Add region, rack and shard of ``key``: three descents, each a weighted draw among the children of the node won.

    A node weighs as much as its leaves. Changing a leaf's weight changes draws on its own path only: keys move into
    or out of the subtrees whose weights changed, and the order among all other nodes stays.
    A null key is one key like any other.
    """
    tree: dict[int, dict[int, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for x in leaves:
        if x.weight > 0:
            tree[x.region][x.rack].append(x)
    if not tree:
        raise ValueError("no leaf with a positive weight")
    region, rack, shard = names
    weight = lambda rack: sum(x.weight for x in rack)
    df = df.withColumn(region, winner(key, {r: (f"region {r}", sum(map(weight, racks.values()))) for r, racks in tree.items()}))
    racks_of, shards_of = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r, racks in tree.items():
        racks_of = F.when(F.col(region) == r, winner(key, {k: (f"rack {r}/{k}", weight(v)) for k, v in racks.items()})).otherwise(racks_of)
    df = df.withColumn(rack, racks_of)
    for r, racks in tree.items():
        for k, own in racks.items():
            won = winner(key, {x.shard: (f"shard {r}/{k}/{x.shard}", x.weight) for x in own})
            shards_of = F.when((F.col(region) == r) & (F.col(rack) == k), won).otherwise(shards_of)
    return df.withColumn(shard, shards_of)


def sharded(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row of ``docs`` by its key alone and number the rows of each shard from 0 without gaps.

    Adds ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32`` (0 for a null or empty text), ``region``,
    ``rack``, ``shard``, ``slot`` and ``grown_shard`` (the shard once ``grown(leaves)`` holds). Texts are read once and
    only the key, the two figures and the places are shuffled. A null key is one key like any other. Rows with equal
    keys meet in one shard, but in no one task; rows that are equal in key and text take their slots in either order.
    Other columns, whatever their names, aren't looked at. An empty table gives an empty result.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[key].alias("_key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
    )
    rows = placed(rows, F.col("_key"), leaves, ("region", "rack", "shard"))
    rows = placed(rows, F.col("_key"), grown(leaves), ("_grown_region", "_grown_rack", "grown_shard"))
    rows = rows.drop("_grown_region", "_grown_rack")
    rows = numbered(rows, ["shard"], ["_key", "text_crc32", "size"])
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", "region", "rack", "shard", F.col("_start").alias("slot"), "grown_shard")


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs, topology(24)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )
