"""Mixing sources to target weights in blocks of fixed length, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.numbering import numbered
from quarrymill.llm.rows import fresh, row_keys
from quarrymill.llm.scratch import dropped, written

#: Words of a block, output shards, and slots that one row stands for before they are spelled out.
BLOCK, SHARDS, CHUNK = 64, 64, 4096
#: Weights of the sources in code point order, repeating; a source gives each word this many times at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rounds of the index permutations.
ROUNDS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size), one row a source: adds ``sid``, ``weight``, ``target``.

    Sources share the sum of all sizes by weight. A target stops at ``most`` times its source's size and the excess
    goes to the others by weight until none is above. Ordered by size over weight, the sources that stop come first,
    so one pass finds the level at which the rest share what is left. The windows hold one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("sid", F.row_number().over(order))
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = rows.withColumn("weight", share).withColumn("_cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("_left", F.sum("source_size").over(whole) - (F.sum("_cap").over(upto) - F.col("_cap")))
        .withColumn("_weights", F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
    )
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    rows = rows.withColumn("_fill", F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_fill") * F.col("weight"), F.col("_cap").cast("double")))
    return rows.select("sid", "source", "source_size", "weight", target.alias("target"))


def permuted(df: DataFrame, index: Column, count: str, seed: Column, name: str, rounds: int = ROUNDS) -> DataFrame:
    """Add ``name``: a pseudorandom permutation of 0 to ``count`` - 1, chosen by ``seed``, at ``index``.

    A swap-or-not shuffle: each round pairs every number with its mirror about a drawn point and, by a hash of the
    greater of the two, swaps them or not. That is a permutation for every count, and no round needs more than 64 bits.
    """
    rows = df.withColumn(name, index).withColumn("_seed", seed)
    for i in range(rounds):
        rows = rows.withColumn("_mirror", F.pmod(F.pmod(F.xxhash64("_seed", F.lit(i)), F.col(count)) - F.col(name), F.col(count)))
        swap = F.xxhash64("_seed", F.lit(i), F.greatest(name, "_mirror")).bitwiseAND(F.lit(1)) == 1
        rows = rows.withColumn(name, F.when(swap, F.col("_mirror")).otherwise(F.col(name)))
    return rows.drop("_seed", "_mirror")


def spelled(df: DataFrame, count: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each of 0 to ``count`` - 1: chunks first, dealt out anew, so that no task spells out a large source."""
    last = F.floor((F.col(count) - 1) / chunk)
    rows = df.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    rows = rows.repartition("sid", "_chunk")
    first = F.col("_chunk") * chunk
    end = F.least(first + chunk, F.col(count)) - 1
    return rows.withColumn(name, F.explode(F.sequence(first, end))).drop("_chunk")


def shard_counts(plan: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Multinomial draws: (sid, shard, n), the number of slots of each output shard that go to each source.

    Every one of a source's ``draws`` falls on a shard by its own hash, so a source's counts over the shards are a
    multinomial draw, while their sum stays the number that the target asks for.
    """
    draws = spelled(plan.select("sid", "draws"), "draws", "_t")
    shard = F.pmod(F.xxhash64("sid", "_t", F.lit(seed)), F.lit(shards)).cast("int")
    return draws.groupBy("sid", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def slots(plan: DataFrame, counts: DataFrame, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """(sid, shard, slot, block): the block that each slot of each output shard takes.

    A source's slots are counted through over its shards. The running number gives the epoch, and within the epoch
    the source's permutation gives the block: all blocks are taken once before any is taken again.
    """
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_before", F.sum("n").over(before) - F.col("n"))
    counts = counts.join(plan.select("sid", "blocks"), "sid")
    last = F.floor((F.col("n") - 1) / chunk).cast("long")
    rows = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("sid", "shard", "_chunk")
    first = F.col("_chunk") * chunk
    rows = rows.withColumn("slot", F.explode(F.sequence(first, F.least(first + chunk, F.col("n")) - 1)))
    t = F.col("_before") + F.col("slot")
    epoch = F.floor(t / F.col("blocks")).cast("long")
    rows = permuted(rows, t % F.col("blocks"), "blocks", F.xxhash64(F.col("sid"), epoch, F.lit(seed)), "block")
    return rows.select("sid", "shard", "slot", "block")


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How many words the mix takes of every document.

    Each source's documents, in hash order, are one stream of words cut into blocks of ``block``. ``shard_counts``
    draws how many blocks of each source go to each output shard, ``slots`` maps them through the source's
    permutations, and the streams' blocks are joined by index. Returns doc_id, source, size, source_size, target,
    key_a, key_b, taken; the keys tell rows apart (``row_keys``). Documents without words (null or blank text) have size
    0 and give nothing; a null source is a source, the last; rows that repeat are documents of their own. No block is
    taken more than three times, as no target is above three times its source's size. Texts of any length are counted
    whole; other columns, whatever their names, aren't looked at. An empty table gives an empty result. Sources are
    ordered and levelled in one task, one row each: meant for up to some millions of them.
    """
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    a, b = row_keys(docs)
    sized = written(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words.alias("size"), a.alias("key_a"), b.alias("key_b")), "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.round(F.col("target") * blocks / F.col("source_size"))
    plan = plan.withColumn("blocks", blocks).withColumn(
        "draws", F.when(F.col("source_size") > 0, F.least(wanted.cast("long"), MOST * blocks)).otherwise(F.lit(0).cast("long"))
    )
    plan = written(plan, "mix-plan")
    taken = slots(plan, shard_counts(plan, shards, seed), seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("_times"))
    taken = written(taken, "mix-blocks")  # its size is then known: a plan's guess for exploded rows is far too low
    place = plan.select("sid", F.col("source").alias("_source"), "source_size", "target")
    rows = sized.join(place, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = numbered(rows, ["sid"], ["key_b", "key_a"], "size")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)))
    parts = rows.withColumn("block", F.explode_outer(spans)).join(taken, ["sid", "block"], "left")
    end = F.least((F.col("block") + 1) * block, F.col("_start") + F.col("size"))
    words_taken = (end - F.greatest(F.col("block") * block, F.col("_start"))) * F.coalesce(F.col("_times"), F.lit(0))
    keys = ["sid", "_part", "_row", "_copy", "doc_id", "source", "size", "source_size", "target", "key_a", "key_b"]
    taken = F.coalesce(F.sum(words_taken), F.lit(0)).cast("long").alias("taken")
    return parts.groupBy(*keys).agg(taken).select(*keys[4:], "taken")


def repeated(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix as documents: each appears ``taken / size`` times on average, 0 to 3; those without words stay once.

    ``floor(taken / size + u)`` with ``u`` a uniform hash of the document rounds without bias, so that the words given
    out meet the targets of the sources whatever the lengths of their documents. Rows that repeat share their mean.
    All columns of ``docs`` stay, whatever their names.
    """
    keys, (a, b, source, copies, copy) = ["key_a", "key_b", "source"], fresh(docs, "key_a", "key_b", "of", "copies", "copy")
    mix = mixed(docs, seed=seed, **options).groupBy(*keys).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    u = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit("copies")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    many = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.floor(F.col("_taken") / F.col("_size") + u).cast("int"))
    mix = mix.select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("source").alias(source), many.alias(copies)).where(F.col(copies) > 0)
    own_a, own_b = row_keys(docs)
    rows = docs.join(mix, (own_a == F.col(a)) & (own_b == F.col(b)) & docs["source"].eqNullSafe(F.col(source)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])


def op9_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all documents takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
