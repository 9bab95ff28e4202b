"""Importance resampling towards a target: n-gram buckets by suffix arrays of word ids, gains, and a seeded draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.ordering import placed
from quarrymill.llm.scratch import written
from quarrymill.llm.words import Words, buffers, codes, pieces

#: Words of the longest feature, buckets, the seed of the draw, hundredths drawn, and words that a drawn document has.
LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text that are worked on at a time; the more, the more words repeat.
AT_ONCE = 4_000_000

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def plain_words(texts: pa.Array) -> Words:
    """Runs of digits, letters a to z (A to Z folded) and bytes from 0x80 on, of all texts of an array; no hashes."""
    data, bounds = buffers(texts)
    data = _FOLD[data]
    edge = np.diff(np.concatenate([[False], _WORD[data], [False]]).astype(np.int8))
    starts, ends = edge == 1, edge == -1
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    split = cuts[_WORD[data[cuts - 1]] & _WORD[data[cuts]]]  # a word that ends a text and one that begins the next
    starts[split] = ends[split] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), np.zeros(0, np.uint64), first)


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of word ids (numbered from 0): positions sorted by their first ``depth`` word ids, and how many each shares with the one before.

    ``left`` is how many words the position's text has from there on: nothing is shared beyond a text's end. Ranks double
    (1, 2, 4, ... words) until they tell ``depth`` words apart.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, size = ids.astype(np.int64) + 1, 1
    while size < depth:
        step = min(2 * size, depth) - size  # two runs of ``size`` words, that may overlap
        size += step
        after = np.zeros(n, np.int64)
        held = np.flatnonzero(left > step)
        after[held] = rank[held + step]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    lcp, alive = np.zeros(n, np.int64), np.arange(1, n)
    for k in range(depth):  # the pairs of neighbours that share k words, one word further
        a, b = order[alive - 1], order[alive]
        alive = alive[(left[a] > k) & (left[b] > k)]
        a, b = order[alive - 1] + k, order[alive] + k
        alive = alive[ids[a] == ids[b]]
        lcp[alive] = k + 1
    return order, lcp


def bucketed(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, the text of each, words of each text) of an array of texts.

    Features are the runs of 1 to ``longest`` words, joined by a space. Word ids are exact (codes of the bytes). In the
    suffix array a run of neighbours that share k words is one feature of k words: it is spelled and hashed once, and
    its bucket goes to all places where it stands.
    """
    w = plain_words(texts)
    counts = np.diff(w.first)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    ids, kinds = codes(w)
    spelt = kinds.to_pylist()
    left = w.first[1:][w.doc] - np.arange(len(ids))
    order, lcp = suffixes(ids, left, longest)
    found, of = [], []
    for k in range(1, longest + 1):
        long_enough = left[order] >= k
        head = np.flatnonzero(long_enough & (lcp < k))  # where a feature of k words is met first
        run = np.cumsum(long_enough & (lcp < k)) - 1
        at = order[head]
        if k == 1:
            hashed = [zlib.crc32(spelt[i]) % buckets for i in ids[at].tolist()]
        else:
            parts = [[spelt[i] for i in ids[at + j].tolist()] for j in range(k)]
            hashed = [zlib.crc32(b" ".join(x)) % buckets for x in zip(*parts, strict=True)]
        places = order[long_enough]
        found.append(np.array(hashed, np.int64)[run[long_enough]])
        of.append(w.doc[places])
    return np.concatenate(found), np.concatenate(of), counts


def counter(longest: int, buckets: int):
    """A function for mapInArrow: (text) to (bucket, n), at most one row a bucket for a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                total += np.bincount(bucketed(batch.column("text"), longest, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return count


WEIGHTS = "doc_id long, n_features long, n_words long, weight long"


def weigher(gains: np.ndarray, longest: int):
    """A function for mapInArrow: (doc_id, text) to the number of features and the sum of their buckets' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                bucket, text, words = bucketed(batch.column("text"), longest, len(gains))
                n = np.bincount(text, minlength=len(batch))
                by = np.argsort(text, kind="stable")
                upto = np.concatenate([[0], np.cumsum(gains[bucket[by]])])
                ends = np.cumsum(n)
                sums = upto[ends] - upto[ends - n]
                arrays = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in WEIGHTS.split(", ")])

    return weigh


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    s and t count the bucket's features in ``docs`` and ``target`` (text), S and T all of them. Tasks sum before
    the shuffle; what reaches the driver is one row a bucket.
    """
    spark = docs.sparkSession
    each = [df.select("text").mapInArrow(counter(longest, buckets), "bucket long, n long") for df in (docs, target)]
    tagged = each[0].select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(each[1].select("bucket", F.lit(0).cast("long"), "n"))
    sums = written(tagged.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    rows = spark.range(buckets).toDF("bucket").join(sums, "bucket", "left").na.fill(0, ["s", "t"])
    whole = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))  # one row
    real = lambda c: c.cast("double")
    ratio = real(F.col("t") + 1) * real(F.col("all_s") + buckets) / (real(F.col("s") + 1) * real(F.col("all_t") + buckets))
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    out = np.zeros(buckets, np.int64)
    for row in rows.crossJoin(F.broadcast(whole)).select("bucket", gain.alias("gain")).collect():
        out[row["bucket"]] = row["gain"]
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths rounded down: the same for the same doc_id and seed; a null doc_id is ''."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS
) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    A document's weight is the sum of its features' gains (``bucket_gains``), its score the weight with Gumbel noise, so
    the highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the N documents with
    ``least_words`` or more, the floor(``percent`` * N / 100) highest have ranks from 1, ties by the smaller doc_id; the
    other ranks are null. Ranks are laid by sampled ranges, so no task sorts all.

    Null and blank texts have no words: weight 0, never drawn unless ``least_words`` is 0. A null doc_id is drawn like an
    empty one and comes last among ties. Rows that repeat are documents of their own, with ranks that follow each other.
    Texts of any length are worked on whole, at some 60 bytes of memory a byte (more with longer features). Other
    columns, whatever their names, aren't looked at. Without documents the result is empty; without a target all weigh
    by their rarity alone.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    gains = bucket_gains(own, target.select(target["text"].alias("text")), longest, buckets)
    rows = own.mapInArrow(weigher(gains, longest), WEIGHTS)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    ranked = placed(rows.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "_place")
    ranked = ranked.withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place"))).drop("_place")
    return ranked.union(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's texts, a tenth of them drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
