"""Best-fit packing: documents encoded and cut, then a grouping genetic algorithm on islands, block by block."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.scratch import dropped, written
from quarrymill.llm.segments import Known, byte_level, file_bytes, gathered, segments, together
from quarrymill.llm.words import pieces

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Pieces of a block, about; islands of a block; rounds between which their elites move; individuals of an island; and
#: crossovers of a round.
BLOCK, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 2048, 2, 2, 4, 8
#: Islands of a task, about: to start a task takes as long as to pack one or two. Tasks that they are dealt to, at most.
TOGETHER, TASKS = 8, 20_000
#: The share of a parent's sequences that a crossover injects into the other.
INJECTED = 0.1
#: The share of a block's pieces, in its worst-filled sequences, that is packed anew with those of other blocks.
ONWARD = 1 / 8

#: Bits of a bin's number within a block.
BITS = 40
#: Bytes of text that are encoded at a time; the more, the more words repeat.
AT_ONCE = 8_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Known:
    """Ids of segments by the tokenizer of ``model`` as bytes of unsigned 32-bit numbers, kept for the worker."""
    encode, spelt = byte_level(model)
    sizes = np.array([len(x) for x in spelt])
    return Known(lambda new: [x.tobytes() for x in together(new, encode, sizes)])


def token_ids(texts: pa.Array, model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of each): as the tokenizer encodes whole texts, special strings included."""
    s = segments(texts, fine=True)
    if not len(s.code):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    own = _encoder(model)(s.kinds)
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
    ids = gathered(np.frombuffer(b"".join(own), np.uint32), np.cumsum(sizes) - sizes, sizes, s.code)
    upto = np.concatenate([[0], np.cumsum(sizes[s.code])])
    return ids, upto[s.first]


def cutter(model: bytes, capacity: int, end: int, with_ids: bool):
    """A function for mapInArrow: (doc_id, text) to its pieces. Of a document that is too long, all but the first are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                ids, bounds = token_ids(batch.column("text"), model)
                size = np.diff(bounds) + 1
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(batch)), many)
                piece = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
                head = (size - (many - 1) * capacity)[doc]  # the first piece's tokens
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                ended = np.insert(ids, bounds[1:], end).astype("<u4")
                at = (bounds[:-1] + np.arange(len(batch)))[doc] + start
                data = memoryview(ended.tobytes())
                spans = [data[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                arrays = [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                    pa.array([bytes(x) for x in spans] if with_ids else [None] * len(spans), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

    return cut


Bins = list[list[int]]


def fills(bins: Bins, sizes: list[int]) -> list[int]:
    """What is in each bin."""
    own = sizes.__getitem__
    return [sum(map(own, b)) for b in bins]


def best_fit(bins: Bins, sizes: list[int], items: list[int], capacity: int) -> Bins:
    """``bins`` with ``items`` put, in the given order, each where the least room is left over; new bins where none has room."""
    # Bins with room in order of it, then of their number: both in one whole number, which is compared faster than a pair.
    free = sorted((capacity - x) << BITS | k for k, x in enumerate(fills(bins, sizes)) if x < capacity)
    low = (1 << BITS) - 1
    for i in items:
        size = sizes[i]
        at = bisect_left(free, size << BITS)
        if at == len(free):
            bins.append([i])
            left, k = capacity - size, len(bins) - 1
        else:
            found = free.pop(at)
            left, k = (found >> BITS) - size, found & low
            bins[k].append(i)
        if left:
            insort(free, left << BITS | k)
    return bins


def bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that are needed at least: for any split point, pieces that can't share a bin and what doesn't fit beside them."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    upto, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    most = -(-int(total[-1]) // capacity)
    half = capacity // 2
    alone = int(upto[-1] - upto[half + 1])  # larger than half
    for k in np.flatnonzero(count[: half + 1]).tolist():
        large = int(upto[-1] - upto[capacity - k + 1])  # nothing of size k or more fits beside them
        pairs = alone - large
        room = capacity * pairs - int(total[capacity - k + 1] - total[half + 1])
        small = int(total[half + 1] - total[k])
        most = max(most, large + pairs + max(0, -(-(small - room) // capacity)))
    return max(most, alone)


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """The more the better: fewer bins, then bins filled unevenly, which leaves room where it can be used."""
    return -len(bins), sum([(x / capacity) ** 2 for x in fills(bins, sizes)])


def crossed(one: Bins, other: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A child: some of the best-filled bins of ``one`` are injected whole into ``other``.

    Bins of ``other`` that hold an injected piece go, and their other pieces are displaced; they come back by best fit,
    the largest first.
    """
    ranked = sorted(range(len(one)), key=fills(one, sizes).__getitem__, reverse=True)
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = [one[k] for k in rng.permutation(good)[: max(1, int(len(one) * INJECTED))].tolist()]
    taken = {i for b in chosen for i in b}
    child, loose = [list(b) for b in chosen], []
    for b in other:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    return best_fit(child, sizes, sorted(loose, key=sizes.__getitem__, reverse=True), capacity)


def mutated(bins: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """The worst-filled bin and a few others are emptied and their pieces put back by best fit, in a shaken order."""
    fill = fills(bins, sizes)
    gone = {fill.index(min(fill)), *rng.integers(0, len(bins), min(3, len(bins))).tolist()}
    loose = [i for k in gone for i in bins[k]]
    keys = {i: sizes[i] * (0.8 + 0.4 * r) for i, r in zip(loose, rng.random(len(loose)).tolist(), strict=True)}
    return best_fit([list(b) for k, b in enumerate(bins) if k not in gone], sizes, sorted(loose, key=lambda i: -keys[i]), capacity)


def evolved(sizes: list[int], start: list[Bins], capacity: int, least: int, seed: int) -> Bins:
    """An island's best bins after a round of crossovers, starting with ``start`` (what moved in, or nothing)."""
    rng, order = np.random.default_rng(seed), sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    population = [[list(b) for b in bins] for bins in start] or [best_fit([], sizes, order, capacity)]
    best = max(population, key=lambda b: fitness(b, sizes, capacity))
    if len(best) <= least:
        return best
    while len(population) < POPULATION:
        shaken = np.argsort(-np.array(sizes) * (0.7 + 0.6 * rng.random(len(sizes))), kind="stable")
        population.append(best_fit([], sizes, shaken.tolist(), capacity))
    scored = sorted(((fitness(b, sizes, capacity), k, b) for k, b in enumerate(population)), reverse=True)
    for n in range(CROSSOVERS):
        i, j = sorted(rng.choice(len(scored), 2, replace=False).tolist())
        child = mutated(crossed(scored[i][2], scored[j][2], sizes, capacity, rng), sizes, capacity, rng)
        scored[-1] = (fitness(child, sizes, capacity), POPULATION + n, child)
        scored.sort(key=lambda x: x[:2], reverse=True)
        if len(scored[0][2]) <= least:
            break
    return scored[0][2]


ISLAND = "block long, island int, least int, sizes array<int>, bins array<int>, others array<array<int>>"
EVOLVED = "block long, island int, least int, sizes array<int>, bins array<int>"


def _spelled(own: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(own) + 1)]
    for i, k in enumerate(own):
        bins[k].append(i)
    return bins


def island(capacity: int, epoch: int):
    """A function for mapInArrow: every row is an island of a block; its own bins and those that move in, to its best bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes, start = row["sizes"], [_spelled(x) for x in (row["bins"], *(row["others"] or [])) if x]
                least = row["least"] if row["least"] is not None else bound(np.array(sizes), capacity)
                best = start[0] if start and len(start[0]) <= least else evolved(sizes, start, capacity, least, hash((row["block"], row["island"], epoch)) % 2**63)
                own = [0] * len(sizes)
                for k, b in enumerate(best):
                    for i in b:
                        own[i] = k
                out.append({"block": row["block"], "island": row["island"], "least": least, "sizes": sizes, "bins": own})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("island", pa.int32()), ("least", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32()))]))

    return run


def tasks_of(blocks: int) -> int:
    """Tasks for the islands of ``blocks`` blocks."""
    return max(1, min(-(-blocks * ISLANDS // TOGETHER), TASKS))


def islands(blocks: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """(block, bins): the best bins of every block of ``blocks`` (block, sizes), as the bin of each size.

    Each block has ``ISLANDS`` populations. Between rounds an island's elite moves on to the next island of its block.
    Rows are small and their work isn't, so they are dealt to ``tasks`` tasks whatever their bytes. A block that an island has packed as tightly as can be is done and doesn't move again.
    """
    rows = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("int").alias("least"), "sizes")
    state, done = rows.withColumns({"bins": F.lit(None).cast("array<int>"), "others": F.lit(None).cast("array<array<int>>")}), None
    # The first round needs one island: what best fit alone packs tightly is done then.
    state = state.where("island = 0")
    for epoch in range(EPOCHS + 1):
        ran = written(state.repartition(tasks, "block", "island").mapInArrow(island(capacity, epoch), EVOLVED), "pack-islands")
        used = F.array_max("bins") + 1
        best = ran.groupBy("block").agg(F.min(F.struct(used.alias("used"), "island")).alias("best"), F.first("least").alias("least"))
        best = best.select(F.col("block").alias("_block"), F.col("best.used").alias("_used"), F.col("best.island").alias("_island"), F.col("least").alias("_least"))
        rated = ran.join(best, F.col("block") == F.col("_block"))
        ends = (F.col("_used") <= F.col("_least")) | F.lit(epoch == EPOCHS)
        over = written(rated.where(ends & (F.col("island") == F.col("_island"))).select("block", "bins"), "pack-done")
        done = over if done is None else done.union(over)
        left = written(rated.where(~ends).select("block", "island", "least", "sizes", "bins"), "pack-left")
        if epoch == EPOCHS or left.isEmpty():
            break
        if epoch == 0:
            left = left.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
            state = left.withColumn("others", F.lit(None).cast("array<array<int>>"))
        else:
            moved = left.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.array("bins").alias("others"))
            state = left.join(moved, ["block", "island"])
    return done


def packed(docs: DataFrame, model: bytes, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    A document is its text's ids by the byte-level tokenizer of ``model``, then ``end``. Those of more than ``capacity``
    ids are cut into pieces of ``capacity``, the first one being what is left over; full pieces are sequences of their
    own. The others are dealt to blocks of about ``block`` pieces at random, so that every block has the sizes of the
    whole table, and each block is packed by a grouping genetic algorithm on islands (``islands``). Then the pieces in a
    block's worst-filled sequences, an eighth of all, form blocks with those of other blocks and are packed again, and
    so on until one block is left: what is lost at the seams of blocks shrinks with every round. A block is the most
    that a task holds, whatever the sizes. Only sizes and numbers are shuffled.

    Ids are unsigned 32-bit little-endian numbers (``ids`` is null without ``with_ids``, which the digest doesn't need).
    Null and empty texts are documents of one id, ``end``. Rows that repeat are packed each, those without a doc_id too;
    documents of equal sizes are told apart by their place in the table, so many copies make no large block. Texts of any
    length are encoded whole, at some 60 bytes of memory a byte. Other columns, whatever their names, aren't looked at. An
    empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = own.mapInArrow(cutter(model, capacity, end, with_ids), PIECES)
    rows = written(rows.withColumn("_item", F.monotonically_increasing_id()), "pack-pieces")  # numbers that are kept, as they are written
    open_items = rows.where(F.col("length") < capacity).select("_item", F.col("length").cast("int").alias("size"))
    placed, level = None, 0
    while n := open_items.count():
        blocks = max(1, round(n / block))
        dealt = open_items.withColumn("block", F.pmod(F.xxhash64("_item", F.lit(level)), F.lit(blocks)))
        held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "_item")), asc=False).alias("items"))
        held = written(held, "pack-blocks")
        found = islands(held.select("block", F.transform("items", lambda x: x["size"]).alias("sizes")), capacity, tasks_of(blocks))
        spelled = held.join(found, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
        spelled = spelled.select("block", F.col("x.bins").alias("bin"), F.col("x.items.size").alias("size"), F.col("x.items._item").alias("_item"))
        filled = spelled.groupBy("block", "bin").agg(F.sum("size").alias("fill"), F.collect_list(F.struct("_item", "size")).alias("own"))
        if blocks > 1:  # the worst-filled sequences, one a block at least
            each = filled.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("fill", "bin", F.size("own").alias("n")))).alias("bins"))
            many = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x["n"]) * ONWARD
            upto = F.aggregate(
                "bins", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("bins")),
                lambda a, x: F.when((a["n"] + x["n"] <= many) | (F.size(a["bins"]) == 0), F.struct((a["n"] + x["n"]).alias("n"), F.array_append(a["bins"], x["bin"]).alias("bins"))).otherwise(F.struct(F.lit(1 << 40).alias("n"), a["bins"].alias("bins"))),
            )
            onward = each.select("block", F.explode(upto["bins"]).alias("bin"), F.lit(True).alias("onward"))
            filled = filled.join(onward, ["block", "bin"], "left")
        else:
            filled = filled.withColumn("onward", F.lit(None).cast("boolean"))
        filled = written(filled, "pack-filled")
        number = F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("block"), 20) + F.col("bin")
        before = F.transform("own", lambda x, i: F.struct(x["_item"].alias("_item"), F.aggregate(F.slice("own", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["size"]).alias("offset")))
        settled = filled.where("onward is null").select(number.alias("sequence_id"), F.explode(before).alias("x"))
        settled = settled.select("sequence_id", F.col("x.offset").alias("offset"), F.col("x._item").alias("_item"))
        placed = settled if placed is None else placed.union(settled)
        if blocks == 1:
            break
        open_items = filled.where("onward").select(F.explode("own").alias("x")).select("x._item", "x.size")
        dropped(held)
        level += 1
    full, columns = F.col("length") == capacity, [f.split()[0] for f in PIECES.split(", ")] + ["sequence_id", "offset"]
    alone = rows.where(full).withColumns({"sequence_id": -1 - F.col("_item"), "offset": F.lit(0).cast("long")}).select(*columns)
    if placed is None:
        return alone
    return alone.union(rows.where(~full).join(written(placed, "pack-places"), "_item").select(*columns))


def op11_grouping_genetic_packing(spark: SparkSession, sf_dir: str, path: str = "") -> DataFrame:
    """All documents as pieces in sequences of 1,024 tokens."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, file_bytes(path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
