"""Near-duplicate documents: MinHash signatures, an inverted join over signature coordinates, links confirmed on texts."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.components import components
from quarrymill.llm.rows import row_keys
from quarrymill.llm.scratch import dropped, written
from quarrymill.llm.words import between, codes, mixed, pieces, prefix, signed, words

#: Words of a shingle, and the similarity in hundredths from which two documents are linked.
SHINGLE, SIMILARITY = 3, 85
#: Signature coordinates, and how likely a pair at the similarity may be to share fewer of them than are asked for.
COORDINATES, MISSED = 32, 1e-7
#: Places of the prefix before a posting that go with it. Pairs that share one of them were found there already.
EARLIER = 32
#: 64-bit numbers of a sketch of a shingle set, and nodes of a list that are sorted together.
SKETCH, TOGETHER = 16, 4096

_MULTIPLIERS = mixed(np.arange(COORDINATES, dtype=np.uint64), 5) | np.uint64(1)
_OFFSETS = mixed(np.arange(COORDINATES, dtype=np.uint64), 7)


def matches(similarity: int, missed: float = MISSED) -> int:
    """How many coordinates a pair must share: the most that a pair at the similarity falls short of that rarely.

    Coordinates agree independently, each with the similarity as its chance: 15 of 32 at 0.85, 12 at 0.8.
    """
    p, below, least = similarity / 100, 0.0, 0
    while least < COORDINATES and below + comb(COORDINATES, least) * p**least * (1 - p) ** (COORDINATES - least) <= missed:
        below += comb(COORDINATES, least) * p**least * (1 - p) ** (COORDINATES - least)
        least += 1
    return max(least, 1)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every ``n``-word shingle; a text of 1 to ``n`` - 1 words is one shingle."""
    sums, counts = prefix(hashes), np.diff(first)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    start = first[:-1][text] + np.arange(len(text)) - (np.cumsum(many) - many)[text]
    return between(sums, start, np.minimum(start + n, first[1:][text])), text


def shingle_sets(texts: pa.Array, n: int, key: bytes) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted. They are keyed, so that no texts can be made to look alike."""
    w = words(texts, lower=True, key=key)
    hashes, text = shingle_hashes(w.hash, w.first, n)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shingle_codes(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The set of shingles of each text, sorted; two shingles of the same call are equal if and only if their words are.

    Words become their codes, and runs of codes whole numbers as long as those fit 63 bits; else the runs so far are
    numbered anew.
    """
    w = words(texts, lower=True)
    code, kinds = codes(w)
    base, counts = len(kinds) + 1, np.diff(w.first)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    at = w.first[:-1][text] + np.arange(len(text)) - (np.cumsum(many) - many)[text]
    end, run, most = w.first[1:][text], np.zeros(len(text), np.int64), 1
    for k in range(n):
        if most * base >= 1 << 63:
            kept, run = np.unique(run, return_inverse=True)
            most = len(kept)
        here = np.minimum(at + k, max(len(code) - 1, 0))
        run = run * base + (np.where(at + k < end, code[here] + 1, 0) if len(code) else 0)  # 0 where a short text has ended
        most *= base
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.unique(run[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


SIGNATURES = "doc_id long, key_a long, key_b long, n_shingles long, set_a long, set_b long, signature array<int>"


def signer(n: int, key: bytes):
    """A function for mapInArrow: the size, a digest (two numbers) and the MinHash signature of each text's shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), n, key)
                sizes = np.array([len(x) for x in sets], np.int64)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                digest = b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets)
                halves = np.frombuffer(digest, "<i8").reshape(-1, 2)
                least = np.zeros((len(sets), COORDINATES), np.uint32)
                if len(full):
                    for k in range(COORDINATES):
                        drawn = ((values * _MULTIPLIERS[k] + _OFFSETS[k]) >> np.uint64(32)).astype(np.uint32)
                        least[full, k] = np.minimum.reduceat(drawn, starts)
                flat = pa.array(least.view(np.int32).ravel())
                signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), flat)
                keys = [batch.column(c) for c in ("doc_id", "key_a", "key_b")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]), signatures], [f.split()[0] for f in SIGNATURES.split(", ")])

    return sign


def confirmer(n: int, similarity: int):
    """A function for mapInArrow: of pairs (a, b, text_a, text_b), those whose full shingle sets are similar enough.

    Sets are compared by the words of their shingles. Rows with one ``a`` follow each other, so that its text is taken
    once a batch.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text_b"):
                ids = batch.column("a").to_numpy()
                heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                firsts = batch.column("text_a").take(pa.array(heads))
                sets = shingle_codes(pa.concat_arrays([firsts.cast(pa.large_string()), batch.column("text_b").cast(pa.large_string())]), n)
                of, keep = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(ids)])), []
                for i, other in zip(of.tolist(), sets[len(heads) :], strict=True):
                    both = len(np.intersect1d(sets[i], other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= similarity * (len(sets[i]) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


SETS = "node long, component long, n_shingles long, sketch array<long>, shingles array<long>"


def sketched(values: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the values, set if an odd number of them have it.

    Two sets differ in at least as many values as their sketches do in bits.
    """
    odd = np.bincount((values >> np.uint64(20)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def spelling(n: int, key: bytes):
    """A function for mapInArrow: (node, component, text) with the text's full shingle set and its sketch."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), n, key)
                sizes = np.array([len(x) for x in sets], np.int64)
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))
                sketches = np.concatenate([sketched(x) for x in sets]) if sets else np.zeros(0, np.int64)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(sketches))
                arrays = [batch.column("node"), batch.column("component"), pa.array(sizes), sketches, lists]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SETS.split(", ")])

    return spell


def alike(a: str, b: str, similarity: int) -> Column:
    """Whether two sets, by their sizes and sketches, may be similar enough: false only for sets that are not."""
    both = F.col(f"n_shingles_{a}") + F.col(f"n_shingles_{b}")
    size = 100 * F.least(f"n_shingles_{a}", f"n_shingles_{b}") >= similarity * F.greatest(f"n_shingles_{a}", f"n_shingles_{b}")
    apart = sum((F.bit_count(F.col(f"sketch_{a}")[i].bitwiseXOR(F.col(f"sketch_{b}")[i])) for i in range(SKETCH)), F.lit(0))
    return size & ((100 + similarity) * (both - apart) >= 2 * similarity * both)


def rarest(posted: DataFrame, slack, nodes: DataFrame | None = None) -> DataFrame:
    """Of ``posted`` (node, place): the places that others have too and that are in the node's prefix.

    Places are ordered by how many nodes have them. Those of one node come first and match nothing, so of a node that
    has m shared places the prefix holds the rarest m - ``slack``. Adds what ``nodes`` (node, ...) holds, ``far`` (the
    less, the more common the node's places are), ``at`` (its place in the prefix) and ``left``: how many shared
    places the node has from this one on.
    """
    common = written(posted.groupBy("place").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-places")
    met = posted.join(common, "place").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rows", "place"))).alias("met"))
    met = met if nodes is None else met.join(nodes, "node")
    kept = [c for c in met.columns if c != "met"]
    far = -F.aggregate("met", F.lit(0).cast("long"), lambda a, x: a + x["rows"])
    head = F.slice("met", 1, F.greatest(F.size("met") - slack, F.lit(0)).cast("int"))
    met = met.select(*kept, far.alias("far"), F.size("met").alias("_met"), F.transform(head, lambda x: x["place"]).alias("_places"))
    met = met.select(*kept, "far", "_met", F.posexplode("_places").alias("at", "place"))
    return met.withColumn("left", F.col("_met") - F.col("at")).drop("_met")


def shared(a: str, b: str):
    """How many coordinates two signatures have in common."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def counted(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Of candidate pairs (a, b), those that share enough coordinates."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("signature").alias(f"_{x}"), F.col("n_shingles").alias(f"_n{x}")) for x in "ab")
    pairs = pairs.join(left, "a").where("true").join(right, "b")
    size = (100 * F.least("_na", "_nb") >= similarity * F.greatest("_na", "_nb")) & (shared("_a", "_b") >= matches(similarity))
    return written(pairs.where(size).select("a", "b"), "near-pairs")


def linked(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """Of written pairs (a, b), the written table of those whose full sets confirm the link."""
    second = written(pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"), "near-texts")
    both = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(confirmer(n, similarity), "a long, b long")
    found = written(found, "near-links")
    dropped(second)
    return found


def placed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, node, component) of the postings; a node without links is its own component."""
    own = lists.select("place", "node").join(labels, "node", "left")
    return own.select("place", "node", F.coalesce("component", "node").alias("component"))


def still_open(lists: DataFrame) -> DataFrame:
    """The postings (place, component, ...) of lists that hold several components, with the list's length ``rows``."""
    several = lists.groupBy("place").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
    return lists.join(written(several.where("low <> high").select("place", "rows"), "near-open"), "place")


def neighbours(tails: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of nodes of two components that follow each other in a list sorted by the place that comes next.

    As many as there are postings at most. A list is sorted in parts of some ``TOGETHER``, so no task has a long one alone.
    """
    part = F.pmod(F.xxhash64("after"), F.ceil(F.col("rows") / TOGETHER))
    order = Window.partitionBy("place", part).orderBy("after", "node")
    of = ("node", "component", "n_shingles", "sketch")
    met = tails.select(*[F.col(c).alias(f"{c}_a") for c in of], *[F.lead(c).over(order).alias(f"{c}_b") for c in of])
    met = met.where(F.col("node_b").isNotNull() & (F.col("component_a") != F.col("component_b")) & alike("a", "b", similarity))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key_a and key_b for every row of ``docs`` (doc_id, text).

    1. Documents with the same shingle set are one node; copies go no further.
    2. Every node is posted under its ``COORDINATES`` coordinate-value pairs. A pair of nodes at the wanted
       similarity shares m = ``matches(similarity)`` of them (one in ten million doesn't), so among the rarest
       ``COORDINATES`` - m + 1 of each it shares one: only that prefix is kept, which leaves the long posting lists
       (common passages) out. The other coordinates aren't merged but skipped to: a candidate's collisions are
       counted on the two signatures.
    3. Every list has a pivot, the node whose postings are the most common: of altered copies, the least altered. The
       first round pairs every node with the most common of its lists' pivots, then, where that left a list's node and
       pivot in two components, with its other pivots. Lists with one component are done: pairs inside a component can't
       change the result.
    4. The second round takes the nodes of lists that still hold several components. Two sets of the wanted similarity
       have a shingle in common among the rarest of each, so only that prefix of every full set is posted. First each
       node meets the one after it in its lists, sorted by the next shingle of the prefix, which links most of a large
       group by as many pairs as there are postings. Pairs across the components that are left are taken from the lists,
       only if the two have enough shared shingles left from there on and their sketches don't differ too much (both
       are bounds: no pair of the wanted similarity is left out). A posting carries the ``EARLIER`` places before it
       and skips pairs that share one of those, so a pair comes up once for each run of shared shingles, not for each
       of them; it is confirmed once. A much altered copy has its own shingles first and pairs with nothing. No list
       is spelled out as pairs before it is shrunk.

    Links are confirmed on the full sets of both texts, by the words of their shingles. Two sets are the same if the
    128-bit digests of their shingles' hashes are; hashes are of words with a key that is drawn for each call, so no words
    can be chosen that share one. ``component_id`` is the least doc_id of the component, null if none of its rows has one.
    ``kept`` marks one document of each: of least doc_id, a row without one only if there is no other. Rows are told
    apart by ``key_a`` and ``key_b`` (``row_keys``): several texts under one doc_id are several documents, rows equal in
    both are marked alike. Null and blank texts have no shingles, link nothing, are their own component and kept. Other
    columns, whatever their names, aren't looked at. A text of any length is worked on whole, at some 80 bytes of memory
    a byte. An empty table gives an empty result.
    """
    a, b = row_keys(docs)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), a.alias("key_a"), b.alias("key_b"), docs["text"].alias("text"))
    key = secrets.token_bytes(16)
    signs = written(docs.mapInArrow(signer(n, key), SIGNATURES), "near-signatures")
    full = signs.where("n_shingles > 0")
    home = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b")).alias("home")
    named = full.groupBy("set_a", "set_b").agg(home, F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    named = written(named.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # numbers that are kept, as they are written
    nodes = named.select("node", "n_shingles", "signature")

    places = F.transform("signature", lambda x, k: F.shiftleft(k.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posted = nodes.select("node", F.explode(places).alias("place"))
    lists = written(rarest(posted, F.lit(matches(similarity) - 1)).drop("at", "left"), "near-lists")
    pivots = lists.groupBy("place").agg(F.min(F.struct("far", "node")).alias("pivot"), F.count(F.lit(1)).alias("rows"))
    pivots = written(pivots.where("rows > 1").select("place", "pivot"), "near-pivots")
    ordered = F.least("pivot.node", "node").alias("a"), F.greatest("pivot.node", "node").alias("b")
    first = lists.select("place", "node").join(pivots, "place").where("pivot.node <> node").groupBy("node").agg(F.min("pivot").alias("pivot"))
    first = written(first.select(*ordered).distinct(), "near-first")
    wanted = lists.select("node").distinct().join(named, "node").select("node", "home.key_a", "home.key_b")
    texts = docs.join(wanted, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"]).select("node", "text")
    texts = written(texts, "near-candidates")
    first_tried = counted(first, nodes, similarity)
    links = linked(first_tried, texts, n, similarity)
    own = written(placed(lists, components(links)), "near-own")

    # All pivots, of the lists and pairs that the first ones left apart.
    placed_pivots = pivots.select("place", "pivot", F.col("pivot.node").alias("node")).join(own, ["place", "node"])
    placed_pivots = written(placed_pivots.select("place", "pivot", F.col("component").alias("_component")), "near-pivots-placed")
    apart = own.join(placed_pivots, "place").where("_component <> component")
    stars = written(apart.select(*ordered).distinct().join(first, ["a", "b"], "left_anti"), "near-stars")
    tried = counted(stars, nodes, similarity)
    links = written(links.union(linked(tried, texts, n, similarity)), "near-links")
    dropped(own)
    labels = components(links)
    tried = written(tried.union(first_tried), "near-tried")  # what the coordinates ruled out is looked at again

    # The second round: nodes of lists with several components.
    own = written(placed(lists, labels), "near-own")
    still = still_open(own).select("node", "component").distinct()
    sets = texts.join(still, "node").select("node", "component", "text")
    sets = written(sets.mapInArrow(spelling(n, key), SETS), "near-sets")
    least = F.floor((F.col("n_shingles") * similarity + 99) / 100) - 1
    posted = sets.select("node", F.explode("shingles").alias("place"))
    tails = written(rarest(posted, least, sets.select("node", "component", "n_shingles")).drop("far"), "near-tails")
    open_tails = still_open(tails).groupBy("node", "component", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("at", "left", "place", "rows"))).alias("met"))
    open_tails = open_tails.join(sets.select("node", "sketch"), "node")
    met = F.transform("met", lambda x: x["place"]).alias("_places"), F.posexplode("met").alias("_at", "_met")
    open_tails = open_tails.select("node", "component", "n_shingles", "sketch", *met)
    before = F.slice("_places", F.greatest(F.col("_at") - EARLIER, F.lit(0)) + 1, F.least(F.col("_at"), F.lit(EARLIER)))
    after = F.get("_places", F.col("_at") + 1)
    open_tails = open_tails.select("node", "component", "n_shingles", "sketch", "_met.place", "_met.left", "_met.rows", before.alias("earlier"), after.alias("after"))
    open_tails = written(open_tails, "near-tails-open")

    beside = written(neighbours(open_tails, similarity).join(tried, ["a", "b"], "left_anti"), "near-beside")
    links = written(links.union(linked(beside, texts, n, similarity)), "near-links")
    labels = components(links)
    rest = open_tails.drop("component", "after", "rows").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = written(still_open(written(rest, "near-tails-placed")), "near-tails-rest")
    left, right = (rest.select("place", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n_shingles", "component", "left", "earlier", "sketch")]) for x in "ab")
    apart = left.join(
        right,
        (left.place == right.place)
        & (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & ((100 + similarity) * F.least("left_a", "left_b") >= similarity * (F.col("n_shingles_a") + F.col("n_shingles_b")))
        & alike("a", "b", similarity)
        & ~F.arrays_overlap("earlier_a", "earlier_b"),
    )
    apart = apart.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    apart = written(apart.join(tried.union(beside), ["a", "b"], "left_anti"), "near-apart")
    more = linked(apart, texts, n, similarity)
    labels = components(links.union(more))

    least = named.select("node", "home").join(labels, "node").groupBy("component").agg(F.min("home").alias("_home"))
    least = labels.join(least, "component").select("node", "_home")
    place_of = named.join(least, "node", "left").select("set_a", "set_b", F.coalesce("_home", "home").alias("home"))
    place_of = written(place_of, "near-result")
    for table in (named, lists, pivots, placed_pivots, texts, first, stars, tried, own, sets, tails, open_tails, beside, rest, apart, links, more):
        dropped(table)
    rows = signs.join(place_of, ["set_a", "set_b"], "left")
    alone = F.col("n_shingles") == 0
    kept = alone | (F.col("home.key_a") == F.col("key_a")) & (F.col("home.key_b") == F.col("key_b"))
    return rows.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("home.doc_id")).alias("component_id"), kept.alias("kept"), "key_a", "key_b")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by 3-word shingles at 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
