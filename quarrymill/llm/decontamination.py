"""Benchmark decontamination: texts as templates, windows of templates joined by hash, slots checked for consistency."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.rows import row_keys
from quarrymill.llm.scratch import dropped, written
from quarrymill.llm.words import _LOWER, between, pieces, prefix, signed, span_hashes, words

#: Canonical tokens of a window, literal ones among them at least, and share of an item's windows that makes a leak.
WINDOW, LITERALS, SHARE = 8, 5, 0.5
#: Literal tokens of an item without such a window that may be found with other values.
FEW = 3
#: Windows of the benchmark that are sent to every task at most; beyond that all windows are shuffled.
SENT = 2_000_000

# Words that are units where they follow a number.
UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week
weeks month months year years hz khz mhz ghz b kb mb gb tb byte bytes v w kw kwh j kj c f k percent % cent cents
dollar dollars euro euros usd eur gbp degree degrees mph kph kmh
""".split()

def _hashes(spelt: list[str]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in spelt])
    return span_hashes(np.frombuffer("".join(spelt).encode(), np.uint8), np.r_[0, ends[:-1]], ends)


_UNIT_HASHES = np.sort(_hashes(UNITS))
NUMBER, UNIT, NAME = _hashes(["\0number", "\0unit", "\0name"])

_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_ASIDE = np.zeros(256, bool)  # bytes that are stripped from either end of a word
_ASIDE[[ord(c) for c in ".,;:!?'\"()[]{}<>*_|#&~`"]] = True
_NUMERIC = np.zeros(256, np.int32)
_NUMERIC[[*range(48, 58), *map(ord, ".,:/-+%$")]] = 1


class Template(NamedTuple):
    """Canonical tokens of consecutive texts, the hashes of the words that they stand for, and bounds by text."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    text: np.ndarray
    first: np.ndarray


def template(texts: pa.Array) -> Template:
    """Words without punctuation around them, folded; numbers, units after numbers and names become placeholders.

    A name is a word with a capital and a small letter that no sentence begins with. Words of punctuation only go.
    """
    w = words(texts)
    data = np.append(w.data, np.uint8(32))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        start += (start < end) & _ASIDE[data[start]]
        end -= (start < end) & _ASIDE[data[end - 1]]
    closes = np.isin(data[w.end - 1], [46, 33, 63]) if len(start) else np.zeros(0, bool)
    opens = np.r_[True, closes[:-1] | (w.doc[1:] != w.doc[:-1])] if len(start) else closes
    keep = start < end
    start, end, doc, opens = start[keep], end[keep], w.doc[keep], opens[keep]
    value = span_hashes(_LOWER[data], start, end)
    digits, numeric = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_DIGIT, _NUMERIC))
    number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
    lead, second = data[start], data[np.minimum(start + 1, end - 1)]
    capital = ((lead >= 65) & (lead <= 90) & (second >= 97) & (second <= 122)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after_number = np.r_[False, number[:-1] & (doc[1:] == doc[:-1])] if len(doc) else number
    unit = after_number & np.isin(value, _UNIT_HASHES)
    name = capital & ~opens & ~number & ~unit
    token = np.select([number, unit, name], [NUMBER, UNIT, NAME], value)
    return Template(token, value, number | unit | name, doc, np.searchsorted(doc, np.arange(len(texts) + 1)))


def windows(t: Template, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, end) of all windows of ``size`` tokens."""
    counts = np.diff(t.first)
    many = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    low = t.first[:-1][text] + np.arange(len(text)) - (np.cumsum(many) - many)[text]
    return between(prefix(t.token), low, low + size, 13), low, low + size


def slot_lists(t: Template, low: np.ndarray, end: np.ndarray) -> pa.Array:
    """The values of the slots in each of the runs [low, end)."""
    slots = np.flatnonzero(t.slot)
    a, b = np.searchsorted(slots, low), np.searchsorted(slots, end)
    index = np.repeat(a, b - a) + np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)), signed(t.value[slots[index]]))


ITEMS = "item_id long, class binary, window long, size int, item_place int, item_windows int, item_literals int, weak boolean, item_slots array<long>"


def itemiser(size: int, literals: int):
    """A function for mapInArrow: (item_id, text) to the windows of every item.

    Windows have ``size`` tokens, ``literals`` of them no slots. An item that has none such is weak: it has all its
    windows, or one of its own length if that is shorter. ``class`` is a digest of its tokens and of which of its slots
    have equal values: items that differ in their values only are of one class.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                t = template(batch.column("text"))
                slots = np.concatenate([[0], np.cumsum(t.slot)])
                running = prefix(t.token)
                for i, item in enumerate(batch.column("item_id").to_pylist()):
                    a, b = int(t.first[i]), int(t.first[i + 1])
                    if a == b:
                        continue
                    own = min(size, b - a)
                    low = np.arange(a, b - own + 1)
                    good = own - (slots[low + own] - slots[low]) >= literals if own == size else np.zeros(1, bool)
                    weak = not good.any()
                    low = low if weak else low[good]
                    values = t.value[a:b][t.slot[a:b]]
                    _, first, pattern = np.unique(values, return_index=True, return_inverse=True)
                    kind = hashlib.blake2b(t.token[a:b].tobytes() + b"|" + first[pattern].astype(np.int64).tobytes(), digest_size=16).digest()
                    n, of = len(low), t.slot[a:b]
                    columns = [
                        pa.array([item] * n, pa.int64()), pa.array([kind] * n, pa.binary()), signed(between(running, low, low + own, 13)), pa.array([own] * n, pa.int32()),
                        pa.array((low - a).astype(np.int32)), pa.array([n] * n, pa.int32()), pa.array([int((~of).sum())] * n, pa.int32()), pa.array([weak] * n), slot_lists(t, low, low + own),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ITEMS.split(", ")])

    return cut


WINDOWS = "id long, key_a long, key_b long, window long, place int, slots array<long>"


def windower(known: np.ndarray | None, sizes: list[int]):
    """A function for mapInArrow: (id, key_a, key_b, text) to windows with the values of their slots; of ``known`` hashes only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                t = template(batch.column("text"))
                for size in sizes:
                    hashes, low, end = windows(t, size)
                    if known is not None:
                        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                        hashes, low, end = hashes[hit], low[hit], end[hit]
                    text = t.text[low]
                    names = [batch.column(c).take(pa.array(text)) for c in ("id", "key_a", "key_b")]
                    place = (low - t.first[:-1][text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*names, signed(hashes), pa.array(place), slot_lists(t, low, end)], [f.split()[0] for f in WINDOWS.split(", ")])

    return cut


def evidence(met: list[dict], whole: int = 0) -> tuple[list[int], bool]:
    """Item windows of one alignment that count, and whether some slot's value differs.

    Every value of the item reads as the document's value that most windows give it, itself if others have no more.
    Windows with the item's own values count, and altered ones that agree with the reading. If two of the item's values
    read as one, those that some window keeps read as themselves; if two still do, there is no reading and none count.
    If ``whole`` is given, altered windows count only if that many do, all that the item has.
    """
    support = Counter(pair for m in met for pair in zip(m["item_slots"], m["slots"], strict=True))
    reading = dict(pair for pair, _ in sorted(support.items(), key=lambda x: (x[1], x[0][0] == x[0][1], x[0])))  # the last stays
    if len(set(reading.values())) < len(reading):
        reading = {a: a if (a, a) in support else b for a, b in reading.items()}
    if len(set(reading.values())) < len(reading):
        return [], False
    agrees = lambda m: all(reading[a] == b for a, b in zip(m["item_slots"], m["slots"], strict=True))
    places = [m["item_place"] for m in met if m["item_slots"] == m["slots"] or agrees(m)]
    other = any(m["item_slots"] != m["slots"] for m in met)
    if other and whole and len(set(places)) < whole:
        return [m["item_place"] for m in met if m["item_slots"] == m["slots"]], False
    return places, other


LINES = "key_a long, key_b long, id long, class binary, item_windows int, places array<int>, other boolean"


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: alignments with the windows that met to those with windows that count.

    Altered windows of a weak item count only where the whole item is met and has some literal tokens.
    """
    for batch in batches:
        weak, total, plain = (batch.column(c).to_pylist() for c in ("weak", "item_windows", "item_literals"))
        whole = [(n if k >= FEW else n + 1) if w else 0 for w, n, k in zip(weak, total, plain, strict=True)]
        found = [evidence(met.as_py(), n) for met, n in zip(batch.column("met"), whole, strict=True)]
        names = [f.split()[0] for f in LINES.split(", ")]
        columns = [batch.column(c) for c in names[:-2]] + [pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([o for _, o in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([bool(p) for p, _ in found], pa.bool_()))


def classes(items: DataFrame) -> DataFrame:
    """(class, item_id, items) of ``itemiser``'s windows: the least item and the number of items of every class."""
    return items.groupBy("class").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("items"))


def members(benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, representative): which item stands for each in the results of ``leaks``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    each = items.mapInArrow(itemiser(size, literals), ITEMS).select("item_id", "class").distinct()
    return each.join(each.groupBy("class").agg(F.min("item_id").alias("representative")), "class").select("item_id", "representative")


def candidates(found: DataFrame, own: DataFrame, share: float = SHARE) -> DataFrame:
    """(key_a, key_b, class): documents that may hold ``share`` of an item's windows, by its rarest ones.

    Whoever holds ``need`` of an item's n windows holds one of any n - need + 1 of them. Those that the documents hold least
    often are taken, so what many items begin with brings documents and items together only where it is most of the item.
    Windows are counted before anything is joined; each item's are ranked apart.
    """
    often = found.groupBy("window").agg(F.count(F.lit(1)).alias("often"))
    need = F.greatest(F.ceil(F.lit(share) * F.col("item_windows") - 1e-6), F.lit(1))
    ranked = own.join(often, "window", "left").withColumn("rarity", F.row_number().over(Window.partitionBy("class").orderBy(F.coalesce("often", F.lit(0)), "item_place")))
    rare = ranked.where(F.col("often").isNotNull() & (F.col("rarity") <= F.col("item_windows") - need + 1)).select("class", "window").distinct()
    return found.select("key_a", "key_b", "window").distinct().join(rare, "window").select("key_a", "key_b", "class").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, share: float = SHARE, sent: int = SENT) -> DataFrame:
    """(key_a, key_b, doc_id, item_id, items, n_windows, share, reparameterised): the benchmark items in each document.

    Windows of ``size`` canonical tokens are joined by hash. Along one alignment of document and item, windows with
    the item's own values count, and altered ones that agree with the reading of most windows, in which two values may
    not share one (``evidence``): an item with other numbers or names is found, also where one place differs from the
    rest, a chance meeting of templates isn't. An item counts as leaked if the windows of its alignments that count
    are ``share`` of all it has. Items that are shorter than a window, or of slots mostly, are found by all their
    windows: verbatim, or altered where the whole item is there (``judged``). ``reparameterised`` says that some slot's
    value differs.

    Items whose templates are equal and that differ in their values only are one class, found as its least item, with
    ``items`` members (listed by ``members``); so a template with many variants isn't joined with each. An item_id with
    several texts is several items. If the
    benchmark has at most ``sent`` different windows (which is counted), tasks get their hashes and only windows with
    those are shuffled; else all are. Documents and items meet by an item's rarest windows (``candidates``) and only then
    by all of them. An item in very many documents makes a skewed join, which adaptive execution splits.

    ``key_a`` and ``key_b`` are the keys by which rows are told apart (``row_keys``); documents that repeat are reported
    once. Null and empty texts have no windows, items without an item_id aren't looked for, other columns of either
    table, whatever their names, aren't looked at. A text of any length is worked on whole. Empty tables give an empty
    result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    items = written(items.mapInArrow(itemiser(size, literals), ITEMS), "benchmark-windows")
    first = written(classes(items), "benchmark-classes")
    own = written(items.join(first, ["class", "item_id"]).drop("item_id").dropDuplicates(["class", "item_place"]), "benchmark-own")
    dropped(items)
    kinds = own.select("window").distinct()
    known = None
    if kinds.count() <= sent:
        known = np.sort(kinds.toArrow().column("window").to_numpy().view(np.uint64))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # 1 to ``size``
    a, b = row_keys(docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), a.alias("key_a"), b.alias("key_b"), docs["text"].alias("text"))
    found = written(texts.mapInArrow(windower(known, sizes), WINDOWS), "document-windows")
    pairs = written(candidates(found, own, share), "document-items")
    met = found.join(pairs.join(own.drop("size"), "class"), ["key_a", "key_b", "window"]).withColumn("shift", F.col("place") - F.col("item_place"))
    alignment = ["key_a", "key_b", "id", "class", "shift"]
    same = [F.max(c).alias(c) for c in ("item_windows", "item_literals", "weak")]
    lines = met.groupBy(*alignment).agg(*same, F.collect_set(F.struct("item_place", "item_slots", "slots")).alias("met"))
    lines = lines.mapInArrow(judged, LINES)
    whole = lines.groupBy("key_a", "key_b", "id", "class").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("other").alias("reparameterised")
    )
    whole = whole.withColumn("share", F.col("n_windows") / F.col("item_windows")).where(F.col("share") >= share)
    whole = whole.join(first, "class")
    return whole.select("key_a", "key_b", F.col("id").alias("doc_id"), "item_id", "items", "n_windows", "share", "reparameterised")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leaked into the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key_a", "key_b")
