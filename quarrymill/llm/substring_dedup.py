"""Removal of repeated passages: relative Lempel-Ziv parsing against an index of anchored phrases.

Every text is cut into overlapping phrases at anchors that its own words choose, so two texts that share a passage cut
it into the same phrases. The distinct phrases of all texts are the reference, each with its first occurrence, dealt into
blocks by the hash of their anchor. A text is parsed by looking its phrases up: phrases that follow each other in one
reference text make a factor (a copy with a source), one that occurs once ends it. At such a factor boundary the
phrase's windows are looked up one by one, so that a copy is known to the word. Phrases and windows are equal if
their words are: they are compared by 128-bit BLAKE2b digests of the words, never by the hashes that pick anchors. No
text is compared with another, and no group is spelled out as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.rows import row_keys
from quarrymill.llm.scratch import dropped, written
from quarrymill.llm.words import Words, between, digests, pieces, prefix, signed, words

#: Words of the shortest factor that counts as a duplicate, and words of an anchor.
WINDOW, ANCHOR = 35, 8


class Phrases(NamedTuple):
    """Phrases of consecutive texts. A phrase holds ``windows`` windows, the first at word ``low`` of all words."""

    doc: np.ndarray
    low: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For every i with i + span <= len: the index of the first least value among values[i:i+span]."""
    best, at, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        first = left <= right
        best, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        width += step
    return at


def phrases(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> Phrases:
    """Phrases of the texts of ``w``.

    The anchor of a window is its ``anchor``-word run of least hash, the first of several. Neighbouring windows of one
    anchor make a phrase: all their words. Which anchor a window has depends on its own words only.
    """
    empty = np.zeros(0, np.int64)
    none = Phrases(empty, empty, empty, empty.astype(np.uint64))
    if len(w.hash) < window:
        return none
    starts = np.arange(len(w.hash) - anchor + 1)
    runs = between(prefix(w.hash), starts, starts + anchor, 3)
    owner = leftmost_least(runs, window - anchor + 1)
    whole = np.flatnonzero(w.doc[: len(owner)] == w.doc[window - 1 : window - 1 + len(owner)])
    if not len(whole):
        return none
    owner = owner[whole]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    low, many = whole[heads], np.diff(np.r_[heads, len(owner)])
    return Phrases(w.doc[low], low, many, runs[owner[heads]])


def halves(found: pa.Array) -> np.ndarray:
    """Digests of 16 bytes as two whole numbers each."""
    return np.frombuffer(b"".join(found.to_pylist()), "<i8").reshape(-1, 2) if len(found) else np.zeros((0, 2), np.int64)


PHRASES = "anchor long, content_a long, content_b long, key_a long, key_b long, low int, windows int"
SPELLED = "anchor long, content_a long, content_b long, place int, window_a long, window_b long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def indexer(window: int, anchor: int):
    """A function for mapInArrow: (key_a, key_b, text) to the phrases of every text."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                w = words(batch.column("text"))
                found = phrases(w, window, anchor)
                content = halves(digests(w, found.low, found.low + found.windows - 1 + window))
                keys = [batch.column(k).to_numpy(zero_copy_only=False)[found.doc] for k in ("key_a", "key_b")]
                low, many = (found.low - w.first[:-1][found.doc]).astype(np.int32), found.windows.astype(np.int32)
                yield _batch([signed(found.anchor), content[:, 0], content[:, 1], *keys, low, many], PHRASES)

    return index


def speller(window: int, anchor: int):
    """A function for mapInArrow: (text, wanted) to the digests of all windows of each text's wanted phrases.

    ``wanted`` holds first words of phrases within the text.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                w = words(batch.column("text"))
                found, asked = phrases(w, window, anchor), batch.column("wanted")
                of = np.repeat(np.arange(len(batch)), np.diff(asked.offsets.to_numpy(zero_copy_only=False)))
                at = np.flatnonzero(np.isin(found.low, w.first[:-1][of] + asked.flatten().to_numpy(zero_copy_only=False)))
                low, many = found.low[at], found.windows[at]
                content = halves(digests(w, low, low + many - 1 + window))
                which = np.repeat(np.arange(len(at)), many)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                start = low[which] + offset
                own = halves(digests(w, start, start + window))
                yield _batch([signed(found.anchor[at][which]), content[which, 0], content[which, 1], offset.astype(np.int32), own[:, 0], own[:, 1]], SPELLED)

    return spell


class Factor(NamedTuple):
    """Words [start, end) of a text that are repeated; ``source`` and ``place`` say where, for copies of whole phrases."""

    start: int
    end: int
    source: int | None = None
    place: int | None = None


def factors(low: list[int], windows: list[int], mask: list[int], source: list[int], place: list[int], window: int = WINDOW) -> list[Factor]:
    """The greedy parse of a text over its phrases in order: a copied phrase is added to the factor that it continues.

    ``mask`` -1 marks a phrase that is copied whole, from word ``place`` of ``source``; else bit i tells whether window
    ``low`` + i is repeated, which was looked up as the phrase stands at a factor boundary. Factors don't overlap.
    """
    out: list[Factor] = []
    for at, many, bits, src, to in sorted(zip(low, windows, mask, source, place, strict=True)):
        if bits == -1:
            last = out[-1] if out else None
            if last and last.source == src and last.place is not None and last.place - last.start == to - at and at <= last.end:
                out[-1] = last._replace(end=at + many - 1 + window)
            else:
                out.append(Factor(at, at + many - 1 + window, src, to))
        else:
            for i in range(many):
                if bits >> i & 1:
                    last = out[-1] if out else None
                    if last and last.place is None and at + i == last.end - window + 1:
                        out[-1] = last._replace(end=at + i + window)
                    else:
                        out.append(Factor(at + i, at + i + window))
    apart: list[Factor] = []
    for f in sorted(out, key=lambda f: f.start):
        over = max(apart[-1].end - f.start, 0) if apart else 0  # words that the factor before holds already
        if f.start + over < f.end:
            apart.append(f._replace(start=f.start + over, place=None if f.place is None else f.place + over))
    return apart


def spans(found: list[Factor]) -> list[tuple[int, int]]:
    """The words that factors hold, as [start, end)."""
    out: list[tuple[int, int]] = []
    for f in found:
        if out and f.start == out[-1][1]:
            out[-1] = (out[-1][0], f.end)
        else:
            out.append((f.start, f.end))
    return out


FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("place", pa.int32())])


def remover(window: int):
    """A function for mapInArrow: (doc_id, text, found) to what is left of each text without its duplicate factors."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
                    own = (text or "").encode().split()  # bytes split at the same six bytes as words
                    copied: list[Factor] = []
                    if found.is_valid:
                        copied = factors(*(found.values.field(f).to_pylist() for f in ("low", "windows", "mask", "source", "place")), window)
                    kept, at = [], 0
                    for a, b in spans(copied):
                        kept += own[at:a]
                        at = b
                    kept += own[at:]
                    joined = b" ".join(kept)
                    rows.append((len(own), len(own) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode(), [f._asdict() for f in copied]))
                n, gone, sha, left, parsed = zip(*rows, strict=True)
                arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(left), pa.array(parsed, pa.list_(FACTOR))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])

    return remove


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:int,end:int,source:long,place:int>>"


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """What is left of every row of ``docs`` (doc_id, text) without the words of repeated ``window``-word windows.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text and the factors of the parse, as word bounds with the
    doc_id and word that a whole phrase is copied from (null for single windows). A window counts as repeated if its
    words also start anywhere else, in the same text too. A row that is there twice repeats itself whole. Other
    columns, whatever their names, aren't looked at. Null and empty texts have no words; texts shorter than a window
    lose none; a text of any length is worked on whole, at some 60 bytes of memory a byte. An empty table gives an
    empty result.

    Rows are told apart by doc_id and a hash of the text; those without a doc_id by two. Phrases of unshared anchors,
    the bulk, are dropped after one count. Joins on anchors that are in very many texts are split by adaptive
    execution, as both their sides start at written tables; counts are summed before they are shuffled.
    """
    if not 0 <= window - anchor <= 62:
        raise ValueError("a window has 0 to 62 words more than an anchor")
    a, b = row_keys(docs)
    docs = docs.select("doc_id", "text", a.alias("key_a"), b.alias("key_b"))
    index = written(docs.select("key_a", "key_b", "text").mapInArrow(indexer(window, anchor), PHRASES), "phrases")
    anchors = written(index.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor"), "anchors")
    shared = written(index.join(anchors, "anchor"), "phrases-shared")
    dropped(index)
    dropped(anchors)

    phrase = ["anchor", "content_a", "content_b"]
    reference = shared.groupBy(*phrase).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("key_a", "key_b", "low")).alias("home"))
    reference = written(reference, "reference")
    several = written(reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "anchors-open")
    wanted = reference.join(several, "anchor").select("home.key_a", "home.key_b", "home.low")
    wanted = wanted.groupBy("key_a", "key_b").agg(F.collect_list("low").alias("wanted"))
    spelled = docs.join(wanted, ["key_a", "key_b"]).select("text", "wanted")
    spelled = written(spelled.mapInArrow(speller(window, anchor), SPELLED), "windows")
    dropped(several)
    own = ["anchor", "window_a", "window_b"]
    each = spelled.select(*phrase, "place", "window_a", "window_b")
    again = each.groupBy(*own).agg(F.min(F.struct("content_a", "content_b")).alias("low"), F.max(F.struct("content_a", "content_b")).alias("high")).where("low <> high")
    again = written(again.select(*own), "windows-again")
    masks = each.join(again, own).groupBy(*phrase).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))

    copied = F.when(F.col("rows") > 1, F.lit(-1).cast("long")).otherwise(F.col("mask"))
    known = reference.join(masks, phrase, "left").select(*phrase, copied.alias("mask"), F.col("home.key_a").alias("source"), F.col("home.low").alias("place"))
    known = written(known.where("mask is not null"), "reference-known")
    for table in (reference, spelled, again):
        dropped(table)
    found = shared.join(known, phrase).groupBy("key_a", "key_b").agg(F.collect_set(F.struct("low", "windows", "mask", "source", "place")).alias("found"))
    return docs.join(found, ["key_a", "key_b"], "left").select("doc_id", "text", "found").mapInArrow(remover(window), REMOVED)


def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
