"""Quality: a generalised additive model with pairwise interactions, lookup tables fitted by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.labelled import fold, training_rows
from quarrymill.llm.near_dedup import shingle_hashes
from quarrymill.llm.words import _LOWER, between, pieces, prefix, span_hashes, words

#: Rows of the bounded training sample by class.
SAMPLE = {1: 10_000, 0: 10_000}
#: Bytes of the longest text that is trained on.
LONGEST = 1_000_000
#: Bins of a feature, cycles over all features and over all pairs, leaves of a tree, step, and pairs that are fitted.
BINS, CYCLES, PAIR_CYCLES, LEAVES, RATE, PAIRS = 32, 150, 60, 3, 0.1, 8

FEATURES = (
    "log_words", "word_bytes", "upper_letters", "digits", "punctuation", "symbols", "exclamations", "symbol_words",
    "distinct_words", "distinct_shingles", "stutters", "line_words", "distinct_lines", "longest_word", "sentence_words",
    "non_ascii",
)


def _classes() -> np.ndarray:
    out = np.zeros((7, 256), np.int8)
    out[0, 65:91] = 1
    out[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[2, 48:58] = 1
    out[3, [ord(c) for c in ".,;:!?'\"()-"]] = 1
    out[4, [ord(c) for c in "#$%&*|@^~<>{}[]\\_=+/`"]] = 1
    out[5, [ord(c) for c in "!?"]] = 1
    out[6, 128:] = 1
    return out


_CLASS = _classes()


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])] if len(text) else np.zeros(0, bool)
    return np.bincount(text[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text, from whole texts; a text without words has zeros.

    Sums are of whole numbers and hashes of a text's own bytes, so a row doesn't depend on the texts around it.
    """
    n, w = len(texts), words(texts)
    counts = np.diff(w.first)
    many = np.maximum(counts, 1)
    size = (w.end - w.start).astype(np.float64)
    totals, with_symbol = [], None
    for k, row in enumerate(_CLASS):  # one class at a time, in 4 bytes a byte
        sums = np.zeros(len(w.data) + 1, np.int32 if len(w.data) < 2**31 else np.int64)
        np.cumsum(row[w.data], out=sums[1:])
        in_word = sums[w.end] - sums[w.start]
        totals.append(np.bincount(w.doc, in_word, n))
        with_symbol = in_word > 0 if k == 4 else with_symbol
    upper, letters, digits, punctuation, symbols, exclamations, high = totals
    total = np.maximum(np.bincount(w.doc, size, n), 1)
    symbol_words = np.bincount(w.doc, with_symbol, n) / many
    folded = span_hashes(_LOWER[w.data], w.start, w.end)
    shingles, of = shingle_hashes(folded, w.first, 3)
    repeats = np.r_[False, (folded[1:] == folded[:-1]) & (w.doc[1:] == w.doc[:-1])] if len(folded) else np.zeros(0, bool)
    line = np.cumsum(w.data == 10, dtype=np.int32 if len(w.data) < 2**31 else np.int64)[w.start] + w.doc  # a new text begins a new line
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    own = between(prefix(folded), heads, np.r_[heads[1:], len(line)]) if len(heads) else np.zeros(0, np.uint64)
    lines = np.maximum(np.bincount(w.doc[heads], minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, size)
    ends = np.bincount(w.doc, np.isin(w.data[w.end - 1], [46, 33, 63]) if len(w.end) else None, n)
    out = np.stack(
        [
            np.log1p(counts), total / many, upper / np.maximum(letters, 1), digits / total, punctuation / total, symbols / total,
            exclamations / total, symbol_words, _distinct(w.doc, folded, n) / many, _distinct(of, shingles, n) / np.maximum(np.bincount(of, minlength=n), 1),
            np.bincount(w.doc, repeats, n) / many, counts / lines, _distinct(w.doc[heads], own, n) / lines, longest, counts / np.maximum(ends, 1),
            high / total,
        ],
        axis=1,
    )
    out[counts == 0] = 0
    return out


class Model(NamedTuple):
    """Bin edges, a table for each feature, and a table for each fitted pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], 1)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree over one feature's bins, split greedily; the Newton step of each bin's leaf."""
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(at[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of depth two over two features' bins: the best cut of the first, then of the second on either side."""
    best = (-1.0, np.zeros_like(gradient))
    for axis in (0, 1):
        g, h = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        up, hup = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        score = lambda a, b: a * a / (b + 1.0)
        top, htop = up[:-1], hup[:-1]
        low, hlow = up[-1] - top, hup[-1] - htop
        sides = []
        for s, hs in ((top, htop), (low, hlow)):
            gains = score(s, hs) + score(s[:, -1:] - s, hs[:, -1:] - hs)
            sides.append((np.argmax(gains, 1), gains.max(1)))
        at = int(np.argmax(sides[0][1] + sides[1][1]))
        value = float(sides[0][1][at] + sides[1][1][at])
        if value > best[0]:
            out = np.zeros_like(g)
            for (cut, _), rows, s, hs in ((sides[0], slice(0, at + 1), top[at], htop[at]), (sides[1], slice(at + 1, None), low[at], hlow[at])):
                c = int(cut[at])
                out[rows, : c + 1] = s[c] / (hs[c] + 1.0)
                out[rows, c + 1 :] = (s[-1] - s[c]) / (hs[-1] - hs[c] + 1.0)
            best = (value, out if axis == 0 else out.T)
    return best[1]


def train(x: np.ndarray, labels: np.ndarray) -> Model:
    """Boosts shallow trees feature by feature in cycles, then trees over the pairs that explain most of what is left."""
    y = np.asarray(labels, np.float64)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    tables = np.zeros((x.shape[1], BINS))
    if len(set(y.tolist())) < 2:
        return Model(20.0 if not len(y) or y[0] else -20.0, edges, tables, [], np.zeros((0, BINS, BINS)))
    bins = binned(x, edges)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    logit = np.zeros(len(y))
    for _ in range(CYCLES):
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _tree(np.bincount(bins[:, k], weight * (y - p), BINS), np.bincount(bins[:, k], weight * p * (1 - p), BINS))
            tables[k] += step
            logit += step[bins[:, k]]
    cells = {(i, j): bins[:, i] * BINS + bins[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda at, v: np.bincount(at, v, BINS * BINS).reshape(BINS, BINS)
    p = 1 / (1 + np.exp(-logit))
    gains = {ij: float((_pair_tree(grid(at, weight * (y - p)), grid(at, weight * p * (1 - p))).ravel()[at] * weight * (y - p)).sum()) for ij, at in cells.items()}
    pairs = sorted(gains, key=lambda ij: (-gains[ij], ij))[:PAIRS]
    pair_tables = np.zeros((len(pairs), BINS, BINS))
    for _ in range(PAIR_CYCLES):
        for k, ij in enumerate(pairs):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _pair_tree(grid(cells[ij], weight * (y - p)), grid(cells[ij], weight * p * (1 - p)))
            pair_tables[k] += step
            logit += step.ravel()[cells[ij]]
    return Model(0.0, edges, tables, pairs, pair_tables)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1: the sum of one table entry a feature and a pair, added up for all texts at once."""
    bins = binned(features(texts), model.edges)
    logit = np.full(len(texts), model.intercept) + model.tables[np.arange(bins.shape[1])[None, :], bins].sum(1)
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        logit += table[bins[:, i], bins[:, j]]
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text, _label) to (doc_id, _label, x)."""
    for whole in batches:
        for batch in pieces(whole):
            x = features(batch.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("_label"), flat], ["doc_id", "_label", "x"])


def fitted(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, modulus: int = 4, held_out: int = 2) -> Model:
    """A model from the features of at most ``sample[c]`` labelled documents of each class outside the held-out fold, of
    at most ``LONGEST`` bytes each.

    Features are taken where the documents are; the driver gets 16 numbers a sampled row. With one class only the
    model says that class for all, without labels it says 1.
    """
    rows = training_rows(docs, labels, "quality", modulus, held_out, sample, LONGEST)
    table = rows.mapInArrow(extractor, "doc_id long, _label int, x array<double>").toArrow().sort_by("doc_id")
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return train(x, table.column("_label").to_numpy())


def scorer(model: Model):
    """A function for mapInArrow: (doc_id, text) to (doc_id, score)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found = scores(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found)], ["doc_id", "score"])

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row of ``docs`` (doc_id, text).

    Only the text is looked at, whole, whatever its length (at some 40 bytes of memory a byte) and whatever columns
    there are. Null and blank texts have all features 0. Equal texts have equal scores. An empty table gives an empty
    result. The model has a fixed size whatever it was trained on.
    """
    rows = docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
