"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.labelled import fold, training_rows
from quarrymill.llm.words import _LOWER, Words, buffers, codes, pieces

#: Byte lengths of the n-grams, buckets of the embedding table, and dimensions of an embedding.
GRAMS, BUCKETS_LOG, DIMENSIONS = (3, 4, 5), 18, 4
#: Words of a segment and between the starts of segments. A text is as toxic as its most toxic segment.
SEGMENT, STRIDE = 32, 16
#: Rows of the bounded training sample by class, and full-batch steps before and after segments are picked.
SAMPLE = {1: 1000, 0: 1500}
#: Bytes of the longest text that is trained on.
LONGEST = 200_000
STEPS = (20, 40)
#: Step size of the embeddings, damping of rare n-grams, and weight of all but the top segment of texts that are not toxic.
RATE, FLOOR, OTHERS = 0.5, 3e-5, 0.1


class Text(NamedTuple):
    """Words of consecutive texts in padded bytes: ``start`` and ``end`` of each word, and first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def padded(texts: pa.Array) -> Text:
    """Bytes with A to Z folded and every gap a space, one before and after every text."""
    data, bounds = buffers(texts)
    data = np.insert(_LOWER[data], bounds, 32)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    data[gap] = 32
    edge = np.diff(gap.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    return Text(data, start, end, np.searchsorted(start, bounds + np.arange(len(bounds))))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at every position."""
    packed = np.zeros(max(len(data) - n + 1, 0), np.uint64)
    for j in range(n):
        packed = (packed << np.uint64(8)) | data[j : j + len(packed)]
    packed = (packed + np.uint64(n << 48)) * np.uint64(0x9E3779B97F4A7C15)
    return ((packed ^ (packed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS_LOG)).astype(np.int64)


def spans(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of the n-grams of each word with a space on either side."""
    return start - 1, np.maximum(end - start + 3 - n, 0)


def segments(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of all segments: whole short texts, else runs that end with the text."""
    counts = np.diff(first)
    many = np.where(counts > SEGMENT, -(-(counts - SEGMENT) // stride) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    low = first[:-1][text] + (np.arange(len(text)) - (np.cumsum(many) - many)[text]) * stride
    return text, low, np.minimum(low + SEGMENT, first[1:][text])


#: Scores are summed in whole numbers of this part of one, so that no order of summing and no other text changes them.
GRAIN = 2.0**-32


class Model(NamedTuple):
    """What is left of a trained model for scoring: each bucket's embedding times the softmax's class difference."""

    table: np.ndarray
    bias: float


class _Adam:
    """Adam. ``floor`` damps parameters whose gradients are small, as those of n-grams that few texts have are."""

    def __init__(self, value: np.ndarray, rate: float, floor: float = 1e-8):
        self.value, self.rate, self.floor, self.t = value, rate, floor, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + self.floor)


class _Sums:
    """Sums of rows by index, prepared once: for each key the run of rows that it sums, in key order."""

    def __init__(self, index: np.ndarray, of: np.ndarray, n: int):
        order = np.argsort(index, kind="stable")
        self.of = of[order].astype(np.int32)
        sizes = np.bincount(index, minlength=n)
        self.keys = np.flatnonzero(sizes)
        self.bounds = np.concatenate([[0], np.cumsum(sizes[self.keys])])
        self.n = n

    def __call__(self, rows: np.ndarray, most: int = 1 << 19) -> np.ndarray:
        """The sums of ``rows[of]`` by key, about ``most`` gathered rows at a time."""
        out = np.zeros((self.n, rows.shape[1]), np.float32)
        at = 0
        while at < len(self.keys):
            end = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + most, side="right")) - 1)
            low, high = self.bounds[at], self.bounds[end]
            out[self.keys[at:end]] = np.add.reduceat(rows[self.of[low:high]], self.bounds[at:end] - low, axis=0)
            at = end
        return out


def _vocabulary(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Every word as its place among the distinct words, those, and each text's first word."""
    t = padded(texts)
    code, kinds = codes(Words(t.data, t.start, t.end, t.start, t.start, t.first))
    return code, kinds.to_pylist(), t.first


def train(texts: pa.Array, labels: np.ndarray, seed: int = 3, steps: tuple[int, int] = STEPS) -> Model:
    """Embeddings and softmax trained together on whole texts.

    A word is the mean of its n-grams' embeddings, a segment the mean of its words. In the first steps every segment
    bears its text's label; then each text counts with its most toxic segment, and those not toxic a little with the rest.
    """
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BUCKETS_LOG, np.float32), 20.0 if labels.size and labels[0] else -20.0)
    token, vocabulary, first = _vocabulary(texts)
    n_words = len(vocabulary)
    vocabulary = np.frombuffer(b" " + b" ".join(vocabulary) + b" ", np.uint8)
    gaps = np.flatnonzero(vocabulary == 32)
    owner, bucket = [], []
    for n in GRAMS:
        low, many = spans(gaps[:-1] + 1, gaps[1:], n)
        which = np.repeat(np.arange(n_words, dtype=np.int32), many)
        owner.append(which)
        bucket.append(grams(vocabulary, n)[low[which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]].astype(np.int32))
    owner_of, bucket_of = np.concatenate(owner), np.concatenate(bucket)
    each = (1.0 / np.bincount(owner_of, minlength=n_words)).astype(np.float32)
    by_word, by_bucket = _Sums(owner_of, bucket_of, n_words), _Sums(bucket_of, owner_of, 1 << BUCKETS_LOG)
    del owner, bucket, owner_of, bucket_of
    seg_text, low, end = segments(first, SEGMENT)
    size = end - low
    seg_of = np.repeat(np.arange(len(low)), size)
    word_of = token[low[seg_of] + np.arange(len(seg_of)) - (np.cumsum(size) - size)[seg_of]]
    by_segment, by_token = _Sums(seg_of, word_of, len(low)), _Sums(word_of, seg_of, n_words)
    del seg_of, word_of, token
    rng = np.random.default_rng(seed)
    embeddings = _Adam(rng.normal(0, 0.1, (1 << BUCKETS_LOG, DIMENSIONS)).astype(np.float32), RATE, FLOOR)
    weights = _Adam(rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), 0.1)
    bias = _Adam(np.zeros(2, np.float32), 0.1)
    target = labels[seg_text]
    for step in range(sum(steps)):
        words = by_word(embeddings.value) * each[:, None]
        bags = by_segment(words) / size[:, None]
        logits = bags @ weights.value + bias.value
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        share = np.ones(len(low), np.float32)
        if step >= steps[0]:
            top = np.full(len(labels), -1.0)
            np.maximum.at(top, seg_text, p[:, 1])
            share = np.where(p[:, 1] == top[seg_text], 1, np.where(target == 1, 0, OTHERS)).astype(np.float32)
        error = p.copy()
        error[np.arange(len(low)), target] -= 1
        error *= (share / share.sum())[:, None]
        back = ((error @ weights.value.T) / size[:, None]).astype(np.float32)
        per_word = by_token(back) * each[:, None]
        weights.step((bags.T @ error).astype(np.float32))
        bias.step(error.sum(0).astype(np.float32))
        embeddings.step(by_bucket(per_word))
    difference = weights.value[:, 1] - weights.value[:, 0]
    return Model((embeddings.value @ difference).astype(np.float32), float(bias.value[1] - bias.value[0]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of toxicity of each text: of its most toxic segment. Texts without words have that of no words.

    A text's score depends on its own bytes only, not on the texts around it: all running sums are of whole numbers.
    """
    text, table = padded(texts), np.round(model.table / GRAIN).astype(np.int64)
    value, many_all = np.zeros(len(text.start), np.int64), np.zeros(len(text.start), np.int64)
    for n in GRAMS:
        sums = np.zeros(max(len(text.data) - n + 1, 0) + 1, np.int64)
        np.cumsum(table[grams(text.data, n)], out=sums[1:])
        at, many = spans(text.start, text.end, n)
        at = np.minimum(at, len(sums) - 1)
        value += sums[np.minimum(at + many, len(sums) - 1)] - sums[at]
        many_all += many
    sums = np.zeros(len(value) + 1, np.int64)
    np.cumsum(np.round(value / np.maximum(many_all, 1)).astype(np.int64), out=sums[1:])
    of, low, end = segments(text.first)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, of, (sums[end] - sums[low]) / (end - low) * GRAIN)
    return 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best), best, 0) + model.bias, -60, 60)))


def fitted(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, modulus: int = 5, held_out: int = 0) -> Model:
    """A model from at most ``sample[c]`` labelled documents of each class outside the held-out fold, of at most
    ``LONGEST`` bytes each.

    Fewer or one class only: the model then says that class for all; without labels it says not toxic.
    """
    rows = training_rows(docs, labels, "toxic", modulus, held_out, sample, LONGEST)
    table = rows.toArrow().sort_by("doc_id")
    return train(table.column("text").combine_chunks(), table.column("_label").to_numpy())


def scorer(model: Model):
    """A function for mapInArrow: (doc_id, text) to (doc_id, score)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found = scores(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found)], ["doc_id", "score"])

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row of ``docs`` (doc_id, text).

    Only the text is looked at, whole, whatever its length (at some 80 bytes of memory a byte) and whatever columns
    there are. Null and blank texts get the score of a text without words, the model's bias. Equal texts have equal
    scores. An empty table gives an empty result. The model has a fixed size whatever it was trained on.
    """
    rows = docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rejecting(model: Model, threshold: float = 0.5):
    """A function for mapInArrow that drops toxic rows and passes all columns of the others on as they are."""

    def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                yield batch.filter(pa.array(scores(batch.column("text"), model) < threshold))

    return reject


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
