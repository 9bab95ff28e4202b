"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, normalised over all words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.labelled import fold
from quarrymill.llm.scratch import written
from quarrymill.llm.words import mixed, pieces, words

#: Symbols of the model: frequent words of their own, the end of a text, and classes for all other words.
OWN, CLASSES = 127, 128
SYMBOLS = OWN + 1 + CLASSES
#: Words before the predicted one, dimensions of a vector.
CONTEXT, DIMENSIONS = 3, 24
EPOCHS, BATCH, NOISE, RATE = 4, 4096, 64, 0.1
#: Steps at least: small corpora are gone through more often. A training task has as many in a round.
STEPS = 300
#: Times that the tasks' parameters are brought together, each after an equal share of the passes.
ROUNDS = 2
#: Parameters are summed as whole numbers of this part of one, so that no order of summing changes them.
GRAIN = 2.0**-40
#: Words whose counts every task holds, at most; the counts of all others are joined.
FREQUENT = 1 << 18
#: The end of a text, as a word's hash and beginning.
END_HASH, END_HEAD = np.uint64(0xE4D0FD0C5A17B3F1), 0
#: Contexts of a batch that are worked on at a time, so that their arrays stay in a core's cache.
ROWS = 512
#: Tokens after one context that are learned from as one row, at most; tokens that a task gathers before it learns.
TOGETHER, GATHERED = 16, 1 << 21
#: Parts of one that vectors are rounded to in these products.
FINE = 2.0**16
#: Logits up to which powers of e are taken of each context word's part, so that their product is a float's.
SAFE = 25.0


class Tokens(NamedTuple):
    """Tokens of consecutive texts: hashes, first two bytes, text, and bounds; each text ends with the end token."""

    hash: np.ndarray
    head: np.ndarray
    text: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = words(texts, lower=True)
    n = len(texts)
    following = np.minimum(w.start + 1, w.end - 1)
    head = w.data[w.start].astype(np.int64) * 256 + w.data[following] if len(w.start) else np.zeros(0, np.int64)
    ends = w.first[1:]
    text = np.insert(w.doc, ends, np.arange(n))
    return Tokens(np.insert(w.hash, ends, END_HASH), np.insert(head, ends, END_HEAD), text, w.first + np.arange(n + 1))


def coded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and the place among them of each."""
    found = pa.array(hashes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: text to (word, head, n), counts of each piece's distinct tokens."""
    for whole in batches:
        for batch in pieces(whole):
            t = tokens(batch.column("text"))
            word, code = coded(t.hash)
            head = np.zeros(len(word), np.int32)
            head[code] = t.head  # equal words, equal heads
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(head), pa.array(np.bincount(code, minlength=len(word)))], ["word", "head", "n"])


class Counts(NamedTuple):
    """What every task needs of the corpus counts; its size has a bound whatever the corpus."""

    total: int
    distinct: int
    least: int  # words with this count or more are in ``words``
    words: np.ndarray
    numbers: np.ndarray
    own: np.ndarray  # words that are symbols, sorted
    class_of: np.ndarray  # by the first two bytes
    class_total: np.ndarray  # counts plus kinds plus one of each class
    symbol_total: np.ndarray | None = None  # counts of each symbol


def summed(counts: DataFrame, frequent: int = FREQUENT) -> Counts:
    """Totals, the most frequent words, and the classes of the others by their first two bytes.

    The driver gets one row, a histogram of counts by powers of 2**(1/4), at most ``frequent`` words and one row for
    each of 65,536 beginnings.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    step = F.floor(F.log2("n") * 4).cast("int")
    many, least = 0, 1 << 62
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        many += row["v"]
        if many > frequent:
            break
        least = row["least"]
    top = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    word, number = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(word)
    word, number = word[order], number[order]
    ranked = counts.where(F.col("word") != int(END_HASH.view(np.int64))).orderBy(F.desc("n"), "word").limit(OWN).select("word", "n").collect()
    own = np.array([r["word"] for r in ranked], np.int64).view(np.uint64)
    by_word = np.argsort(own)
    own, own_n = own[by_word], np.array([r["n"] for r in ranked], np.float64)[by_word]
    others = counts.where(~F.col("word").isin([int(x) for x in own.view(np.int64)]) & (F.col("word") != int(END_HASH.view(np.int64))))
    heads = others.groupBy("head").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow().sort_by([("n", "descending"), ("head", "ascending")])
    at = heads.column("head").to_numpy()
    class_of = (mixed(np.arange(65536, dtype=np.uint64), 31) % np.uint64(CLASSES // 4)).astype(np.int64) + CLASSES * 3 // 4
    class_of[at[: CLASSES * 3 // 4]] = np.arange(len(at[: CLASSES * 3 // 4]))
    share = heads.column("n").to_numpy() + heads.column("v").to_numpy()
    class_total = np.bincount(class_of[at], share, CLASSES) + 1.0
    symbol_total = np.zeros(SYMBOLS)
    symbol_total[: len(own)] = own_n
    symbol_total[OWN + 1 :] = np.bincount(class_of[at], heads.column("n").to_numpy(), CLASSES)
    symbol_total[OWN] = n - symbol_total.sum()
    return Counts(n, v, least, word, number, own, class_of, class_total, symbol_total)


def symbols(t: Tokens, counts: Counts) -> np.ndarray:
    """Words of their own first, then the end, then classes."""
    at = np.minimum(np.searchsorted(counts.own, t.hash), max(len(counts.own) - 1, 0))
    own = counts.own[at] == t.hash if len(counts.own) else np.zeros(len(t.hash), bool)
    return np.where(own, at, np.where(t.hash == END_HASH, OWN, OWN + 1 + counts.class_of[t.head]))


def contexts(symbol: np.ndarray, t: Tokens) -> np.ndarray:
    """The ``CONTEXT`` symbols before each token; ``SYMBOLS`` stands before a text's start."""
    out = np.full((CONTEXT, len(symbol)), SYMBOLS, symbol.dtype)
    for j in range(CONTEXT):
        out[j, j + 1 :] = symbol[: max(len(symbol) - j - 1, 0)]
        for i in range(j + 1):  # of texts that have an i-th token
            out[j, (t.first[:-1] + i)[np.diff(t.first) > i]] = SYMBOLS
    return out


class Model(NamedTuple):
    """Position tables (context vectors times position matrices), target vectors and biases."""

    tables: np.ndarray
    targets: np.ndarray
    bias: np.ndarray


def smoothed(symbol_total: np.ndarray) -> np.ndarray:
    """The noise distribution: add-one shares of the symbols' counts."""
    return (symbol_total + 1.0) / (symbol_total + 1.0).sum()


def shapes() -> list[tuple[int, ...]]:
    return [(SYMBOLS + 1, DIMENSIONS), (CONTEXT, DIMENSIONS, DIMENSIONS), (SYMBOLS, DIMENSIONS), (SYMBOLS,)]


def started(unigram: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Parameters before training (vectors, position matrices, targets, biases), then Adagrad's sums for each."""
    rng = np.random.default_rng(seed)
    d = DIMENSIONS
    vectors = rng.normal(0, 0.1, (SYMBOLS + 1, d))
    mats = np.stack([np.eye(d) * 0.5 + rng.normal(0, 0.01, (d, d)) for _ in range(CONTEXT)])
    params = [vectors, mats, rng.normal(0, 0.1, (SYMBOLS, d)), np.log(unigram)]
    return [x.astype(np.float32) for x in params] + [np.full(x, 1e-2, np.float32) for x in shapes()]


def added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by each of several ``at``; two columns are added at a time, as parts of complex numbers."""
    out = np.zeros((len(at) * n, rows.shape[1]), np.float32)
    order = np.argsort(at, axis=1, kind="stable")
    sizes = np.bincount((at + n * np.arange(len(at))[:, None]).ravel(), minlength=len(out))
    kinds = np.flatnonzero(sizes)
    if len(kinds):
        out.view(np.complex64)[kinds] = np.add.reduceat(rows.view(np.complex64).take(order.ravel(), axis=0, mode="clip"), (np.cumsum(sizes) - sizes)[kinds])
    return out.reshape(len(at), n, -1)


class Followed(NamedTuple):
    """Contexts in rows, each with the run of at most ``TOGETHER`` tokens that follow it in some texts."""

    context: np.ndarray
    start: np.ndarray
    size: np.ndarray
    symbol: np.ndarray  # of the tokens, by context


def numbered(context: np.ndarray) -> np.ndarray:
    """One number for each context."""
    key = context[CONTEXT - 1].astype(np.int64)
    for j in reversed(range(CONTEXT - 1)):
        key = key * (SYMBOLS + 1) + context[j]
    return key


def followed(symbol: np.ndarray, context: np.ndarray) -> Followed:
    """All tokens by their contexts; one that many tokens follow has several rows."""
    found = np.sort(numbered(context) << 32 | np.arange(len(symbol)))  # of one context in the order of the texts
    key, order = found >> 32, found & 0xFFFFFFFF
    starts = np.flatnonzero(np.concatenate([key[:1] >= 0, key[1:] != key[:-1]]))
    sizes = np.diff(starts, append=len(key))
    rows = -(-sizes // TOGETHER)
    of = np.repeat(np.arange(len(starts)), rows)
    before = (np.arange(len(of)) - (np.cumsum(rows) - rows)[of]) * TOGETHER
    start = starts[of] + before
    return Followed(context.T[order[start]].astype(np.int16, order="C"), start, np.minimum(sizes[of] - before, TOGETHER).astype(np.int16), symbol[order].astype(np.int16))


def learned(state: list[np.ndarray], symbol: np.ndarray, context: np.ndarray, unigram: np.ndarray, passes: int, rng: np.random.Generator) -> None:
    """Noise-contrastive estimation: tells each token from ``NOISE`` draws of the unigram, by gradient steps of Adagrad.

    A batch is some ``BATCH`` tokens: random rows of ``followed``, so that what depends on the context alone, the odds
    against the draws, is found once for the tokens of a row and counts with their number. A symbol that is drawn several
    times for a batch is gone through once, with that weight. The odds are products of a power of e for each word of the
    context, which are taken of the position tables once a batch.
    """
    if not len(symbol):
        return
    params, held = state[:4], state[4:]
    vectors, mats, targets, bias = params
    shift = (np.log(unigram) + np.log(NOISE)).astype(np.float32)
    ends, rows = np.cumsum(unigram), followed(symbol, context)
    one, ones, d = np.float32(1), np.ones(max(ROWS, DIMENSIONS), np.float32), DIMENSIONS
    for _ in range(passes):
        order = rng.permutation(len(rows.size))
        cuts = np.searchsorted(np.cumsum(rows.size[order], dtype=np.int64), np.arange(BATCH, len(symbol), BATCH), side="right")
        for chosen in np.split(order, cuts):
            size = rows.size.take(chosen, mode="clip")
            by_size = np.argsort(-size, kind="stable")
            chosen, size = chosen.take(by_size, mode="clip"), size.take(by_size, mode="clip")
            # The rows' first tokens, then the second ones of those that have two, and so on.
            deep = (len(size) - np.cumsum(np.bincount(size))[:-1]).tolist()
            start = rows.start.take(chosen, mode="clip")
            own = rows.symbol.take(np.concatenate([start[:n] + k for k, n in enumerate(deep)]), mode="clip")
            by_row = rows.context.take(chosen, axis=0, mode="clip").T.copy()
            at, mine, many = by_row.astype(np.intp), own.astype(np.intp), np.float32(len(own))  # takes with mode="clip" need no buffer
            times = np.bincount(np.minimum(np.searchsorted(ends, rng.random(NOISE), side="right"), SYMBOLS - 1), minlength=SYMBOLS)
            noise = np.flatnonzero(times)
            tables, level = vectors @ mats, bias - shift
            drawn, weight = targets[noise], -times[noise].astype(np.float32) / many
            against = tables @ -drawn.T
            against[0] -= level[noise]
            factors = np.exp(against) if np.abs(against).max() <= SAFE else None
            by_noise, by_draw = np.zeros((len(noise), d), np.float32), np.zeros(len(noise), np.float32)
            q, back, times_row = np.empty((len(chosen), d), np.float32), np.empty((len(chosen), d), np.float32), size.astype(np.float32)[:, None]
            for part in range(0, len(chosen), ROWS):
                here = slice(part, part + ROWS)
                c, x = at[:, here], q[here]
                tables[0].take(c[0], axis=0, out=x, mode="clip")
                for j in range(1, CONTEXT):
                    x += tables[j].take(c[j], axis=0, mode="clip")
                if factors is None:  # a product may be too large or too small for floats
                    down = sum(against[j].take(c[j], axis=0, mode="clip") for j in range(CONTEXT))
                    np.exp(down, out=down)
                else:
                    down = factors[0].take(c[0], axis=0, mode="clip")
                    for j in range(1, CONTEXT):
                        down *= factors[j].take(c[j], axis=0, mode="clip")
                down += one
                np.divide(weight, down, out=down)  # the negated probabilities of noise
                down *= times_row[here]
                np.matmul(down, drawn, out=back[here])  # becomes the gradient of q
                by_noise += down.T @ x
                by_draw += ones[: len(down)] @ down
            x, g = np.concatenate([q[:n] for n in deep]), targets.take(mine, axis=0, mode="clip")
            up = (x * g) @ ones[:d]
            up += level.take(mine, mode="clip")
            np.exp(up, out=up)
            up += one
            np.divide(one / many, up, out=up)  # how far the token's own probability is from one
            wide = np.repeat(up, d).reshape(-1, d)
            g *= wide
            x *= wide
            for n, end in zip(deep, np.cumsum(deep).tolist(), strict=True):
                back[:n] += g[end - n : end]
            by_word, by_bias = added(own[None], x, SYMBOLS)[0], np.bincount(mine, up, SYMBOLS).astype(np.float32)
            by_word[noise] += by_noise
            by_bias[noise] += by_draw
            by_context = added(by_row, back, SYMBOLS + 1)
            grads = [(by_context @ mats.transpose(0, 2, 1)).sum(0), vectors.T @ by_context, by_word, by_bias]
            for x, g, h in zip(params, grads, held, strict=True):
                h += g * g
                x += RATE * g / np.sqrt(h)


def made(state: list[np.ndarray]) -> Model:
    return Model(np.einsum("sd,jde->jse", state[0], state[1]).astype(np.float32), state[2], state[3])


def passes_of(total: int) -> int:
    """How often all of ``total`` tokens are gone through."""
    return max(EPOCHS, -(-STEPS * BATCH // max(total, BATCH)))


def train(symbol: np.ndarray, context: np.ndarray, seed: int = 5) -> Model:
    """A model of tokens that are here already."""
    unigram = smoothed(np.bincount(symbol, minlength=SYMBOLS))
    state = started(unigram, seed)
    learned(state, symbol, context, unigram, passes_of(len(symbol)), np.random.default_rng(seed))
    return made(state)


def learner(state: list[np.ndarray], counts: Counts, passes: int, number: int):
    """A function for mapInArrow: text to (place, value), the task's parameters in proportion to its tokens.

    A task goes through its texts, ``GATHERED`` tokens or a piece more at a time, from the parameters that all tasks start
    the round with.
    """
    unigram = smoothed(counts.symbol_total)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for whole in batches:
            for batch in pieces(whole):
                t = tokens(batch.column("text"))
                symbol = symbols(t, counts).astype(np.int16)
                held.append(np.concatenate([symbol[None], contexts(symbol, t)]))
                n += len(symbol)
                if n >= GATHERED:
                    found, held, n = np.concatenate(held, axis=1), [], 0
                    yield found[0], found[1:]
        if n:
            found, held = np.concatenate(held, axis=1), []
            yield found[0], found[1:]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = [x.copy() for x in state], 0
        context = TaskContext.get()
        rng = np.random.default_rng([number, context.partitionId() if context else 0])
        for symbol, before in gathered(batches):
            learned(own, symbol, before, unigram, passes, rng)
            n += len(symbol)
        if n:
            value = np.concatenate([x.ravel() for x in own]).astype(np.float64) * (n / counts.total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(np.round(value / GRAIN).astype(np.int64))], ["place", "value"])

    return learn


def trained(texts: DataFrame, counts: Counts) -> Model:
    """A model of all of ``texts`` (text), in ``ROUNDS`` rounds of at least ``EPOCHS / ROUNDS`` passes over all of them.

    In each round every task learns from its share of the texts, and the means of the tasks' parameters, weighted by
    tokens and summed on Spark, start the next. The driver gets some 28,000 numbers a round, whatever the corpus. There
    are no more tasks than have ``STEPS`` steps each; a corpus of fewer is learned by one task, in more passes.
    """
    state = started(smoothed(counts.symbol_total))
    small = counts._replace(words=np.zeros(0, np.uint64), numbers=np.zeros(0, np.int64))
    texts = texts.coalesce(max(1, counts.total // (STEPS * BATCH)))
    for number in range(ROUNDS if counts.total else 0):
        passes = -(-passes_of(counts.total) // ROUNDS)
        sums = texts.mapInArrow(learner(state, small, passes, number), "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(sum(x.size for x in state))
        flat[sums.column("place").to_numpy()] = sums.column("value").to_numpy() * GRAIN
        bounds = np.cumsum([x.size for x in state])[:-1]
        state = [x.reshape(old.shape).astype(np.float32) for x, old in zip(np.split(flat, bounds), state, strict=True)]
    return made(state)


class Norms:
    """Logits of a model by word of the context, and the logs of contexts' sums of powers of e.

    A logit is a sum over the context's words, so its power of e is a product, and the sums of all contexts with one
    farthest word are one matrix product: of the products of the farthest and each middle word's powers, and of the
    nearest word's. These are taken when such a context first occurs, always as a whole. The tables are products of
    whole numbers (parts of ``FINE``) in doubles, which hold them exactly. So a token's probability depends on its own
    context only, not on the place that it has in a batch. The logs are kept as floats, which a task has 68 MB of at most.
    """

    def __init__(self, model: Model):
        one = np.zeros((CONTEXT, SYMBOLS + 1, 1))
        one[0] = 1  # so that the bias is part of the product
        tables = np.round(np.concatenate([model.tables, one], 2) * FINE)
        targets = np.round(np.concatenate([model.targets, model.bias[:, None]], 1).T * FINE)
        self.logits = tables @ targets * FINE**-2
        self.top = self.logits.max(2)
        self.shares = np.exp(self.logits - self.top[:, :, None])
        self.known, self.has = np.empty((SYMBOLS + 1, SYMBOLS + 1, SYMBOLS + 1), np.float32), np.zeros(SYMBOLS + 1, bool)

    def of(self, context: np.ndarray) -> np.ndarray:
        near, middle, far = range(CONTEXT)
        for c in np.flatnonzero(np.bincount(context[far], minlength=SYMBOLS + 1) * ~self.has):
            total = (self.shares[middle] * self.shares[far][c]) @ self.shares[near].T
            total[total < 1e-200] = np.nan  # words that disagree this much: products may be too small for doubles
            self.known[c] = np.log(total)
            self.has[c] = True
        out = sum(self.top[j].take(context[j]) for j in range(CONTEXT)) + self.known.ravel().take(numbered(context))
        low = np.flatnonzero(np.isnan(out))
        if len(low):
            _, first, of = np.unique(numbered(context[:, low]), return_index=True, return_inverse=True)
            for start in range(0, len(first), ROWS):
                whole = sum(self.logits[j][context[j, low[first[start : start + ROWS]]]] for j in range(CONTEXT))
                most = whole.max(1)
                here = (of >= start) & (of < start + ROWS)
                out[low[here]] = (most + np.log(np.exp(whole - most[:, None]).sum(1)))[of[here] - start]
        return out


def log_probabilities(symbol: np.ndarray, context: np.ndarray, model: Model, norms: Norms | None = None) -> np.ndarray:
    """Natural log of each token's normalised probability; ``norms`` are the model's, if there already."""
    norms = norms or Norms(model)
    at = context.astype(np.int64) * SYMBOLS + symbol
    return sum(norms.logits[j].ravel().take(at[j]) for j in range(CONTEXT)) - norms.of(context)


SCORES = "row long, word long, times int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def scorer(model: Model, counts: Counts):
    """A function for mapInArrow: (row, doc_id, held_out, text) to one row a text and one for each rarer word in it.

    A text's row holds the sums over its end, symbols and frequent words, and a word that no text has. The other rows
    hold a word and how often it is there; what its count adds to both scores is left to a join.
    """
    class_log = np.log10(counts.class_total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = Norms(model)
        for whole in batches:
            for batch in pieces(whole):
                n, t = len(batch), tokens(batch.column("text"))
                row = batch.column("row").to_numpy(zero_copy_only=False)
                symbol = symbols(t, counts)
                found = log_probabilities(symbol, contexts(symbol, t), model, norms) / np.log(10)
                in_class = symbol > OWN
                found[in_class] -= class_log[symbol[in_class] - OWN - 1]
                word, code = coded(t.hash)
                at = np.minimum(np.searchsorted(counts.words, word), max(len(counts.words) - 1, 0))
                frequent = counts.words[at] == word if len(counts.words) else np.zeros(len(word), bool)
                plus = (np.where(frequent, np.log10(counts.numbers[at] + 1.0), 0.0) if len(counts.words) else np.zeros(len(word)))[code]
                known = frequent[code]
                base = np.bincount(t.text, plus, n) - np.diff(t.first) * np.log10(counts.total + counts.distinct + 1.0)
                found += np.where(in_class, plus, 0.0)
                rare = np.flatnonzero(~known)
                pair, times = np.unique(t.text[rare] * len(word) + code[rare], return_counts=True)
                of, rarer = np.divmod(pair, max(len(word), 1))
                nothing = lambda kind: pa.nulls(len(pair), kind)
                columns = [
                    (pa.array(row), pa.array(row[of])),
                    (pa.array(mixed(row.view(np.uint64), 41).view(np.int64)), pa.array(word[rarer].view(np.int64))),
                    (pa.array(np.zeros(n, np.int32)), pa.array(times.astype(np.int32))),
                    (batch.column("doc_id").cast(pa.int64()), nothing(pa.int64())),
                    (batch.column("held_out"), nothing(pa.bool_())),
                    (pa.array(np.diff(t.first)), nothing(pa.int64())),
                    (pa.array(np.bincount(t.text[known], minlength=n)), nothing(pa.int64())),
                    (pa.array(base), nothing(pa.float64())),
                    (pa.array(np.bincount(t.text, found, n)), nothing(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], [f.split()[0] for f in SCORES.split(", ")])

    return score


def scored(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Counts are of all tokens of all documents outside the held-out fold, and the network learns from all of them
    (``trained``). It predicts a frequent word, the end, or a class of words by their beginning; a word of a class
    has its add-one share of the class's training tokens, one share being for all unseen words. So the probabilities
    of all words, seen or not, add up to one. Words' counts that don't fit the bounded table are joined by word, from
    counts that were summed before they were shuffled.

    A null or empty text is its end alone. Rows that repeat are scored alike; in an empty table nothing is. Words are
    known by 64-bit hashes. Without any training tokens the model is uniform over its symbols.
    """
    rows = docs.select("doc_id", "text", (fold("doc_id", modulus) == held_out).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = training.select("text").mapInArrow(counter, "word long, head int, n long").groupBy("word").agg(F.min("head").alias("head"), F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    known = summed(counts)
    model = trained(training.select("text"), known)
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(scorer(model, known), SCORES)
    rare = counts.where(F.col("n") < known.least).select(F.col("word").alias("_word"), F.col("n").alias("_n"))
    joined = parts.join(rare, parts["word"] == rare["_word"], "left")
    log = F.sum(F.when(F.col("_n").isNotNull(), F.col("times") * F.log10(F.col("_n") + 1.0)).otherwise(0.0))
    more = F.sum(F.when(F.col("_n").isNotNull(), F.col("times")).otherwise(0))
    whole = joined.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
        (F.max("n_known") + more).cast("long").alias("n_known"),
        (F.max("base") + log).alias("base_score"),
        (F.max("score") + log).alias("score"),
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_log_bilinear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
