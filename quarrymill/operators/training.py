"""Training records: six shapes, usable ones, splits, label and role statistics, prompts and chat texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.errors import TrainingError
from quarrymill.functions.ordering import by_digest, dense_number, placed
from quarrymill.functions.scratch import dropped, written
from quarrymill.functions.text import clean_string, trimmed, utf16_length
from quarrymill.operators.clean import is_empty_record
from quarrymill.operators.dedup import deduplicate

# Chat roles under their other names, and the fields that text is looked for in.
ROLES = {
    "user": "user", "human": "user", "المستخدم": "user", "assistant": "assistant", "bot": "assistant",
    "model": "assistant", "المساعد": "assistant", "system": "system", "النظام": "system",
}
TEXT_FIELDS = ("text", "content", "body", "prompt", "input", "question", "output", "answer")
FIELDS = {
    "instruction": {"instruction": ("prompt", "question", "instruction"), "input": ("context", "input"), "output": ("answer", "response", "output")},
    "classification": {"text": ("content", "input", "text"), "label": ("category", "class", "label")},
    "seq2seq": {"input": ("source", "text", "input"), "target": ("output", "answer", "target")},
}
MODES = ("generic", "text", "instruction", "classification", "chat", "seq2seq")


def normalize_role(c: Column) -> Column:
    role = F.lower(clean_string(c, 50))
    out = F.lit("user")
    for name, to in ROLES.items():
        out = F.when(role == name, to).otherwise(out)
    return out


def _first(df: DataFrame, names: tuple[str, ...], field: str | None = None) -> Column:
    """The first of the columns that isn't null; a field that was asked for comes first."""
    have = [F.col(n).cast("string") for n in ([field] if field else []) + list(names) if n in df.columns]
    return clean_string(F.coalesce(*have, F.lit("")) if have else F.lit(""))


def extract_text(df: DataFrame, columns: list[str], fields: list[str] | None = None) -> Column:
    """The named fields joined, else the first filled text field, else all values joined."""
    full = lambda c: F.nullif(clean_string(F.col(c)), F.lit(""))
    if fields:
        return F.concat_ws(" ", *[full(f) for f in fields if f in columns])
    known = [full(f) for f in TEXT_FIELDS if f in columns]
    return F.coalesce(*known, F.concat_ws(" ", *[full(c) for c in columns]))


def to_chat(df: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """(conversation, messages): turns of each conversation in order, blank ones dropped, roles normalised.

    A conversation is one training record, so its turns meet in one row; repeats of a turn stay.
    """
    text = clean_string(F.col(content))
    rows = df.select(conversation, F.struct(F.col(turn).alias("turn"), normalize_role(F.col(role)).alias("role"), text.alias("content")).alias("m"))
    rows = rows.where(F.col("m.content") != "")
    chats = rows.groupBy(conversation).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return chats.select(conversation, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chat_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def transform(df: DataFrame, columns: list[str], order: str, mode: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Records of a mode with ``_row`` and ``_usable``; chat takes a ``messages`` column or user and assistant fields."""
    fields, row = fields or {}, F.col(order).alias("_row")
    filled = lambda c: trimmed(F.col(c)) != ""
    if mode == "generic":
        out = placed(df, [F.col(order)], "_row_index").select(row, *columns, "_row_index")
        return out.withColumn("_usable", ~is_empty_record(df, columns, "training"))
    if mode == "text":
        return df.select(row, extract_text(df, columns).alias("text")).withColumn("_usable", filled("text"))
    if mode == "chat":
        if "messages" in columns:
            out = df.select(row, "messages")
        else:
            said = {"system": ("system",), "user": ("user", "question", "input", "prompt"), "assistant": ("assistant", "answer", "output", "response")}
            parts = [F.struct(F.lit(r).alias("role"), _first(df, names).alias("content")) for r, names in said.items()]
            out = df.select(row, F.filter(F.array(*parts), lambda m: m["content"] != "").alias("messages"))
        return out.withColumn("_usable", F.exists("messages", lambda m: m["content"] != ""))
    if mode not in FIELDS:
        raise TrainingError("INVALID_MODE", f"mode is one of {MODES}")
    out = df.select(row, *[_first(df, names, fields.get(f)).alias(f) for f, names in FIELDS[mode].items()])
    needed = {"instruction": ("instruction", "output"), "classification": ("text", "label"), "seq2seq": ("input", "target")}[mode]
    return out.withColumn("_usable", reduce(lambda a, b: a & b, [filled(c) for c in needed]))


def prompt(instruction: Column, given: Column, output: Column) -> Column:
    part = lambda head, c: F.when(trimmed(c) != "", F.concat(F.lit(head), c)).otherwise("")
    return F.concat(instruction, part("\n\nInput:\n", given), part("\n\nOutput:\n", output))


def normalize_splits(train: float = 0.8, validation: float = 0.1, test: float = 0.1) -> tuple[float, float, float]:
    parts = (train, validation, test)
    if any(not isinstance(p, (int, float)) or p != p or abs(p) == float("inf") for p in parts):
        raise TrainingError("INVALID_SPLIT")
    if any(p < 0 for p in parts):
        raise TrainingError("NEGATIVE_SPLIT")
    if not sum(parts):
        raise TrainingError("ZERO_SPLIT")
    return tuple(p / sum(parts) for p in parts)  # type: ignore[return-value]


def split_counts(total: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Whole rows of train and validation; test gets what is left."""
    train, validation = int(total * ratios[0]), int(total * ratios[1])
    return train, validation, total - train - validation


def split_count_columns(total: Column, ratios: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """``split_counts`` of a column."""
    train, validation = (F.floor(total * r).cast("long") for r in ratios[:2])
    return train, validation, (total - train - validation).cast("long")


def hash_split(df: DataFrame, key: str, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), within: list[str] | None = None) -> DataFrame:
    """Add ``split``: exact shares of a seeded digest order of ``key``, of all rows or of each group of ``within``.

    The order doesn't depend on partitions, and no task sorts all rows. A group's own size sets its shares.
    """
    ratios, keys = normalize_splits(*ratios), list(within or [])
    bucket, digest = by_digest(seed, key)
    rows = dense_number(df, bucket, [digest, F.col(key)], "_at", keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_total")
    rows = rows.join(sizes, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]) if keys else rows.crossJoin(F.broadcast(sizes))  # one row
    first = F.floor(F.col("_total") * ratios[0])
    second = first + F.floor(F.col("_total") * ratios[1])
    split = F.when(F.col("_at") <= first, "train").when(F.col("_at") <= second, "validation").otherwise("test")
    return rows.select(*df.columns, split.alias("split"))


# Multiplier and increment of the shuffle's generator.
MULTIPLIER, INCREMENT = 1664525, 1013904223


def lcg(seed: float = 42):
    """Numbers in [0, 1) of a 32-bit linear congruential generator; not a usable seed counts as 1."""
    state = int(abs(seed)) & 0xFFFFFFFF if seed == seed and abs(seed) != float("inf") else 1
    state = state or 1
    while True:
        state = (state * MULTIPLIER + INCREMENT) % 2**32
        yield state / 2**32


def permutation(n: int, seed: float = 42) -> np.ndarray:
    """A seeded shuffle of 0 to n - 1 from the end, for parity on lists of up to 250,000; ``shuffled`` is the same for tables."""
    if n > 250_000:
        raise TrainingError("TOO_MANY_RECORDS", "use shuffled")
    order, numbers = np.arange(n), lcg(seed)
    for i in range(n - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def lcg_states(k: np.ndarray, seed: float = 42) -> np.ndarray:
    """States of ``lcg`` after ``k`` steps each: jumps by powers of two, as a step done twice is a step of the same form."""
    state = int(abs(seed)) & 0xFFFFFFFF if seed == seed and abs(seed) != float("inf") else 1
    out, left = np.full(len(k), state or 1, np.uint64), k.astype(np.uint64)
    by, plus, mask = MULTIPLIER, INCREMENT, np.uint64(0xFFFFFFFF)
    while left.any():
        jump = (left & np.uint64(1)).astype(bool)
        out[jump] = (out[jump] * np.uint64(by) + np.uint64(plus)) & mask
        by, plus = by * by % 2**32, (by * plus + plus) % 2**32
        left >>= np.uint64(1)
    return out


def drawn(n: int, seed: float):
    """A function for mapInArrow: i to (i, j), the places that the shuffle of ``n`` rows exchanges at its step i."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            numbers = lcg_states(n - i, seed) / 2.0**32
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array((numbers * (i + 1)).astype(np.int64))], ["i", "j"])

    return draw


def shuffled(spark: SparkSession, n: int, seed: float = 42) -> DataFrame:
    """(at, place): the row at ``at`` of 0 to n - 1 is put at ``place`` by the seeded shuffle from the end (``permutation``).

    Step i exchanges places i and j, from the last i down to 1; what is then at i stays. So what step i takes from j is
    what the next larger step with the same j left there: the row that it found at its own place. That row, in turn, is
    what the smallest step k > i that draws i found at k, and so on up, to a step whose place nobody has drawn before;
    there the row is the one that started at that place. Such ways are short (their mean grows with the logarithm of n)
    and doubled by a join, each way's end being its own next, until all are at their ends. A place is drawn some
    log(n / place) times, so groups are small.
    """
    draws = spark.range(n).mapInArrow(drawn(n, seed), "i long, j long")
    by_place = draws.groupBy("j").agg(F.sort_array(F.collect_list("i")).alias("steps"))
    by_place = written(by_place, "shuffle-draws")
    after = F.filter("steps", lambda k: k > F.col("j"))
    ways = by_place.select(F.col("j").alias("at"), F.get(after, F.lit(0)).alias("found")).where("found is not null")
    ways, going = written(ways, "shuffle-ways"), True
    while going:
        ends = ways.select(F.col("at").alias("_at"), F.col("found").alias("_end"))
        further = ways.join(ends, F.col("found") == F.col("_at"), "left").select("at", F.coalesce("_end", "found").alias("found"), F.col("_end").isNotNull().alias("moved"))
        further = written(further, "shuffle-ways")
        dropped(ways)
        ways, going = further, not further.where("moved").isEmpty()
    steps = by_place.select("j", "steps", F.posexplode("steps").alias("k", "place"))
    steps = steps.select("j", "place", F.get("steps", F.col("k") + 1).alias("later"))
    taken = steps.join(ways, F.col("later") == F.col("at"), "left")
    return taken.select(F.coalesce("found", "later", "j").alias("at"), "place")


def lcg_split(df: DataFrame, order: str, seed: float = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Add ``split`` and ``place`` as the seeded shuffle deals rows in the order of ``order``, however many there are."""
    shares = normalize_splits(*ratios)
    rows = placed(df, [F.col(order)], "_n")
    n = rows.count()
    train, validation, _ = split_counts(n, shares)
    deal = shuffled(df.sparkSession, n, seed).select(F.col("at").alias("_at"), "place")
    rows = rows.join(deal, F.col("_n") - 1 == F.col("_at"))
    split = F.when(F.col("place") < train, "train").when(F.col("place") < train + validation, "validation").otherwise("test")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"), "place")


def label_histogram(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, records, first_row): blanks left out, most frequent first, ties in the order of first rows."""
    text = clean_string(F.col(label), 500)
    out = df.select(text.alias("label"), F.col(order).alias("_row")).where("label <> ''")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.min("_row").alias("first_row")).orderBy(F.desc("records"), "first_row")


def class_balance(df: DataFrame, label: str, order: str) -> DataFrame:
    """One row: classes, least and most records of a class, their ratio, and whether that is one half or more."""
    ratio = F.when(F.max("records") > 0, F.round(F.min("records") / F.max("records"), 4)).otherwise(F.lit(0.0))
    one = label_histogram(df, label, order).agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.min("records"), F.lit(0)).alias("least"), F.coalesce(F.max("records"), F.lit(0)).alias("most"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    return one.withColumn("balanced", F.col("ratio") >= 0.5)


def chat_statistics(chats: DataFrame, conversation: str) -> DataFrame:
    """(role, messages, conversations) over a ``messages`` column."""
    rows = chats.select(conversation, F.explode("messages").alias("m"))
    each = rows.groupBy(conversation, F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("role").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("conversations"))


def text_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: records, characters (UTF-16 units) and tokens at four characters each."""
    parts = [clean_string(F.col(c)) for c in columns]
    length = utf16_length(trimmed(F.concat_ws(" ", *parts)))
    one = df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("characters"))
    return one.withColumn("tokens", F.ceil(F.col("characters") / 4).cast("long"))


def statistics(df: DataFrame, columns: list[str], mode: str, order: str, label: str = "label") -> DataFrame:
    """One row: the text figures of a mode's records; of classification with the balance of labels, of chat with messages."""
    one = text_statistics(df, [c for c in columns if c != "messages"]) if mode != "chat" else text_statistics(df.withColumn("_said", chat_text(F.col("messages"))), ["_said"])
    if mode == "classification":
        one = one.crossJoin(F.broadcast(class_balance(df, label, order)))  # one row each
    if mode == "chat":
        one = one.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum(F.size("messages")), F.lit(0)).cast("long").alias("messages"))))
    return one


def prepare(df: DataFrame, columns: list[str], order: str, mode: str, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> tuple[DataFrame, DataFrame]:
    """(records with ``_row`` and ``split``, rejected rows): drop empties and repeats, convert, drop repeats, split."""
    full = df.where(~is_empty_record(df, columns, "training"))
    first = deduplicate(full, columns, order)
    made = transform(first, columns, order, mode)
    names = [c for c in made.columns if c not in ("_row", "_usable")]
    good = made.where("_usable").drop("_usable")
    good = deduplicate(good, names, "_row") if mode != "generic" else good
    rejected = made.where("not _usable").select(F.col("_row").alias("index"), F.lit("UNUSABLE_RECORD").alias("reason"))
    return hash_split(good, "_row", seed, ratios), rejected
