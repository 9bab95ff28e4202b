"""Records of any structure and of mixed types, as JSON texts: cleaned value by value, profiled field by field."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.names import normalized_all
from quarrymill.functions.text import EMPTY_TOKENS, FALSE_WORDS, SPACE, SPACE_CHARACTERS, TRUE_WORDS, percent, trimmed
from quarrymill.operators.clean import CleanOptions

_NUMBER = re.compile(r"[-+]?[0-9]+(?:\.[0-9]+)?")


def _number(text: str) -> int | float | None:
    plain = text.strip(SPACE_CHARACTERS).replace(",", "")
    if not _NUMBER.fullmatch(plain):
        return None
    value = float(plain)
    return None if value in (float("inf"), float("-inf")) else int(value) if value.is_integer() and abs(value) < 1e21 else value


def cleaned_value(value: object, o: CleanOptions) -> object:
    """A value by the cleaning rules, at every depth: strings are normalised and become numbers or booleans where they spell one."""
    if isinstance(value, list):
        return [cleaned_value(x, o) for x in value]
    if isinstance(value, dict):
        return {k: cleaned_value(x, o) for k, x in value.items()}
    if not isinstance(value, str):
        return value
    text = unicodedata.normalize("NFKC", value)
    text = re.sub(f"{SPACE}+", " ", text).strip(" ") if o.normalize_whitespace else text
    text = text.strip(SPACE_CHARACTERS) if o.trim else text
    if not text and o.empty_to_null:
        return None
    if o.normalize_numbers and (number := _number(text)) is not None:
        return number
    word = text.strip(SPACE_CHARACTERS).lower()
    if o.normalize_booleans and word in (*TRUE_WORDS, *FALSE_WORDS):
        return word in TRUE_WORDS
    return text if o.most is None else text[: o.most]


def cleaned_record(record: object, o: CleanOptions) -> tuple[dict, bool]:
    """(a record with clean names and values, whether it holds nothing). A string is ``{text}``, another value ``{value}``."""
    own = record if isinstance(record, dict) else {"text" if isinstance(record, str) else "value": record}
    names = normalized_all(list(own)) if o.normalize_names else list(own)
    out: dict = {}
    for name, value in zip(names, own.values(), strict=True):
        new = cleaned_value(value, o)
        spelt = new.strip(SPACE_CHARACTERS).lower() if isinstance(new, str) else None
        out[name] = (None if o.empty_to_null else "") if new is None or spelt in EMPTY_TOKENS else new
    return out, all(x is None or x == "" or x == [] for x in out.values())


def _cleaner(o: CleanOptions) -> Callable[[Column], Column]:
    @F.pandas_udf("record string, changed boolean, empty boolean")
    def clean(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                before = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                rows.append((None, None, None))
                continue
            after, empty = cleaned_record(before, o)
            rows.append((json.dumps(after, ensure_ascii=False, separators=(",", ":")), after != before or list(map(type, after.values())) != list(map(type, before.values())), empty))
        return pd.DataFrame(rows, columns=["record", "changed", "empty"])

    return clean


def clean_json(df: DataFrame, json_column: str, o: CleanOptions = CleanOptions()) -> DataFrame:
    """Add ``_record``, ``_changed``, ``_empty`` and ``_problem`` to rows with a JSON value each.

    Unlike a typed table, one field may hold 14 in one record and ``"unknown"`` in the next: every value is converted by
    itself, inside of lists and objects too, whatever their depth. Nothing is shuffled. A text that is no JSON (null too)
    has no record and the problem ``INVALID_JSON``; with ``remove_empty`` records that hold nothing go.
    """
    rows = df.withColumn("_clean", _cleaner(o)(F.col(json_column)))
    rows = rows.withColumns({"_record": F.col("_clean.record"), "_changed": F.col("_clean.changed"), "_empty": F.col("_clean.empty")}).drop("_clean")
    rows = rows.withColumn("_problem", F.when(F.col("_record").isNull(), "INVALID_JSON"))
    return rows.where(~F.coalesce(F.col("_empty"), F.lit(False))) if o.remove_empty else rows


#: JSON types by the beginning of a variant's type.
_TYPES = (("ARRAY", "array"), ("OBJECT", "object"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))
KINDS = ("string", "number", "boolean", "array", "object", "null")


def json_values(df: DataFrame, json_column: str, order: str) -> DataFrame:
    """(_row, field, pos, kind, text, empty): the top-level values of JSON objects, fields in the order in which they are written."""
    value = F.try_parse_json(F.col(json_column))
    rows = df.select(F.col(order).alias("_row"), F.json_object_keys(F.col(json_column)).alias("_keys"), value.alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    rows = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null")
    of, kind = F.schema_of_variant("value"), F.lit("number")
    for head, name in _TYPES:
        kind = F.when(of.startswith(head), name).otherwise(kind)
    text = F.when(kind == "string", F.variant_get("value", "$", "string")).otherwise(F.to_json("value"))
    empty = (kind == "null") | (kind == "string") & (trimmed(text) == "") | (kind == "array") & (text == "[]")
    return rows.select("_row", F.col("key").alias("field"), (F.array_position("_keys", F.col("key")) - 1).alias("pos"), kind.alias("kind"), text.alias("text"), empty.alias("empty"))


def json_profile(df: DataFrame, json_column: str, order: str, examples: int = 3, cut: int = 100) -> DataFrame:
    """One row a field of JSON objects: present, missing, empty, non_empty, completeness, first_row, first_pos, n_<type>, examples.

    ``missing`` counts all rows without the field, those that aren't objects included. Fields sorted by ``first_row`` and
    ``first_pos`` are in order of appearance. ``examples`` are the first filled values by ``order``, long strings cut. Counts
    are summed in each task before the shuffle, and a task passes on ``examples`` values a field at most, so a field that all
    records have makes no large group.
    """
    values = json_values(df, json_column, order)
    first = F.min(F.struct("_row", "pos")).alias("first")
    counts = values.groupBy("field").agg(F.count(F.lit(1)).alias("present"), F.count_if("empty").alias("empty"), first, *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    near = Window.partitionBy("field").orderBy("_row", "pos")
    shown = F.when(F.col("kind") == "string", F.substring("text", 1, cut)).otherwise(F.col("text"))
    some = values.where(~F.col("empty")).select("field", "_row", "pos", shown.alias("text")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= examples)
    some = some.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("e")).select(F.col("field").alias("_field"), F.transform("e", lambda x: x["text"]).alias("examples"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = counts.join(some, F.col("field") == F.col("_field"), "left").crossJoin(F.broadcast(total))
    return out.select(
        "field", "present", (F.col("total") - F.col("present")).alias("missing"), "empty", (F.col("present") - F.col("empty")).alias("non_empty"), percent(F.col("present"), F.col("total")).alias("completeness"),
        F.col("first._row").alias("first_row"), F.col("first.pos").cast("long").alias("first_pos"), *[f"n_{k}" for k in KINDS], F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )
