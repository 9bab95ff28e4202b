"""Cleaning of typed records: field names, values, empties, duplicates, and the figures of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.names import normalized, normalized_all
from quarrymill.functions.text import as_boolean, as_number, cut, every, is_blank, is_empty_token, nfkc, normalize_whitespace, percent, some, trimmed
from quarrymill.operators.dedup import deduplicate


@dataclass(frozen=True)
class CleanOptions:
    trim: bool = True
    remove_empty: bool = True
    remove_duplicates: bool = True
    normalize_names: bool = True
    normalize_whitespace: bool = True
    empty_to_null: bool = False
    normalize_numbers: bool = True
    normalize_booleans: bool = False
    most: int | None = None  # characters that strings are cut to


def clean_value(c: Column, kind: T.DataType, o: CleanOptions, inner: bool = False) -> Column:
    """A string normalised (compatibility form, white space, empties, length); containers value by value at every depth."""
    if isinstance(kind, T.StringType):
        text = nfkc(c) if not inner else c  # Arrow functions can't run inside of containers
        text = normalize_whitespace(text) if o.normalize_whitespace else trimmed(text) if o.trim else text
        text = cut(text, o.most)
        return F.when(is_empty_token(text), F.lit(None) if o.empty_to_null else F.lit("")).otherwise(text)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clean_value(x, kind.elementType, o, True))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: clean_value(v, kind.valueType, o, True))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[clean_value(c[f.name], f.dataType, o, True).alias(f.name) for f in kind]))
    return c


def is_empty_record(df: DataFrame, columns: list[str], profile: str = "cleaner") -> Column:
    """Whether a record holds nothing, by one of the rules.

    cleaner: nulls, empty tokens, empty arrays. file: nulls, blank strings, empty arrays. training: nulls and blank
    strings. service: as file.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    tests = []
    for c in columns:
        kind = kinds[c]
        if isinstance(kind, T.StringType):
            tests.append(is_empty_token(F.col(c)) if profile == "cleaner" else is_blank(F.col(c), kind))
        elif isinstance(kind, T.ArrayType) and profile != "training":
            tests.append(F.col(c).isNull() | (F.size(c) == 0))
        else:
            tests.append(F.col(c).isNull())
    return every(tests)


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """String columns of which every non-empty value spells a number: those a typed table can turn into numbers."""
    own = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not own:
        return []
    full = [F.count_if(~is_empty_token(F.col(c))).alias(f"f{i}") for i, c in enumerate(own)]
    good = [F.count_if(~is_empty_token(F.col(c)) & as_number(F.col(c)).isNotNull()).alias(f"g{i}") for i, c in enumerate(own)]
    row = df.agg(*full, *good).first()
    return [c for i, c in enumerate(own) if row[f"f{i}"] and row[f"f{i}"] == row[f"g{i}"]]


def clean_records(df: DataFrame, columns: list[str], order: str, o: CleanOptions = CleanOptions(), carried: list[str] | None = None) -> DataFrame:
    """Every record with clean names and values, plus ``_changed``, ``_reasons`` and ``_empty``; no row goes yet.

    ``carried`` columns are passed on as they are.
    """
    names = normalized_all(columns) if o.normalize_names else list(columns)
    numbers = set(numeric_columns(df, columns)) if o.normalize_numbers else set()
    values, reasons = [], []
    moved = F.lit(names != list(columns))
    changed, emptied = [], []
    for c, name in zip(columns, names, strict=True):
        kind = df.schema[c].dataType
        value = clean_value(F.col(c), kind, o)
        if isinstance(kind, T.StringType):
            emptied.append(is_empty_token(F.col(c)) & ~F.col(c).eqNullSafe(value))
            changed.append(~is_empty_token(F.col(c)) & ~F.col(c).eqNullSafe(value))
            if c in numbers:
                changed.append(~is_empty_token(F.col(c)))
                value = as_number(value)
            elif o.normalize_booleans:
                flag = as_boolean(value)
                value = F.when(flag.isNotNull(), flag.cast("string")).otherwise(value)
        values.append(value.alias(name))
    empty = is_empty_record(df, columns)
    reasons = F.filter(
        F.array(
            F.when(moved, "field_names_normalized"),
            F.when(some(changed), "values_normalized"),
            F.when(some(emptied), "empty_values_normalized"),
            F.when(empty, "empty_record"),
        ),
        lambda x: x.isNotNull(),
    )
    key = F.col(order).alias("_row")
    return df.select(key, *(carried or []), *values, (F.size(reasons) > 0).alias("_changed"), reasons.alias("_reasons"), empty.alias("_empty"))


def clean_dataset(df: DataFrame, columns: list[str], order: str, o: CleanOptions = CleanOptions()) -> tuple[DataFrame, DataFrame]:
    """(clean records with ``_row``, one row of figures): clean, drop empties, keep the first of equal records."""
    rows = clean_records(df, columns, order, o)
    names = [c for c in rows.columns if not c.startswith("_")]
    kept = rows.where(~F.col("_empty")) if o.remove_empty else rows
    out = deduplicate(kept.select("_row", *names), names, "_row") if o.remove_duplicates else kept.select("_row", *names)
    before = rows.agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if("_empty").alias("removed_empty") if o.remove_empty else F.lit(0).cast("long").alias("removed_empty"),
        F.count_if(F.col("_changed") & (~F.col("_empty") | F.lit(not o.remove_empty))).alias("changed_records"),
    )
    figures = before.crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("after"))))  # one row each
    return out, figures.select(
        "before", "after", "removed_empty",
        (F.col("before") - F.col("removed_empty") - F.col("after")).alias("removed_duplicates"),
        "changed_records",
        percent(F.col("after"), F.col("before")).alias("retention_rate"),
        percent(F.col("changed_records"), F.col("before")).alias("change_rate"),
    )


def remove_empty_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank strings become null, the typed form of a key that a record lacks."""
    kinds = {f.name: f.dataType for f in df.schema}
    blank = lambda c: F.when(~is_blank(F.col(c), kinds[c]), F.col(c)).alias(c)
    return df.select(*[blank(c) if c in columns else F.col(c) for c in df.columns])


def keep_fields(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Only the named columns; an empty list keeps all."""
    return df.select(*[c for c in df.columns if not fields or c in fields or c == order])


def reorder_fields(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns first, by normalised name, then the rest as they were."""
    wanted = [normalized(f) for f in first]
    head = [c for c in wanted if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
