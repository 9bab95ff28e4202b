"""Scalar rules as column expressions: strings, numbers, booleans, canonical JSON, fingerprints, CSV cells."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of the record rules, tokens that count as empty, and boolean words.
SPACE_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
EMPTY_TOKENS = ("", "null", "undefined", "n/a", "na", "none", "nil", "-")
TRUE_WORDS = ("true", "yes", "1", "on")
FALSE_WORDS = ("false", "no", "0", "off")

SPACE = f"[{SPACE_CHARACTERS}]"

#: Longest field name. Values are cut only where a length is asked for; these are the lengths of the rules' origin.
MAX_NAME, MAX_STRING, MAX_TRAINING_TEXT = 200, 100_000, 200_000

#: A word boundary between ASCII word characters and all else, whichever side the word is on.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def trimmed(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def cut(c: Column, most: int | None) -> Column:
    """The first ``most`` characters; all of them if ``most`` is None."""
    return c if most is None else F.substring(c, 1, most)


def clean_string(c: Column, most: int | None = None) -> Column:
    """Null as empty, NULs removed, trimmed, then cut if a length is given."""
    return cut(trimmed(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\0"), F.lit(""))), most)


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition; the engine has no built-in, so non-ASCII values go through Arrow batches."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def as_number(c: Column) -> Column:
    """The double that a whole string spells once commas are gone; null if it spells none."""
    plain = F.replace(trimmed(c), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[-+]?\d+(?:\.\d+)?$"), plain.try_cast("double"))


def as_boolean(c: Column) -> Column:
    """The boolean that a word spells; null if it spells none."""
    word = F.lower(trimmed(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def is_empty_token(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c.cast("string"))).isin(*EMPTY_TOKENS)


def is_blank(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, a blank string, or an empty array."""
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if kind is None or isinstance(kind, T.StringType):
        return c.isNull() | (trimmed(c.cast("string")) == "")
    return c.isNull()


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0)).cast("long")


def canonical_json(columns: list[str]) -> Column:
    """JSON of the columns with keys sorted at every depth; nulls stay."""
    return F.to_json(F.to_variant_object(F.struct(*[F.col(c) for c in sorted(columns)])))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(columns), 256)


def record_json(columns: list[str]) -> Column:
    """JSON of the columns in their own order; nulls stay."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def csv_cell(c: Column, delimiter: str = ",") -> Column:
    """A cell as written: quoted only if it holds a quote, a line break or the delimiter; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    special = text.contains('"') | text.contains("\n") | text.contains("\r") | text.contains(delimiter)
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[str], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[csv_cell(F.col(c), delimiter) for c in columns])


def over_length(df: DataFrame, columns: list[str], most: int = MAX_STRING) -> DataFrame:
    """(field, records): how many values of each column a cut at ``most`` characters would shorten."""
    one = df.agg(*[F.count_if(F.length(trimmed(F.col(c).cast("string"))) > most).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "records")


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
