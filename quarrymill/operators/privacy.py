"""Sensitive values and names under two rule profiles; URL and address counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.names import sensitive
from quarrymill.functions.text import EDGE, record_json, some

# Patterns of sensitive values, with ASCII word edges, and a literal without which a pattern can't match.
EMAIL = rf"(?i){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}"
PHONE = r"(?:\+?\d[\d\s().-]{7,}\d)"
PASSWORD = rf"(?i){EDGE}(?:password|passwd|pwd)\s*[:=]\s*[^\s]+"
PATTERNS = {
    "library": {
        "email": EMAIL,
        "phone": PHONE,
        "password": PASSWORD,
        "api_key": rf"(?i){EDGE}(?:api[_ -]?key|apikey)\s*[:=]\s*[A-Za-z0-9_\-]{{8,}}",
        "bearer_token": rf"(?i){EDGE}Bearer\s+[A-Za-z0-9\-._~+/]+=*",
        "secret": rf"(?i){EDGE}(?:secret|client_secret)\s*[:=]\s*[^\s]+",
        "private_key": r"-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----",
    },
    "service": {
        "email": EMAIL,
        "phone": PHONE,
        "api_key": rf"(?i){EDGE}(?:sk|pk|api|key)[-_]?[A-Za-z0-9_-]{{12,}}{EDGE}",
        "password": PASSWORD,
        "token": rf"(?i){EDGE}(?:token|secret)\s*[:=]\s*[^\s]+",
    },
}
URL = rf"(?i){EDGE}https?://[^\s<>\"']+"
NEEDED = {
    "email": ("@",), "private_key": ("private key",), "bearer_token": ("bearer",), "secret": ("secret",), "token": ("token", "secret"),
    "password": ("passw", "pwd"),
}
MESSAGES = {
    "email": "an e-mail address",
    "phone": "a phone number",
    "password": "a password",
    "api_key": "an API key",
    "bearer_token": "a bearer token",
    "secret": "a secret",
    "token": "a token or secret",
    "private_key": "a private key",
    "sensitive_field": "a field with a sensitive name",
}


def message(kind: Column) -> Column:
    """What a type of finding is called."""
    out = F.lit(None).cast("string")
    for k, text in MESSAGES.items():
        out = F.when(kind == k, text).otherwise(out)
    return out


def with_hits(df: DataFrame, columns: list[str], profile: str = "library", name: str = "_hits", json: Column | None = None) -> DataFrame:
    """Adds ``name``: a bit for each type of the profile, in rule order, that the serialised record holds.

    The record is serialised once (or is ``json`` already), and a pattern is tried only where one of its literals is; all of it is built in.
    """
    rows = df.withColumn("_json", record_json(columns) if json is None else json).withColumn("_low", F.lower("_json"))
    bits = F.lit(0)
    for i, (kind, pattern) in enumerate(PATTERNS[profile].items()):
        test = F.col("_json").rlike(pattern)
        if profile == "library" and kind == "api_key":
            test = F.contains("_low", F.lit("api")) & test
        elif kind in NEEDED:
            literals = [F.contains("_low", F.lit(x)) for x in NEEDED[kind]]
            test = some(literals) & test
        bits = bits + F.when(test, 1 << i).otherwise(0)
    return rows.withColumn(name, bits).drop("_json", "_low")


def with_types(df: DataFrame, columns: list[str], profile: str = "library", name: str = "findings") -> DataFrame:
    """Adds ``name``: the types of sensitive values that the record holds, in rule order."""
    rows = with_hits(df, columns, profile)
    kinds = [F.when(F.col("_hits").bitwiseAND(1 << i) > 0, k).otherwise("") for i, k in enumerate(PATTERNS[profile])]
    return rows.withColumn(name, F.array_remove(F.array(*kinds), "")).drop("_hits")


def sensitive_values(df: DataFrame, columns: list[str], order: str, profile: str = "library") -> DataFrame:
    """(index, type): one finding for each record and type.

    Types are stacked, not exploded: a filter that the engine infers for an array would search every record again.
    """
    rows = with_hits(df.select(F.col(order).alias("_index"), *columns), columns, profile)
    kinds = [F.when(F.col("_hits").bitwiseAND(1 << i) > 0, k) for i, k in enumerate(PATTERNS[profile])]
    return rows.select(F.col("_index").alias("index"), F.stack(F.lit(len(kinds)), *kinds).alias("type")).where("type is not null")


def sensitive_counts(df: DataFrame, columns: list[str], profile: str = "library") -> DataFrame:
    """(type, findings) for every type of the profile, 0 included, in one pass."""
    kinds = list(PATTERNS[profile])
    one = with_hits(df.select(*columns), columns, profile).agg(*[F.count_if(F.col("_hits").bitwiseAND(1 << i) > 0).alias(k) for i, k in enumerate(kinds)])
    return one.unpivot([], kinds, "type", "findings")


def privacy_check(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Findings of values, then of names: (index, type, field)."""
    values = sensitive_values(df, columns, order).withColumn("field", F.lit(None).cast("string"))
    names = sensitive(columns)
    if not names:
        return values
    rows = df.sparkSession.createDataFrame([(None, "sensitive_field", n) for n in names], "index long, type string, field string")
    return values.unionByName(rows)


def text_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many URLs and e-mail addresses the serialised records hold."""
    json = record_json(columns)
    n = lambda p: F.coalesce(F.sum(F.regexp_count(json, F.lit(p))), F.lit(0)).cast("long")
    return df.agg(n(URL).alias("urls"), n(EMAIL).alias("emails"))


def privacy_status(findings: Column) -> Column:
    return F.when(findings == 0, "no-obvious-findings").otherwise("review-required")
