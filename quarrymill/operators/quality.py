"""Quality scores, readiness and recommendations under the two rule profiles, each from one pass and one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.names import SENSITIVE_NAMES, sensitive
from quarrymill.functions.ordering import placed
from quarrymill.functions.text import every, fingerprint, is_blank, percent, round_half_up, trimmed
from quarrymill.operators.privacy import privacy_status, with_hits

#: Overall quality from which a data set is ready, and the lower limits of the grades.
READY, GRADES = 70, ((90, "excellent"), (80, "good"), (70, "review"))


def status(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def validate(df: DataFrame, columns: list[str], group: list[str] | None = None, profile: str = "library") -> DataFrame:
    """Scores of the records in ``columns``, one row (or one for each ``group``).

    Each record becomes a digest and a few flags; records are summed by digest, digests by group. Counts of equal
    records are so taken before the second sum, and a hot group is spread over its digests.
    """
    keys = list(group or [])
    kinds = {f.name: f.dataType for f in df.schema}
    blank = [is_blank(F.col(c), kinds[c]) for c in columns]
    filled = sum((F.when(~b, 1).otherwise(0) for b in blank), F.lit(0))
    nulls = [F.max(F.col(c).isNull().cast("int")).alias(f"_null{i}") for i, c in enumerate(columns)]
    some = [F.max(F.col(c).isNotNull().cast("int")).alias(f"_some{i}") for i, c in enumerate(columns)]
    rows = with_hits(df.select(*keys, *[c for c in columns if c not in keys]), columns, profile)
    rows = rows.select(
        *keys, *[c for c in columns if c not in keys],
        fingerprint(columns).alias("_fp"), filled.alias("_filled"), every(blank).alias("_blank"), F.bit_count("_hits").alias("_hits"),
    )
    each = rows.groupBy(*keys, "_fp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_filled").alias("filled"), F.sum("_hits").alias("hits"),
        F.count_if("_blank").alias("blank"), *nulls, *some,
    )
    mixed = sum((F.max(f"_null{i}") * F.max(f"_some{i}") for i in range(len(columns))), F.lit(0))
    total = each.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("distinct_records"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"), F.coalesce(F.sum("blank"), F.lit(0)).alias("empty_records"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("value_findings"), F.coalesce(mixed, F.lit(0)).alias("mixed_fields"),
    )
    n, width = F.col("records"), len(columns)
    any_row = n > 0
    score = lambda c: F.when(any_row, c).otherwise(F.lit(0)).cast("long")
    out = total.withColumn("duplicates", n - F.col("distinct_records")).withColumn("completeness", percent(F.col("filled"), n * width)).withColumn("uniqueness", percent(F.col("distinct_records"), n))
    if profile == "service":
        out = out.withColumn("format", score(F.lit(100))).withColumn("validity", percent(n - F.col("empty_records"), n))
        mean = F.col("completeness") * 0.25 + F.col("uniqueness") * 0.25 + F.col("format") * 0.25 + F.col("validity") * 0.25
        return out.select(*keys, "records", "duplicates", "completeness", "uniqueness", "format", "validity", score(round_half_up(mean)).alias("quality"), F.col("value_findings").alias("findings"))
    findings = F.col("value_findings") + len(sensitive(columns))
    out = (
        out.withColumn("validity", score(F.lit(100)))  # typed records are objects with fields: none is invalid
        .withColumn("format", score(F.greatest(F.lit(0), 100 - F.least(F.lit(30), 3 * F.col("mixed_fields")))))
        .withColumn("findings", findings.cast("long"))
        .withColumn("privacy", F.greatest(F.lit(0), 100 - F.least(F.lit(100), 10 * F.col("findings"))).cast("long"))
    )
    overall = F.col("completeness") * 0.25 + F.col("uniqueness") * 0.2 + F.col("validity") * 0.2 + F.col("format") * 0.2 + F.col("privacy") * 0.15
    out = out.withColumn("overall", round_half_up(overall)).withColumn("status", status(F.col("overall")))
    return out.select(
        *keys, "records", "duplicates", "empty_records", "mixed_fields", "findings", "completeness", "uniqueness",
        "validity", "format", "privacy", "overall", "status",
    )


def _json_kind(of: Column) -> Column:
    """The JSON type of a variant; null if it is none."""
    kind = F.schema_of_variant(of)
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")
    )


def validity(df: DataFrame, json: str, order: str) -> DataFrame:
    """(index, reason) of JSON records that are nothing: null or no JSON, blank strings, objects without fields."""
    rows = df.select(F.col(order).alias("index"), F.try_parse_json(json).alias("_v"))
    return rows.select("index", _invalid(F.col("_v")).alias("reason")).where("reason is not null")


def _invalid(v: Column) -> Column:
    kind = _json_kind(v)
    empty = trimmed(F.try_variant_get(v, "$", "string")) == ""
    return F.when(v.isNull() | (kind == "null"), "null_or_undefined").when((kind == "string") & empty, "empty_string").when((kind == "object") & (F.to_json(v) == "{}"), "empty_object")


def validate_json(df: DataFrame, json: str, group: list[str] | None = None) -> DataFrame:
    """Scores of JSON records of any structure, one row (or one for each ``group``).

    As ``validate``, with what only untyped records have: fields are all that any record has; those with values of several
    types, several structures, and plain values among objects lower the format; records that are nothing the validity.
    Texts that aren't JSON count as null.
    """
    keys = list(group or [])
    rows = df.select(*keys, F.col(json).alias("_text"), F.try_parse_json(json).alias("_v"))
    kind = _json_kind(F.col("_v"))
    names = F.array_join(F.array_sort(F.json_object_keys(F.to_json("_v"))), "|")
    rows = rows.withColumn("_kind", F.coalesce(kind, F.lit("null"))).withColumn("_fp", F.sha2(F.coalesce(F.to_json("_v"), F.lit("null")), 256))
    rows = rows.withColumn("_form", F.when(F.col("_kind") == "object", F.concat(F.lit("object:"), names)).otherwise(F.col("_kind"))).withColumn("_bad", _invalid(F.col("_v")).isNotNull())
    rows = with_hits(rows, [], "library", json=F.coalesce("_text", F.lit("")))
    each = rows.groupBy(*keys, "_fp", "_form", "_kind", "_bad").agg(F.count(F.lit(1)).alias("n"), F.sum(F.bit_count("_hits")).alias("hits"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    total = each.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"), F.count(F.lit(1)).alias("distinct_records"), count(F.col("_bad")).alias("invalid"),
        count(F.col("_kind") == "object").alias("objects"), count(F.col("_kind").isin("string", "number", "boolean")).alias("primitives"),
        F.count_distinct("_form").alias("structures"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("value_findings"),
    )
    inner = rows.where("_kind = 'object'").select(*keys, "_v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    of = _json_kind(F.col("value"))
    blank = (of == "null") | ((of == "string") & (trimmed(F.try_variant_get("value", "$", "string")) == "")) | ((of == "array") & (F.to_json("value") == "[]"))
    fields = inner.groupBy(*keys, "key", of.alias("_of")).agg(F.count_if(~blank).alias("filled"), F.count(F.lit(1)).alias("present"))
    fields = fields.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("types"), F.sum("filled").alias("filled"), F.sum("present").alias("present"))
    fields = fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("types") > 1).alias("mixed_fields"), F.sum("filled").alias("filled"), F.sum("present").alias("present"),
        F.count_if(F.regexp_replace(F.lower(F.trim("key")), r"\s+", "_").isin(*SENSITIVE_NAMES)).alias("name_findings"),
    )
    if keys:
        fields = fields.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in fields.columns if c not in keys])
        out = total.join(fields, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    else:
        out = total.crossJoin(F.broadcast(fields))  # one row each
    n, zero = F.col("records"), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    score = lambda c: F.when(n > 0, c).otherwise(F.lit(0)).cast("long")
    form = 100 - F.when(F.col("structures") > 1, 15).otherwise(0) - F.least(F.lit(30), 3 * zero("mixed_fields")) - F.when((F.col("primitives") > 0) & (F.col("objects") > 0), 10).otherwise(0)
    out = (
        out.withColumn("completeness", percent(zero("filled"), n * zero("fields"))).withColumn("presence", percent(zero("present"), n * zero("fields")))
        .withColumn("uniqueness", percent(F.col("distinct_records"), n)).withColumn("validity", percent(n - F.col("invalid"), n))
        .withColumn("format", score(F.greatest(F.lit(0), form))).withColumn("findings", F.col("value_findings") + zero("name_findings"))
        .withColumn("privacy", F.greatest(F.lit(0), 100 - F.least(F.lit(100), 10 * F.col("findings"))).cast("long"))
    )
    overall = F.col("completeness") * 0.25 + F.col("uniqueness") * 0.2 + F.col("validity") * 0.2 + F.col("format") * 0.2 + F.col("privacy") * 0.15
    out = out.withColumn("overall", round_half_up(overall)).withColumn("status", status(F.col("overall")))
    return out.select(
        *keys, "records", (n - F.col("distinct_records")).alias("duplicates"), "invalid", zero("fields").alias("fields"), "structures", zero("mixed_fields").alias("mixed_fields"),
        "findings", "completeness", "presence", "uniqueness", "validity", "format", "privacy", "overall", "status",
    )


def strict_validate(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """The report with its mode; scores don't depend on it."""
    return validate(df, columns, group).withColumn("mode", F.lit("strict"))


def preview(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: scores, privacy status and recommendations of a data set before it is processed."""
    return recommendations(validate(df, columns)).withColumn("privacy_status", privacy_status(F.col("findings")))


def readiness(report: DataFrame) -> DataFrame:
    """Adds ``ready`` and the codes of what keeps each report's data set from training, joined by commas."""
    reasons = F.concat_ws(
        ",",
        F.when(F.col("records") == 0, "NO_RECORDS"),
        F.when(F.col("overall") < READY, "LOW_QUALITY"),
        F.when(F.col("findings") > 0, "SENSITIVE_DATA"),
        F.when(F.col("validity") < 100, "INVALID_RECORDS"),
    )
    return report.withColumn("reasons", reasons).withColumn("ready", F.col("reasons") == "")


# Codes of the recommendations in order, and what they say.
ADVICE = {
    "NO_RECORDS": "Add records before preparing a data set.",
    "DUPLICATES": "There are equal records; remove them.",
    "EMPTY_VALUES": "There are empty records or values.",
    "MIXED_TYPES": "Some fields hold values of several types; look at them before training.",
    "SENSITIVE_DATA": "Look at sensitive values before sharing the data.",
    "LOW_COMPLETENESS": "Many fields are empty.",
    "LOW_UNIQUENESS": "Many records are equal.",
    "LOW_VALIDITY": "Some records need another look.",
    "LOW_FORMAT": "Records don't have one form.",
    "NONE": "The rules found nothing; a person may still.",
}


def recommendations(report: DataFrame) -> DataFrame:
    """Adds ``recommendations``: codes of ``ADVICE``, joined by commas."""
    found = F.concat_ws(
        ",",
        F.when(F.col("records") == 0, "NO_RECORDS"),
        F.when(F.col("duplicates") > 0, "DUPLICATES"),
        F.when((F.col("empty_records") > 0) | (F.col("completeness") < 100), "EMPTY_VALUES"),
        F.when(F.col("mixed_fields") > 0, "MIXED_TYPES"),
        F.when(F.col("findings") > 0, "SENSITIVE_DATA"),
        F.when(F.col("completeness") < 80, "LOW_COMPLETENESS"),
        F.when(F.col("uniqueness") < 90, "LOW_UNIQUENESS"),
        F.when(F.col("validity") < 90, "LOW_VALIDITY"),
        F.when(F.col("format") < 90, "LOW_FORMAT"),
    )
    return report.withColumn("recommendations", F.when(found == "", "NONE").otherwise(found))


def value_findings(df: DataFrame, columns: list[str], order: str, most: int | None = None) -> DataFrame:
    """(index, type, field): empty records, empty values and numbers that aren't finite.

    With ``most``, findings stop after the record that reaches so many, in the order of ``order``. Records with findings
    are placed in ranges of the order (ties by their findings), and as each has one finding at least, only the
    first ``most`` of them, a number that doesn't grow with the data, are counted up in one place.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    types = {f.name: f.dataType for f in df.schema}
    blank = {c: is_blank(F.col(c), types[c]) for c in columns}
    entry = lambda kind, field: F.struct(F.lit(kind).alias("type"), F.lit(field).cast("string").alias("field"))
    found = [F.when(every(list(blank.values())), entry("empty_record", None))]
    for c in columns:
        found.append(F.when(blank[c], entry("empty_value", c)))
        if kinds[c] in ("float", "double"):
            found.append(F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), entry("invalid_number", c)))
    rows = df.select(F.col(order).alias("index"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    if most is not None:
        first = placed(rows.where(F.size("found") > 0), [F.col("index")], "_n").where(F.col("_n") <= most)
        before = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        rows = first.withColumn("_before", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0))).where(F.col("_before") < most)
    return rows.select("index", F.explode("found").alias("f")).select("index", "f.type", "f.field")


def compare_quality(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row of both reports' scores and their differences."""
    scores = ["records", "completeness", "uniqueness", "validity", "format", "privacy", "overall"]
    a = validate(before, columns).select(*[F.col(s).alias(f"before_{s}") for s in scores])
    b = validate(after, columns).select(*[F.col(s).alias(f"after_{s}") for s in scores])
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.select("*", *[(F.col(f"after_{s}") - F.col(f"before_{s}")).alias(f"delta_{s}") for s in scores])


def quick_validate(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: duplicates, records without any value, and sensitive values, the names not looked at."""
    one = validate(df, columns)
    return one.select("duplicates", F.col("empty_records").alias("invalid"), (F.col("findings") - len(sensitive(columns))).alias("sensitive"))


def summary(report: DataFrame) -> DataFrame:
    """The figures of a report that a list of data sets shows."""
    return readiness(report).select("records", "overall", "status", "duplicates", "findings", "ready")
