"""Field profiles, structures and type consistency of typed records and of JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import is_blank, percent

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def tag(kind: T.DataType) -> str:
    """The JSON type of a column."""
    if isinstance(kind, _NUMBERS):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType):
        return "array"
    return "object" if isinstance(kind, (T.StructType, T.MapType, T.VariantType)) else "string"


def field_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, type, present, empty, nulls, non_empty, completeness) of every column, from one aggregation."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        parts += [F.count_if(is_blank(F.col(c), kinds[c])).alias(f"_e{i}"), F.count_if(F.col(c).isNull()).alias(f"_m{i}")]
    rows = [F.struct(F.lit(c).alias("field"), F.lit(tag(kinds[c])).alias("type"), F.col("_n").alias("present"), F.col(f"_e{i}").alias("empty"), F.col(f"_m{i}").alias("nulls")) for i, c in enumerate(columns)]
    out = df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("non_empty", F.col("present") - F.col("empty")).withColumn("completeness", percent(F.col("present"), F.col("present")))


def field_examples(df: DataFrame, column: str, order: str, most: int = 3, cut: int = 100) -> DataFrame:
    """The first non-empty values of a column: a feature with a limit."""
    kind = df.schema[column].dataType
    rows = df.where(~is_blank(F.col(column), kind)).orderBy(order).limit(most)
    return rows.select(F.substring(F.col(column).cast("string"), 1, cut).alias("example"))


def type_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, types, mixed): the JSON types of each column's values; null is a type of its own."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = [F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *parts)
    rows = []
    for i, c in enumerate(columns):
        types = F.concat_ws(",", F.when(F.col(f"_m{i}") > 0, "null"), F.when(F.col(f"_m{i}") < F.col("_n"), tag(kinds[c])))
        rows.append(F.struct(F.lit(c).alias("field"), types.alias("types")))
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("mixed", F.contains("types", F.lit(",")))


def json_fields(df: DataFrame, json: str) -> DataFrame:
    """(field, type, records) of the top-level keys of JSON texts; texts that aren't objects have none."""
    value = F.try_parse_json(F.col(json))
    rows = df.select(value.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    name = (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )
    return rows.groupBy(F.col("key").alias("field"), name.alias("type")).agg(F.count(F.lit(1)).alias("records"))


def json_structures(df: DataFrame, json: str, order: str) -> DataFrame:
    """(signature, records, first_row): groups of JSON records with the same keys, largest first."""
    v = F.try_parse_json(F.col(json))
    kind = F.schema_of_variant(v)
    keys = F.array_join(F.array_sort(F.json_object_keys(F.col(json))), "|")
    name = F.when(kind.startswith("OBJECT"), F.concat(F.lit("object:"), keys)).when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").otherwise("primitive")
    return df.groupBy(name.alias("signature")).agg(F.count(F.lit(1)).alias("records"), F.min(order).alias("first_row"))
