"""Queries of files, collected sources and records of mixed types, each with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrymill.functions.scratch import own_dir
from quarrymill.operators import mixed
from quarrymill.operators.clean import CleanOptions
from quarrymill.plans.queries import query
from quarrymill.sources import collect, lines
from quarrymill.sources.readers import Source

#: Files that the test tables are written to, one task each.
FILES = 16


def _written(df, name: str) -> str:
    """Write ``df`` (value, _file) as text files, one a value of ``_file``, and return their folder."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.repartition("_file").write.partitionBy("_file").text(path)
    return path


@query(rf"""SELECT CAST(doc_id % {FILES} AS INTEGER) AS file, count(*) AS lines, count(*) AS last, count(*) * (count(*) + 1) // 2 AS sum_of_numbers, CAST(sum(length(line)) AS BIGINT) AS characters
FROM (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents)
WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1""")
def file_line_numbers(t):
    docs = t("documents").where("text is not null").select(F.col("text").alias("value"), (F.col("doc_id") % FILES).cast("int").alias("_file"))
    rows = lines.file_lines(docs.sparkSession, [f"{_written(docs, 'texts')}/*"])
    file = F.regexp_extract("_path", r"_file=(\d+)", 1).cast("int").alias("file")
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("lines"), F.max("id").alias("last"), F.sum("id").alias("sum_of_numbers"), F.sum(F.length("line")).alias("characters"))


@query(f"""SELECT CAST(user_id % {FILES} AS INTEGER) AS file, CASE WHEN count_if(event_id % 997 = 3) > 0 THEN 0 ELSE count(*) END AS records, CASE WHEN count_if(event_id % 997 = 3) > 0 THEN 'INVALID_JSONL' END AS problem,
 CASE WHEN count_if(event_id % 997 = 3) > 0 THEN 0 ELSE count(DISTINCT props) END AS kinds FROM events GROUP BY 1""")
def collected_files(t):
    value = F.when(F.col("event_id") % 997 == 3, "{bad").otherwise(F.col("props"))
    events = t("events").select(value.alias("value"), (F.col("user_id") % FILES).cast("int").alias("_file"))
    spark, folder = events.sparkSession, _written(events.withColumn("value", F.concat("value", F.lit(" "))), "lines")
    listed = [p for p, _ in collect.listed(spark, f"{folder}/*")]
    records, outcomes = collect.collected(spark, [Source("file", listed, options={"as": "jsonl"})])
    file = F.regexp_extract("_path", r"_file=(\d+)", 1).cast("int").alias("file")
    each = spark.createDataFrame([(o.path, o.records, (o.error or {}).get("code")) for o in outcomes], "_path string, records long, problem string")  # one row a file
    kinds = records.groupBy(file).agg(F.count_distinct("record").alias("kinds"))
    return each.select(file, "records", "problem").join(kinds, "file", "left").na.fill(0, ["kinds"])


_MIXED = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"note": "' || event_type || '", "k": "' || user_id || '"}' WHEN 2 THEN '{"k": null, "note": " "}'
 WHEN 3 THEN '{"list": [], "flag": true, "deep": {"a": [" 1,0 ", "n"]}}' WHEN 4 THEN '["x"]' ELSE '{bad' END"""
_MIXED_SPARK = _MIXED.replace("\n", " ")
_FIELDS = """SELECT event_id, 'k' AS field, 0 AS pos, 'number' AS kind, FALSE AS empty, regexp_extract(props, '[0-9]+') AS text FROM events WHERE event_id % 6 = 0
 UNION ALL SELECT event_id, 'note', 0, 'string', FALSE, event_type FROM events WHERE event_id % 6 = 1
 UNION ALL SELECT event_id, 'k', 1, 'string', FALSE, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 6 = 1
 UNION ALL SELECT event_id, 'k', 0, 'null', TRUE, NULL FROM events WHERE event_id % 6 = 2
 UNION ALL SELECT event_id, 'note', 1, 'string', TRUE, NULL FROM events WHERE event_id % 6 = 2
 UNION ALL SELECT event_id, 'list', 0, 'array', TRUE, NULL FROM events WHERE event_id % 6 = 3
 UNION ALL SELECT event_id, 'flag', 1, 'boolean', FALSE, 'true' FROM events WHERE event_id % 6 = 3
 UNION ALL SELECT event_id, 'deep', 2, 'object', FALSE, '{"a":[" 1,0 ","n"]}' FROM events WHERE event_id % 6 = 3"""


@query(f"""WITH f AS ({_FIELDS}), r AS (SELECT field, text, row_number() OVER (PARTITION BY field ORDER BY event_id, pos) AS n FROM f WHERE NOT empty)
SELECT f.field, count(*) AS present, (SELECT count(*) FROM events) - count(*) AS missing, count_if(empty) AS empty, count_if(NOT empty) AS non_empty,
 CAST(floor(100.0 * count(*) / (SELECT count(*) FROM events) + 0.5) AS BIGINT) AS completeness, min(event_id) AS first_row, CAST(arg_min(pos, event_id * 10 + pos) AS BIGINT) AS first_pos,
 {", ".join(f"count_if(kind = '{k}') AS n_{k}" for k in mixed.KINDS)}, coalesce(any_value(e), '') AS examples
FROM f LEFT JOIN (SELECT field, string_agg(text, '|' ORDER BY n) AS e FROM r WHERE n <= 3 GROUP BY field) x ON x.field = f.field GROUP BY f.field""")
def mixed_field_profile(t):
    rows = t("events").select("event_id", F.expr(_MIXED_SPARK).alias("json"))
    return mixed.json_profile(rows, "json", "event_id").withColumn("examples", F.array_join("examples", "|"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN '{"note":"' || event_type || '","k":' || user_id || '}' WHEN 3 THEN '{"list":[],"flag":true,"deep":{"a":[10,"n"]}}'
 WHEN 4 THEN '{"value":["x"]}' END AS record, CASE WHEN event_id % 6 = 5 THEN 'INVALID_JSON' END AS problem FROM events WHERE event_id % 6 <> 2""")
def mixed_records(t):
    rows = t("events").select("event_id", F.expr(_MIXED_SPARK).alias("json"))
    return mixed.clean_json(rows, "json", CleanOptions()).select("event_id", F.col("_record").alias("record"), F.col("_problem").alias("problem"))
