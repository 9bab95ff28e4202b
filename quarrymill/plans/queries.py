"""The library's queries over the test tables, each with the DuckDB SQL that its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import guards, text
from quarrymill.operators import clean, dedup, privacy, profile, quality, training
from quarrymill.plans import catalog, pipeline
from quarrymill.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader) under its name, with its SQL."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


RECORD = ["text", "lang"]
# Patterns with the other engine's word edges, for its SQL only.
_RULES = {p: {k: r.replace(text.EDGE, r"\b") for k, r in rules.items()} for p, rules in privacy.PATTERNS.items()}
_EMAIL = _RULES["library"]["email"]
_JSON = "('{\"text\":' || CAST(to_json(text) AS VARCHAR) || ',\"lang\":' || CAST(to_json(lang) AS VARCHAR) || '}')"
_SORTED = "('{\"lang\":' || CAST(to_json(lang) AS VARCHAR) || ',\"text\":' || CAST(to_json(text) AS VARCHAR) || '}')"


def _hits(profile: str) -> str:
    return " + ".join(f"CAST(regexp_matches(j, '{p}') AS BIGINT)" for p in _RULES[profile].values())


def _scores(by: str = "", profile: str = "library", source: str = "documents", key: str = "") -> str:
    """SQL of the scores of {text, lang} records, one row or one a group."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    first = key or (f"{by}, " if by else "")
    base = f"""
WITH d AS (SELECT {first}text, lang, {_JSON} AS j FROM {source}),
f AS (SELECT {lead}text, lang, {_hits(profile)} AS h, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE 1 END + CASE WHEN trim(coalesce(lang, '')) = '' THEN 0 ELSE 1 END AS filled FROM d),
a AS (SELECT {lead}count(*) AS n, count(DISTINCT text || chr(1) || lang) AS u, sum(filled) AS filled, sum(CASE WHEN filled = 0 THEN 1 ELSE 0 END) AS blank, sum(h) AS h,
 CASE WHEN count(text) BETWEEN 1 AND count(*) - 1 THEN 1 ELSE 0 END + CASE WHEN count(lang) BETWEEN 1 AND count(*) - 1 THEN 1 ELSE 0 END AS mixed FROM f {group}),
s AS (SELECT *, CAST(floor(100.0 * filled / (n * 2) + 0.5) AS BIGINT) AS c, CAST(floor(100.0 * u / n + 0.5) AS BIGINT) AS q, greatest(0, 100 - least(30, 3 * mixed)) AS fm, greatest(0, 100 - least(100, 10 * h)) AS pr FROM a)
"""
    if profile == "service":
        return base + f"""SELECT {lead}CAST(n AS BIGINT) AS records, CAST(n - u AS BIGINT) AS duplicates, c AS completeness, q AS uniqueness, CAST(100 AS BIGINT) AS format,
 CAST(floor(100.0 * (n - blank) / n + 0.5) AS BIGINT) AS validity, CAST(floor(c * 0.25 + q * 0.25 + 25 + floor(100.0 * (n - blank) / n + 0.5) * 0.25 + 0.5) AS BIGINT) AS quality, CAST(h AS BIGINT) AS findings FROM s"""
    return base + f""", o AS (SELECT *, CAST(floor(c * CAST(0.25 AS DOUBLE) + q * CAST(0.2 AS DOUBLE) + 100 * CAST(0.2 AS DOUBLE) + fm * CAST(0.2 AS DOUBLE) + pr * CAST(0.15 AS DOUBLE) + 0.5) AS BIGINT) AS overall FROM s)
SELECT {lead}CAST(n AS BIGINT) AS records, CAST(n - u AS BIGINT) AS duplicates, CAST(blank AS BIGINT) AS empty_records, CAST(mixed AS BIGINT) AS mixed_fields, CAST(h AS BIGINT) AS findings,
 c AS completeness, q AS uniqueness, CAST(100 AS BIGINT) AS validity, CAST(fm AS BIGINT) AS format, CAST(pr AS BIGINT) AS privacy, overall,
 CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 80 THEN 'good' WHEN overall >= 70 THEN 'review' ELSE 'low' END AS status FROM o"""


def _report(df: DataFrame) -> DataFrame:
    return df.withColumn("mixed_fields", F.col("mixed_fields").cast("long"))


@query(_scores())
def quality_library(t):
    return _report(quality.validate(t("documents"), RECORD))


@query(_scores("source"))
def quality_by_source(t):
    return _report(quality.validate(t("documents"), RECORD, ["source"]))


@query(_scores(profile="service"))
def quality_service(t):
    return quality.validate(t("documents"), RECORD, None, "service")


@query(f"""WITH r AS ({_scores("source")})
SELECT source, overall, concat_ws(',', CASE WHEN overall < 70 THEN 'LOW_QUALITY' END, CASE WHEN findings > 0 THEN 'SENSITIVE_DATA' END) AS reasons,
 (overall >= 70 AND findings = 0) AS ready FROM r""")
def readiness_by_source(t):
    return quality.readiness(quality.validate(t("documents"), RECORD, ["source"])).select("source", "overall", "reasons", "ready")


@query(f"""WITH r AS ({_scores("source")}), c AS (SELECT source, concat_ws(',', CASE WHEN duplicates > 0 THEN 'DUPLICATES' END, CASE WHEN empty_records > 0 OR completeness < 100 THEN 'EMPTY_VALUES' END,
 CASE WHEN mixed_fields > 0 THEN 'MIXED_TYPES' END, CASE WHEN findings > 0 THEN 'SENSITIVE_DATA' END, CASE WHEN completeness < 80 THEN 'LOW_COMPLETENESS' END, CASE WHEN uniqueness < 90 THEN 'LOW_UNIQUENESS' END,
 CASE WHEN format < 90 THEN 'LOW_FORMAT' END) AS r FROM r) SELECT source, CASE WHEN r = '' THEN 'NONE' ELSE r END AS recommendations FROM c""")
def recommendations_by_source(t):
    return quality.recommendations(quality.validate(t("documents"), RECORD, ["source"])).select("source", "recommendations")


@query("SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(t):
    return dedup.deduplicate(t("documents"), RECORD, "doc_id").select("doc_id", "text", "lang")


@query(f"""SELECT * FROM (SELECT doc_id AS index, min(doc_id) OVER (PARTITION BY text, lang) AS duplicate_of, sha256({_SORTED}) AS fingerprint FROM documents) WHERE duplicate_of < index""")
def duplicate_findings(t):
    return dedup.duplicates(t("documents"), RECORD, "doc_id")


@query(f"SELECT doc_id, sha256({_SORTED}) AS fingerprint FROM documents")
def fingerprint_sha256(t):
    return t("documents").select("doc_id", text.fingerprint(RECORD).alias("fingerprint"))


@query(r"""WITH b AS (SELECT text, lang FROM documents), a AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, lang FROM documents)
SELECT (SELECT count(*) FROM b) AS before_records, (SELECT count(*) FROM a) AS after_records,
 (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS removed, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS added""")
def compare_datasets(t):
    d = t("documents")
    return dedup.compare(d, d.withColumn("text", text.normalize_whitespace(F.col("text"))), RECORD)


@query("""SELECT 'documents' AS source, doc_id AS id, text FROM documents
UNION ALL SELECT 'conversations', conv_id, text FROM conversations""")
def merge_sources(t):
    both = dedup.merge([("documents", t("documents").select("doc_id", "text")), ("conversations", t("conversations").select("conv_id", "text"))])
    return both.select(F.col("_src").alias("source"), F.coalesce("doc_id", "conv_id").alias("id"), "text")


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY src, conv_id, turn) AS rn FROM (
 SELECT 0 AS src, conv_id, turn, role, text FROM conversations WHERE role = 'user' UNION ALL SELECT 1, conv_id, turn, role, text FROM conversations WHERE turn < 3)) WHERE rn = 1""")
def combine_sources(t):
    c = t("conversations").withColumn("_at_row", F.struct("conv_id", "turn"))
    out = dedup.combine([("a", c.where("role = 'user'")), ("b", c.where("turn < 3"))], ["role", "text"], "_at_row")
    return out.select("conv_id", "turn", "text")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(t):
    return t("documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents")
def clean_string(t):
    return t("documents").select("doc_id", text.clean_string(F.col("text")).alias("text"))


_RAW = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ' n/a ' WHEN c_custkey % 5 = 0 THEN ' ' || CAST(c_custkey AS VARCHAR) || ',5 ' WHEN c_custkey % 3 = 0 THEN 'Yes' WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END"


def _raw(t) -> DataFrame:
    value = F.expr(_RAW.replace("AS VARCHAR", "AS STRING"))
    return t("customer").select("c_custkey", value.alias("v"), "c_mktsegment")


_RAW_SQL = f"(SELECT c_custkey, {_RAW} AS v, c_mktsegment FROM customer)"


@query(rf"SELECT c_custkey, CASE WHEN regexp_full_match(replace(trim(v), ',', ''), '[-+]?\d+(\.\d+)?') THEN CAST(replace(trim(v), ',', '') AS DOUBLE) END AS number FROM {_RAW_SQL}")
def normalize_number(t):
    return _raw(t).select("c_custkey", text.as_number(F.col("v")).alias("number"))


@query(f"SELECT c_custkey, CASE WHEN lower(trim(v)) IN ('true','yes','1','on') THEN 'true' WHEN lower(trim(v)) IN ('false','no','0','off') THEN 'false' END AS flag FROM {_RAW_SQL}")
def normalize_boolean(t):
    return _raw(t).select("c_custkey", text.as_boolean(F.col("v")).cast("string").alias("flag"))


_TOKENS = "('', 'null', 'undefined', 'n/a', 'na', 'none', 'nil', '-')"


@query(f"SELECT c_custkey, (v IS NULL OR lower(trim(v)) IN {_TOKENS}) AS is_empty FROM {_RAW_SQL}")
def empty_tokens(t):
    return _raw(t).select("c_custkey", text.is_empty_token(F.col("v")).alias("is_empty"))


@query(f"SELECT c_custkey, v FROM {_RAW_SQL} WHERE NOT (v IS NULL OR lower(trim(v)) IN {_TOKENS})")
def drop_empty_records(t):
    raw = _raw(t)
    return raw.where(~clean.is_empty_record(raw, ["v"])).select("c_custkey", "v")


@query(f"SELECT c_custkey, nullif(CASE WHEN trim(v) = '' THEN '' ELSE v END, '') AS v FROM {_RAW_SQL}")
def remove_empty_fields(t):
    return clean.remove_empty_fields(_raw(t).select("c_custkey", "v"), ["v"])


_CLEANED = f"(SELECT c_custkey, CASE WHEN v IS NULL OR lower(trim(v)) IN {_TOKENS} THEN '' ELSE trim(v) END AS v, c_mktsegment FROM {_RAW_SQL})"


@query(f"SELECT min(c_custkey) AS row_id, v, c_mktsegment FROM {_CLEANED} GROUP BY v, c_mktsegment")
def clean_dataset(t):
    out, _ = clean.clean_dataset(_raw(t), ["v", "c_mktsegment"], "c_custkey")
    return out.withColumnRenamed("_row", "row_id")


@query(f"""WITH c AS (SELECT r.v AS old, k.v AS new, k.c_mktsegment FROM {_RAW_SQL} r JOIN {_CLEANED} k USING (c_custkey)), n AS (SELECT count(*) AS b, count(DISTINCT new || chr(1) || c_mktsegment) AS a, sum(CASE WHEN old IS DISTINCT FROM new THEN 1 ELSE 0 END) AS ch FROM c)
SELECT b AS before, a AS after, CAST(0 AS BIGINT) AS removed_empty, b - a AS removed_duplicates, CAST(ch AS BIGINT) AS changed_records, CAST(floor(100.0 * a / b + 0.5) AS BIGINT) AS retention_rate, CAST(floor(100.0 * ch / b + 0.5) AS BIGINT) AS change_rate FROM n""")
def clean_statistics(t):
    _, figures = clean.clean_dataset(_raw(t), ["v", "c_mktsegment"], "c_custkey")
    return figures.withColumn("removed_empty", F.col("removed_empty").cast("long"))


@query(f"""SELECT 'v' AS field, 'string' AS type, count(*) AS present, sum(CASE WHEN v IS NULL OR trim(v) = '' THEN 1 ELSE 0 END)::BIGINT AS empty, (count(*) - count(v)) AS nulls, (count(*) - sum(CASE WHEN v IS NULL OR trim(v) = '' THEN 1 ELSE 0 END))::BIGINT AS non_empty, CAST(100 AS BIGINT) AS completeness FROM {_RAW_SQL}
UNION ALL SELECT 'c_custkey', 'number', count(*), 0, 0, count(*), 100 FROM customer""")
def field_profile(t):
    return profile.field_profile(_raw(t), ["v", "c_custkey"])


@query(f"SELECT 'v' AS field, 'null,string' AS types, true AS mixed FROM (SELECT count(*) AS n, count(v) AS k FROM {_RAW_SQL}) WHERE k < n UNION ALL SELECT 'c_custkey', 'number', false")
def type_consistency(t):
    return profile.type_consistency(_raw(t), ["v", "c_custkey"])


@query(f"""SELECT c_custkey AS index, 'empty_record' AS type, CAST(NULL AS VARCHAR) AS field FROM {_RAW_SQL} WHERE v IS NULL OR trim(v) = ''
UNION ALL SELECT c_custkey, 'empty_value', 'v' FROM {_RAW_SQL} WHERE v IS NULL OR trim(v) = ''""")
def value_findings(t):
    return quality.value_findings(_raw(t), ["v"], "c_custkey")


@query(f"""WITH f AS (SELECT c_custkey, v, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM {_RAW_SQL} WHERE v IS NULL OR trim(v) = '')
SELECT -c_custkey AS index, 'empty_record' AS type, CAST(NULL AS VARCHAR) AS field FROM f WHERE 2 * (n - 1) < 25 UNION ALL SELECT -c_custkey, 'empty_value', 'v' FROM f WHERE 2 * (n - 1) < 25""")
def first_findings(t):
    back = _raw(t).withColumn("back", -F.col("c_custkey"))
    return quality.value_findings(back, ["v"], "back", most=25)


@query("""SELECT k AS field, CASE json_type(json_extract(props, '$.' || k)) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type, count(*) AS records
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def json_fields(t):
    return profile.json_fields(t("events"), "props")


@query("""SELECT 'object:' || array_to_string(list_sort(json_keys(props)), '|') AS signature, count(*) AS records, min(event_id) AS first_row FROM events GROUP BY 1""")
def json_structures(t):
    return profile.json_structures(t("events"), "props", "event_id")


def _found(profile_name: str, table: str, key: str, json: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS index, '{k}' AS type FROM (SELECT *, {json} AS j FROM {table}) WHERE regexp_matches(j, '{p}')" for k, p in _RULES[profile_name].items())


@query(_found("library", "documents", "doc_id", _JSON))
def sensitive_values(t):
    return privacy.sensitive_values(t("documents"), RECORD, "doc_id")


@query(_found("service", "documents", "doc_id", _JSON))
def service_sensitive(t):
    return privacy.sensitive_values(t("documents"), RECORD, "doc_id", "service")


@query(" UNION ALL ".join(f"SELECT '{k}' AS type, CAST(coalesce(sum(CAST(regexp_matches('{{\"text\":' || CAST(to_json(text) AS VARCHAR) || '}}', '{p}') AS BIGINT)), 0) AS BIGINT) AS findings FROM conversations" for k, p in _RULES["library"].items()))
def sensitive_counts(t):
    return privacy.sensitive_counts(t("conversations"), ["text"])


@query(rf"""SELECT CAST(sum(len(regexp_extract_all(j, '(?i)\bhttps?://[^\s<>"'']+'))) AS BIGINT) AS urls, CAST(sum(len(regexp_extract_all(j, '{_EMAIL}'))) AS BIGINT) AS emails FROM (SELECT {_JSON} AS j FROM documents)""")
def text_patterns(t):
    return privacy.text_patterns(t("documents"), RECORD)


def _strip(c: str) -> str:
    for name in ("script", "style", "noscript", "svg"):
        c = rf"regexp_replace({c}, '<{name}\b[^>]*>.*?</{name}>', ' ', 'gis')"
    c = rf"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    for entity, plain in readers.ENTITIES:
        c = f"""regexp_replace({c}, '{entity}', '{plain.replace("'", "''")}', 'gi')"""
    return c


@query(f"SELECT page_id, {_strip('html')} AS text FROM pages")
def strip_html(t):
    return t("pages").select("page_id", readers.strip_html(F.col("html")).alias("text"))


_TITLE = r"regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'is')"


@query(f"SELECT page_id, {_strip(_TITLE)} AS title FROM pages")
def html_title(t):
    return t("pages").select("page_id", readers.html_title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]') THEN 'INVALID_URL' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'UNSUPPORTED_PROTOCOL'
 WHEN regexp_matches(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '(^|\.)(localhost|local|internal)$') THEN 'BLOCKED_HOST' END AS problem FROM pages""")
def url_guard(t):
    return t("pages").select("page_id", guards.url_problem(F.col("url")).alias("problem"))


_IP = "CAST(event_id % 256 AS VARCHAR) || '.' || CAST((event_id // 7) % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.9'"


@query(f"""WITH i AS (SELECT event_id, event_id % 256 AS a, (event_id // 7) % 256 AS b, user_id % 256 AS c FROM events)
SELECT event_id, (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) AS private,
 (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) AS service_private FROM i""")
def private_addresses(t):
    part = lambda x: F.expr(x).cast("string")
    ip = F.concat_ws(".", part("event_id % 256"), part("(event_id div 7) % 256"), part("user_id % 256"), F.lit("9"))
    return t("events").select("event_id", guards.private_ipv4(ip).alias("private"), guards.private_ipv4(ip, "service").alias("service_private"))


@query("""SELECT 'events' AS t, event_id AS id, 'json' AS format FROM events UNION ALL SELECT 'pages', page_id, 'html' FROM pages
UNION ALL SELECT 'documents', doc_id, CASE WHEN starts_with(ltrim(text), '{') OR starts_with(ltrim(text), '[') THEN 'json' ELSE 'text' END FROM documents""")
def detect_format(t):
    pick = lambda df, name, key, kind, c: df.select(F.lit(name).alias("t"), F.col(key).alias("id"), guards.detect_format(F.lit(kind), F.col(c), F.lit("/x")).alias("format"))
    out = pick(t("events"), "events", "event_id", "application/octet-stream", "props")
    return out.union(pick(t("pages"), "pages", "page_id", "text/html; charset=utf-8", "html")).union(pick(t("documents"), "documents", "doc_id", "text/plain", "text"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def parse_json_records(t):
    rows = readers.json_records(t("events"), "props", ["event_id"]).where("problem is null")
    pairs = rows.select("event_id", F.explode(F.from_json("record", "map<string,string>")).alias("name", "value"))
    return pairs.select("event_id", "value", "name")


def _cell(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\n\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


@query(f"SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || {_cell('lang')} || ',' || {_cell('text')} AS value FROM documents")
def csv_lines(t):
    return t("documents").select("doc_id", text.csv_line(["doc_id", "lang", "text"]).alias("value"))


@query("SELECT '{\"doc_id\":' || doc_id || ',\"lang\":' || CAST(to_json(lang) AS VARCHAR) || ',\"text\":' || CAST(to_json(text) AS VARCHAR) || '}' AS value FROM documents")
def jsonl_lines(t):
    return sinks.lines(t("documents"), "jsonl", ["doc_id", "lang", "text"])


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS id, line AS text FROM (
 SELECT doc_id, i, regexp_replace(regexp_replace(parts[i], '^\s+', ''), '\s+$', '') AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE line <> ''""")
def text_lines(t):
    return readers.text_lines(t("documents"), "text", ["doc_id"], numbered=True)


@query(r"SELECT doc_id AS row_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents WHERE trim(text) <> ''")
def to_text(t):
    return training.transform(t("documents"), ["text", "lang"], "doc_id", "text").where("_usable").select(F.col("_row").alias("row_id"), "text")


@query(r"SELECT d.doc_id AS row_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text, CAST(quality AS VARCHAR) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE trim(text) <> ''")
def to_classification(t):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("category", F.col("quality").cast("string"))
    return training.transform(rows, ["text", "category"], "doc_id", "classification").where("_usable").select(F.col("_row").alias("row_id"), "text", "label")


_PAIRS = "(SELECT u.conv_id * 1000 + u.turn AS id, u.text AS question, a.text AS answer, u.role AS context FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def _pairs(t) -> DataFrame:
    c = t("conversations")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = u.join(a, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), "answer", F.col("role").alias("context"))


_T = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query(f"SELECT id AS row_id, {_T.format('question')} AS instruction, context AS input, {_T.format('answer')} AS output FROM {_PAIRS} WHERE trim(question) <> '' AND trim(answer) <> ''")
def to_instruction(t):
    out = training.transform(_pairs(t), ["question", "answer", "context"], "id", "instruction").where("_usable")
    return out.select(F.col("_row").alias("row_id"), "instruction", "input", "output")


@query(f"SELECT id AS row_id, {_T.format('question')} || chr(10) || chr(10) || 'Input:' || chr(10) || context || chr(10) || chr(10) || 'Output:' || chr(10) || {_T.format('answer')} AS prompt FROM {_PAIRS} WHERE trim(question) <> '' AND trim(answer) <> ''")
def instruction_prompt(t):
    out = training.transform(_pairs(t), ["question", "answer", "context"], "id", "instruction").where("_usable")
    return out.select(F.col("_row").alias("row_id"), training.prompt(F.col("instruction"), F.col("input"), F.col("output")).alias("prompt"))


@query(f"SELECT id AS row_id, {_T.format('question')} AS input, {_T.format('answer')} AS target FROM {_PAIRS} WHERE trim(question) <> '' AND trim(answer) <> ''")
def to_seq2seq(t):
    rows = _pairs(t).withColumnRenamed("question", "source")
    return training.transform(rows, ["source", "answer"], "id", "seq2seq").where("_usable").select(F.col("_row").alias("row_id"), "input", "target")


@query("SELECT doc_id AS row_id, lang, row_number() OVER (ORDER BY doc_id) AS row_index FROM documents")
def to_generic(t):
    out = training.transform(t("documents"), ["lang"], "doc_id", "generic").where("_usable")
    return out.select(F.col("_row").alias("row_id"), "lang", F.col("_row_index").alias("row_index"))


_CHAT = f"SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('assistant', 'bot', 'model') THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'user' END AS role, {_T.format('text')} AS content FROM conversations WHERE trim(text) <> ''"


@query(f"SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn, role, content) AS text FROM ({_CHAT}) GROUP BY conv_id")
def chat_to_text(t):
    chats = training.to_chat(t("conversations"), "conv_id", "turn", "role", "text")
    return chats.select("conv_id", training.chat_text(F.col("messages")).alias("text"))


@query(f"SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM ({_CHAT}) GROUP BY role")
def chat_role_stats(t):
    return training.chat_statistics(training.to_chat(t("conversations"), "conv_id", "turn", "role", "text"), "conv_id")


@query("SELECT CAST(quality AS VARCHAR) AS label, count(*) AS records, min(doc_id) AS first_row FROM labels GROUP BY 1")
def label_histogram(t):
    return training.label_histogram(t("labels"), "quality", "doc_id")


@query("WITH h AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT count(*) AS classes, min(n) AS least, max(n) AS most, round(CAST(min(n) AS DOUBLE) / max(n), 4) AS ratio, round(CAST(min(n) AS DOUBLE) / max(n), 4) >= 0.5 AS balanced FROM h")
def class_balance(t):
    return training.class_balance(t("labels"), "quality", "doc_id")


@query("SELECT doc_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def hash_split(t):
    return training.hash_split(t("documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def stratified_split(t):
    return training.hash_split(t("labels").select("doc_id", "quality"), "doc_id", within=["quality"])


@query("SELECT count(*) AS records, CAST(sum(length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))) AS BIGINT) AS characters, CAST(ceil(sum(length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))) / 4.0) AS BIGINT) AS tokens FROM documents")
def text_statistics(t):
    return training.text_statistics(t("documents"), ["text"])


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch FROM documents")
def batches(t):
    return dedup.batches(t("documents").select("doc_id"), "doc_id", 100)


@query(_scores("batch", source="(SELECT text, lang, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch FROM documents)"))
def batch_quality(t):
    return _report(pipeline.batch_quality(t("documents"), RECORD, "doc_id", 100))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def top_operations(t):
    return catalog.top_operations(t("events"), "ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT count(*) AS datasets, CAST(sum(n) AS BIGINT) AS records, CAST(floor(avg(CASE WHEN q > 0 THEN q END) + 0.5) AS BIGINT) AS average_quality FROM (SELECT source, count(*) AS n, CAST(floor(100.0 * count(DISTINCT text || chr(1) || lang) / count(*) + 0.5) AS BIGINT) AS q FROM documents GROUP BY source)")
def catalog_stats(t):
    sets = quality.validate(t("documents"), RECORD, ["source"]).select("records", F.col("uniqueness").alias("quality"))
    return catalog.catalog_stats(sets)


@query(f"SELECT min(c_custkey) AS c_custkey, trim(v) AS v FROM {_RAW_SQL} WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY v")
def service_clean(t):
    return pipeline.service_clean(_raw(t).select("c_custkey", "v"), ["v"], "c_custkey")


@query(f"SELECT min(c_custkey) AS c_custkey, trim(v) AS v FROM {_RAW_SQL} WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY trim(v)")
def service_prepare(t):
    return pipeline.service_prepare(_raw(t).select("c_custkey", "v"), ["v"], "c_custkey")


_DELTA = ["records", "completeness", "uniqueness", "validity", "format", "privacy", "overall"]


@query(f"""WITH b AS ({_scores()}), a AS ({_scores(source="(SELECT DISTINCT text, lang FROM documents)")})
SELECT {', '.join(f'b.{c} AS before_{c}, a.{c} AS after_{c}, a.{c} - b.{c} AS delta_{c}' for c in _DELTA)} FROM a, b""")
def compare_quality(t):
    d = t("documents")
    return quality.compare_quality(d, dedup.deduplicate(d, RECORD, "doc_id"), RECORD)


@query(f"WITH r AS ({_scores()}) SELECT duplicates, empty_records AS invalid, findings AS sensitive FROM r")
def quick_validate(t):
    return quality.quick_validate(t("documents"), RECORD)


@query(f"WITH r AS ({_scores('source')}) SELECT records, overall, status, duplicates, findings, (overall >= 70 AND findings = 0) AS ready FROM r")
def quality_summary(t):
    return quality.summary(quality.validate(t("documents"), RECORD, ["source"]))


@query()
def lcg_split(t):
    return training.lcg_split(t("labels").select("doc_id"), "doc_id")


@query()
def nfkc_normalize(t):
    return t("documents").select("doc_id", text.nfkc(F.col("text")).alias("text"))
