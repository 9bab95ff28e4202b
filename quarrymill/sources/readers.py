"""Readers of text, JSON, JSON lines, CSV, HTML and XML, for files and for texts in a column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.errors import SourceError
from quarrymill.functions.guards import detect_format
from quarrymill.functions.names import plain
from quarrymill.functions.scratch import written
from quarrymill.functions.text import trimmed

# File extensions by type, and those that are never read.
TYPES = {".txt": "text", ".text": "text", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}
BLOCKED = (".exe", ".msi", ".bat", ".cmd", ".com", ".scr", ".ps1", ".vbs", ".js", ".jar", ".dll", ".sys", ".sh", ".php", ".asp", ".aspx", ".cgi")
# The entities that are decoded, in this order, so that a double-escaped one is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
MAX_FILE_BYTES = 25 * 1024 * 1024


def file_type(path: str, hint: str = "") -> str:
    extension = PurePosixPath(path).suffix.lower()
    if extension in BLOCKED:
        raise SourceError("BLOCKED_EXTENSION", extension=extension)
    found = TYPES.get(extension) or next((t for t in ("jsonl", "json", "csv", "text") if t in hint.lower()), None)
    if not found:
        raise SourceError("UNSUPPORTED_EXTENSION", extension=extension)
    return found


def type_of(path: Column) -> Column:
    """The type that a path's extension stands for, or null."""
    extension, kind = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit(None).cast("string")
    for e, t in TYPES.items():
        kind = F.when(extension == e, t).otherwise(kind)
    return kind


def file_problem(path: Column, size: Column, most: int = MAX_FILE_BYTES) -> Column:
    """A code for what keeps a file from being read, or null."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    problem = F.when(extension.isin(*BLOCKED), "BLOCKED_EXTENSION").when(type_of(path).isNull(), "UNSUPPORTED_EXTENSION")
    return problem.when(size > most, "FILE_TOO_LARGE").when(size == 0, "EMPTY_FILE")


def files(spark: SparkSession, paths: list[str], most: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, bytes, modified, type, problem) of files, from metadata only."""
    rows = spark.read.format("binaryFile").load(paths).drop("content")
    problem = file_problem(F.col("path"), F.col("length"), most)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), type_of(F.col("path")).alias("type"), problem.alias("problem"))


def decoded(content: Column) -> Column:
    """Text of bytes by their byte order mark; UTF-8 without one."""
    start = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    return (
        F.when(start.startswith("EFBBBF"), F.decode(rest(3), "UTF-8"))
        .when(start.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(start.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def text_lines(df: DataFrame, text: str, keys: list[str], numbered: bool = False) -> DataFrame:
    """(keys, line no., text): non-blank lines, trimmed. Numbered: CRLF and CR end lines too, and blanks aren't counted."""
    whole = F.regexp_replace(text, "\r\n?", "\n") if numbered else F.col(text)
    lines = F.filter(F.transform(F.split(whole, "\n+"), trimmed), lambda x: x != "")
    rows = df.select(*keys, F.posexplode(lines).alias("at", "line"))
    return rows.select(*keys, (F.col("at") + 1).alias("id"), F.col("line").alias("text"))


def json_records(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, index, record, problem): arrays give their elements, other values one record; scalars as ``{"value": x}``."""
    v = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(v)
    bad = v.isNull() | F.col(text).isNull()
    many = F.when(bad, F.array(v)).when(kind.startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = df.select(*keys, bad.alias("_bad"), F.posexplode_outer(many).alias("index", "_v"))
    inner = F.schema_of_variant("_v")
    json = F.to_json("_v")
    record = F.when(F.col("_bad") | F.col("_v").isNull(), F.lit(None)).when(inner.startswith("OBJECT"), json).otherwise(F.concat(F.lit('{"value":'), json, F.lit("}")))
    return rows.select(*keys, "index", record.alias("record"), F.when(F.col("_bad"), "INVALID_JSON").alias("problem"))


def json_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line, record, problem) of texts with a JSON value on each line; blank lines aren't counted."""
    lines = text_lines(df, text, keys, numbered=True)
    good = F.try_parse_json("text").isNotNull()
    return lines.select(*keys, F.col("id").alias("line"), F.when(good, F.col("text")).alias("record"), F.when(~good, "INVALID_LINE").alias("problem"))


def csv_cells(line: Column, delimiter: str = ",") -> Column:
    """The trimmed cells of one line: quoted parts may hold delimiters, a doubled quote is one quote."""
    # A quote toggles; a delimiter outside quotes ends a cell. Marked by a control character, then split.
    parts = F.split(line, '"')
    marked = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(delimiter), F.lit("\u0001"))).otherwise(x))
    joined = F.array_join(marked, '"')
    return F.transform(F.split(joined, "\u0001"), lambda c: trimmed(F.replace(F.regexp_replace(F.replace(c, F.lit('""'), F.lit("\u0002")), '"', ""), F.lit("\u0002"), F.lit('"'))))


def csv_text_lines(text: Column) -> Column:
    """The lines of a CSV text that aren't blank."""
    return F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: trimmed(x) != "")


def csv_names(line: Column) -> Column:
    """The names of a header line: a blank one is ``column_N``."""
    return F.transform(csv_cells(line), lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h))


def csv_places(names: str) -> Column:
    """Where the cells of a column of header names are taken from: of equal names the last place stays."""
    places = F.transform(names, lambda h, i: F.struct(h.alias("name"), i.alias("place")))
    return F.filter(places, lambda x: ~F.array_contains(F.slice(names, x["place"] + 2, F.size(names)), x["name"]))


def csv_record(line: Column, places: str) -> Column:
    """A map of a line's cells by the names of ``csv_places``; cells that are missing are empty."""
    # The one-element array keeps the cells a variable, so that they are cut once a line and not once a name.
    made = F.transform(F.array(csv_cells(line)), lambda own: F.map_from_entries(F.transform(places, lambda x: F.struct(x["name"], F.coalesce(F.get(own, x["place"]), F.lit(""))))))
    return made[0]


def parse_csv(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, id, record): a map of each line's cells by the header's names. Lines end before quotes are looked at.

    Blank lines go; a blank header is ``column_N``; short rows are filled with empty cells, long ones cut; of equal
    headers the last cell stays. A text is cut into lines once, its header read once. For texts too large for one row
    there is ``csv_blocks``.
    """
    # Made before lines are exploded: what stands beside the explosion is made again for every line.
    own = df.select(*keys, csv_text_lines(F.col(text)).alias("_lines"))
    own = own.select(*keys, "_lines", csv_names(F.get("_lines", F.lit(0))).alias("_names"))
    own = own.select(*keys, "_lines", csv_places("_names").alias("_places"))
    rows = own.select(*keys, "_places", F.posexplode("_lines").alias("_at", "_line")).where("_at > 0")
    return rows.select(*keys, F.col("_at").alias("id"), csv_record(F.col("_line"), "_places").alias("record"))


def csv_blocks(df: DataFrame, text: str, keys: list[str], block: str) -> DataFrame:
    """(keys, id, record) of CSV texts that come in blocks, as ``parse_csv`` has them of the whole text.

    The blocks of a text, in the order of ``block``, are cut at line ends. Each is read where it is; its numbers start
    after the lines of the blocks before, and its names are those of the text's first line. One row a block meets in
    one place. The blocks are written to the shared folder once, so that both see the same lines.
    """
    own = written(df.select(*keys, F.col(block).alias("_block"), csv_text_lines(F.col(text)).alias("_lines")).where(F.size("_lines") > 0), "csv-blocks")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines, first = F.size("_lines").cast("long"), F.get("_lines", F.lit(0))
    heads = own.select(*keys, "_block", lines.alias("_n"), first.alias("_first"))
    heads = heads.select(*keys, "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.first("_first").over(before).alias("_head"))
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before", csv_names(F.col("_head")).alias("_names"))
    heads = heads.select("*", csv_places("_names").alias("_places"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = own.join(heads, [F.col("_block").eqNullSafe(F.col("_b")), *same]).select(*keys, "_before", "_places", F.posexplode("_lines").alias("_at", "_line"))
    rows = rows.select(*keys, (F.col("_before") + F.col("_at")).alias("id"), "_places", "_line").where("id > 0")
    return rows.select(*keys, "id", csv_record(F.col("_line"), "_places").alias("record"))


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A CSV file as a typed table of trimmed strings, read in parallel by the engine's own reader."""
    df = spark.read.csv(paths, header=True, quote='"', escape='"', multiLine=False, mode="PERMISSIVE")
    names = [c if not c.startswith("_c") or not c[2:].isdigit() else f"column_{int(c[2:]) + 1}" for c in df.columns]
    return df.toDF(*names).select(*[F.coalesce(trimmed(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names])


def strip_html(c: Column) -> Column:
    """Text of markup: blocks of scripts, styles and drawings go, tags become spaces, then entities are decoded."""
    for name in ("script", "style", "noscript", "svg"):
        c = F.regexp_replace(c, rf"(?is)<{name}\b[^>]*>.*?</{name}>", " ")
    c = trimmed(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    for entity, plain_text in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", plain_text.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def html_title(c: Column) -> Column:
    return strip_html(F.regexp_extract(c, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def normalize_names(df: DataFrame, profile: str = "file") -> DataFrame:
    """Columns under the lighter name rule and strings trimmed; of equal names the last column stays."""
    names = [plain(c, profile == "service") for c in df.columns]
    last = {n: c for n, c in zip(names, df.columns, strict=True)}
    value = lambda c: trimmed(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`")
    return df.select(*[value(c).alias(n) for n, c in last.items()])


@dataclass
class Source:
    """What to read: ``text``, ``json``, ``csv`` (a value), ``file`` (paths) or ``url`` (through a fetcher)."""

    kind: str
    value: object
    name: str = ""
    options: dict = field(default_factory=dict)


def source_of(value: object) -> Source:
    """A source from a URL or from a description with ``type``, ``url`` or ``value``, and other options."""
    if isinstance(value, Source):
        return value
    if isinstance(value, str):
        return Source("url", value)
    if not isinstance(value, dict):
        raise SourceError("INVALID_SOURCE")
    kind = str(value.get("type") or ("url" if value.get("url") else "unknown")).lower()
    given = next((value[k] for k in ("url", "value", "text", "data", "path") if value.get(k) is not None), None)
    return Source(kind, given, str(value.get("name", "")), sanitized({k: v for k, v in value.items() if k not in ("type", "name")}))


def records_of(result: object) -> object:
    """The records in an answer: of its collection, its own, or itself if it is a list; else none."""
    if isinstance(result, dict):
        inner = result.get("collection")
        return inner["records"] if isinstance(inner, dict) and "records" in inner else result.get("records", [])
    return result if isinstance(result, (list, DataFrame)) else []


def read(spark: SparkSession, source: Source, fetcher=None) -> DataFrame:
    """(index, record): JSON texts of the records of one source."""
    kind = source.kind.lower()
    if kind == "file":  # of any size and of several types, each by its own rules
        from quarrymill.sources import collect

        paths = [source.value] if isinstance(source.value, str) else list(source.value)
        by_type, problems = collect.files_of(spark, paths)
        if problems:
            raise problems[0][1]
        return collect.file_records(spark, by_type).where("problem is null").drop("problem")
    if kind in ("text", "json", "csv"):
        sort, whole = kind, spark.createDataFrame([(source.name, str(source.value))], "_path string, text string")
    elif kind in ("url", "web", "http", "https"):
        if fetcher is None:
            raise SourceError("NO_FETCHER", "a URL source needs a fetcher")
        page = fetcher(str(source.value))
        sort, whole = page.format, spark.createDataFrame([(str(source.value), page.text)], "_path string, text string")
    else:
        raise SourceError("UNSUPPORTED_SOURCE_TYPE", kind)
    keys = ["_path"]
    if sort == "json":
        rows = json_records(whole, "text", keys).where("problem is null").select(*keys, F.col("index").alias("id"), "record")
    elif sort == "jsonl":
        rows = json_lines(whole, "text", keys).where("problem is null").select(*keys, F.col("line").alias("id"), "record")
    elif sort == "csv":
        rows = parse_csv(whole, "text", keys).select(*keys, "id", F.to_json("record").alias("record"))
    elif sort == "xml":
        rows = whole.select(*keys, F.lit(1).alias("id"), F.to_json(F.struct(strip_html(F.col("text")).alias("text"))).alias("record"))
    elif sort == "html":
        rows = whole.select(*keys, F.lit(1).alias("id"), F.to_json(F.struct(html_title(F.col("text")).alias("title"), strip_html(F.col("text")).alias("text"))).alias("record"))
    elif sort == "text":
        rows = text_lines(whole, "text", keys, numbered=True).select(*keys, "id", F.to_json(F.struct("id", "text")).alias("record"))
    else:
        rows = whole.where("false").select(*keys, F.lit(0).alias("id"), "text")
    return rows


def parse_collected(df: DataFrame, text: str, content_type: Column, path: Column, keys: list[str]) -> DataFrame:
    """(keys, format, id, record): texts of a column parsed by the format that each is found to have; unknown ones have none."""
    rows = df.select(*keys, F.coalesce(text, F.lit("")).alias("_text"), detect_format(content_type, F.col(text), path).alias("_format"))
    of = lambda f: rows.where(F.col("_format") == f)
    page = strip_html(F.col("_text"))
    plain = lambda r: r.where(F.get_json_object("record", "$.text") != "")
    parts = {
        "json": json_records(of("json"), "_text", keys).where("problem is null").select(*keys, (F.col("index") + 1).alias("id"), "record"),
        "csv": parse_csv(of("csv"), "_text", keys).select(*keys, "id", F.to_json("record").alias("record")),
        "html": of("html").select(*keys, F.lit(1).alias("id"), F.to_json(F.struct(html_title(F.col("_text")).alias("title"), page.alias("text"))).alias("record")),
        "xml": plain(of("xml").select(*keys, F.lit(1).alias("id"), F.to_json(F.struct(page.alias("text"))).alias("record"))),
        "text": text_lines(of("text"), "_text", keys).select(*keys, "id", F.to_json(F.struct("text")).alias("record")),
    }
    return reduce(DataFrame.union, [r.select(*keys, F.lit(f).alias("format"), "id", "record") for f, r in parts.items()])


def record_fields(df: DataFrame, json: str) -> DataFrame:
    """(field, present): how many JSON records have each top-level field."""
    keys = df.select(F.explode(F.json_object_keys(json)).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("present"))


def read_many(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[dict]]:
    """All files that can be read, each by its own type, and a line for each path with its error if it can't be."""
    from quarrymill.sources import collect

    rows, outcomes = collect.collected(spark, [Source("file", paths)])
    report = [{"file": o.path, "success": o.success} | ({"records": o.records} if o.success else {"error": o.error}) for o in outcomes]
    return (rows.drop("_source") if rows is not None and any(o.success for o in outcomes) else None), report


def service_text(df: DataFrame, text: str, kind: str, keys: list[str]) -> DataFrame:
    """(keys, id, record, problem): texts under the service's rules.

    Texts that are declared or look like JSON give their records; if they were only taken for JSON and aren't, or are
    plain text, their lines; CSV is only what is declared so.
    """
    whole = df.select(*keys, trimmed(F.coalesce(text, F.lit(""))).alias("_text")).where("_text <> ''")
    declared = kind.lower() in ("json", "application/json")
    looks = F.lit(True) if declared else F.col("_text").startswith("{") | F.col("_text").startswith("[")
    good = looks & F.try_parse_json("_text").isNotNull()
    v = F.try_parse_json("_text")
    many = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    as_json = whole.where(good).select(*keys, F.posexplode(many).alias("_at", "_v"))
    as_json = as_json.select(*keys, (F.col("_at") + 1).alias("id"), F.to_json("_v").alias("record"), F.lit(None).cast("string").alias("problem"))
    rest = whole.where(~good)
    if declared:
        return as_json.union(rest.select(*keys, F.lit(1), F.lit(None).cast("string"), F.lit("INVALID_JSON")))
    if kind.lower() in ("csv", "text/csv"):
        other = parse_csv(rest, "_text", keys).select(*keys, "id", F.to_json("record").alias("record"), F.lit(None).cast("string").alias("problem"))
    else:
        other = text_lines(rest, "_text", keys).select(*keys, "id", F.to_json(F.struct("text")).alias("record"), F.lit(None).cast("string").alias("problem"))
    return as_json.union(other)


def looks_like_csv(text: str) -> bool:
    """Whether the first five filled lines, two at least, have the same number of commas, and some."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()][:5]
    counts = {x.count(",") for x in lines}
    return len(lines) > 1 and len(counts) == 1 and counts != {0}


def sniffed_csv(text: Column) -> Column:
    """``looks_like_csv`` of a column."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    counts = F.transform(F.slice(lines, 1, 5), lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    return (F.size(counts) > 1) & (F.size(F.array_distinct(counts)) == 1) & (F.get(counts, F.lit(0)) > 0)


def supported_formats() -> dict[str, str]:
    return dict(TYPES)


# Parts of the names of a source's secrets.
SECRETS = ("password", "secret", "token", "apikey", "api_key")


def sanitized(options: dict) -> dict:
    """A source's description without secrets, long values cut."""
    return {k: v[:4000] if isinstance(v, str) else v for k, v in options.items() if not any(s in k.lower() for s in SECRETS)}


def sanitized_map(c: Column) -> Column:
    """``sanitized`` of a column of maps of strings."""
    kept = F.map_filter(c, lambda k, _: ~reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(s)) for s in SECRETS]))
    return F.transform_values(kept, lambda _, v: F.substring(v, 1, 4000))
