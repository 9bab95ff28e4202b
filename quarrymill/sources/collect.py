"""Sources read together, with what became of each: a source that fails is a row, not the end of the run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.errors import RecordError, SourceError
from quarrymill.functions.scratch import written
from quarrymill.sources.lines import ROWS, file_lines, plain_path
from quarrymill.sources.pages import fetch_pages, page_records
from quarrymill.sources.readers import BLOCKED, Source, decoded, file_type, html_title, json_records, parse_csv, strip_html, text_lines

COLUMNS = ("_path", "id", "record", "problem")


@dataclass
class Outcome:
    """What became of one source, or of one file of it: the records read, or the first error."""

    source: int
    path: str
    records: int
    error: dict | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path, folder or pattern stands for; from metadata."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = list(fs.globStatus(place) or []), []
    for status in found:
        inner = list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
        out += [(s.getPath().toString(), s.getLen()) for s in inner if not s.isDirectory() and s.getPath().getName()[0] not in "._"]
    return out


def files_of(spark: SparkSession, paths: list[str], hint: str = "", as_type: str = "") -> tuple[dict[str, list[str]], list[tuple[str, SourceError]]]:
    """(files by type, paths with the error that keeps them from being read); ``hint`` is the type of files
    without a known extension, ``as_type`` that of all, whatever they are called."""
    by_type: dict[str, list[str]] = {}
    problems = []
    for path in paths:
        try:
            found = listed(spark, path)
            if not found:
                file_type(path, hint)
                raise SourceError("FILE_NOT_FOUND", path=path)
            for own, size in found:
                kind = as_type if as_type and not own.lower().endswith(BLOCKED) else file_type(own, hint)
                if not size:
                    raise SourceError("EMPTY_FILE", path=own)
                by_type.setdefault(kind, []).append(own)
        except SourceError as e:
            problems.append((path, e))
    return by_type, problems


def file_records(spark: SparkSession, by_type: dict[str, list[str]]) -> DataFrame:
    """(_path, id, record, problem) of files: lines in blocks, one JSON document a file otherwise."""
    parts = []
    for kind, paths in by_type.items():
        if kind in ROWS:
            parts.append(ROWS[kind](file_lines(spark, paths)))
        else:
            whole = spark.read.format("binaryFile").load(paths).select(plain_path(F.col("path")).alias("_path"), decoded(F.col("content")).alias("text"))
            parts.append(json_records(whole, "text", ["_path"]).select("_path", F.col("index").cast("long").alias("id"), "record", "problem"))
    return reduce(DataFrame.union, parts)


def value_records(spark: SparkSession, kind: str, name: str, text: str) -> DataFrame:
    """(_path, id, record, problem) of one text."""
    whole, none = spark.createDataFrame([(name, text)], "_path string, text string"), F.lit(None).cast("string").alias("problem")
    number = F.col("id").cast("long").alias("id")
    if kind == "json":
        return json_records(whole, "text", ["_path"]).select("_path", F.col("index").cast("long").alias("id"), "record", "problem")
    if kind == "csv":
        return parse_csv(whole, "text", ["_path"]).select("_path", number, F.to_json("record").alias("record"), none)
    if kind == "text":
        return text_lines(whole, "text", ["_path"], numbered=True).select("_path", number, F.to_json(F.struct("id", "text")).alias("record"), none)
    page = strip_html(F.col("text"))
    fields = [html_title(F.col("text")).alias("title"), page.alias("text")] if kind == "html" else [page.alias("text")]
    return whole.select("_path", F.lit(1).cast("long").alias("id"), F.to_json(F.struct(*fields)).alias("record"), none)


def collected(spark: SparkSession, sources: list[Source], fetcher: Callable | None = None) -> tuple[DataFrame | None, list[Outcome]]:
    """(records, outcomes): all sources read in one job. Records have _source, _path, id and record (a JSON text).

    What can't be read (an unknown kind, a missing or empty file) is an outcome with its error. URLs are fetched by tasks
    with ``fetcher`` (``fetch``, or a function like it).
    What turns out not to be what it should be (a text that isn't JSON, a line of a JSON-lines file) is found while
    reading (a source's option ``as`` names the type of its files, whatever they are called): it travels as a row with a problem, one aggregation over what was written gives each source and file its first
    one, and the records of that file are left out. Outcomes are one a source, of several files one a file.
    """
    parts, outcomes, known, urls = [], [], {}, []
    for i, source in enumerate(sources):
        kind = str(source.kind).lower()
        try:
            if kind == "file":
                paths = [source.value] if isinstance(source.value, str) else [str(p) for p in source.value]
                by_type, problems = files_of(spark, paths, str(source.options.get("type", "")), str(source.options.get("as", "")))
                outcomes += [Outcome(i, p, 0, e.as_dict()) for p, e in problems]
                known |= {(i, p): True for own in by_type.values() for p in own}
                if by_type:
                    parts.append(file_records(spark, by_type).withColumn("_source", F.lit(i)))
                continue
            if kind in ("text", "json", "csv"):
                sort, text, path = kind, str(source.value), source.name
            elif kind in ("url", "web", "http", "https"):
                if fetcher is None:
                    raise SourceError("NO_FETCHER", "a URL source needs a fetcher")
                urls.append((i, str(source.value)))
                known[(i, str(source.value))] = True
                continue
            else:
                raise SourceError("UNSUPPORTED_SOURCE_TYPE", kind)
            known[(i, path)] = True
            parts.append(value_records(spark, sort, path, text).withColumn("_source", F.lit(i)))
        except RecordError as e:
            outcomes.append(Outcome(i, source.name, 0, e.as_dict()))
    if urls:
        asked = spark.createDataFrame(urls, "_source int, url string")
        pages = asked.join(fetch_pages(asked, "url", fetcher), "url").withColumnRenamed("url", "_path")
        parts.append(page_records(pages, ["_source", "_path"]).select("_path", "id", "record", "problem", "_source"))
    if not parts:
        return None, outcomes
    rows = written(reduce(DataFrame.unionByName, parts), "collected")
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("id", "problem"))).alias("first")
    found = rows.groupBy("_source", "_path").agg(F.count_if(F.col("problem").isNull()).alias("records"), first).collect()  # one row a file
    seen = {(r["_source"], r["_path"]): r for r in found}
    bad = []
    for key in dict.fromkeys([*known, *seen]):
        row = seen.get(key)
        if row is not None and row["first"] is not None:
            bad.append(key)
            outcomes.append(Outcome(*key, 0, SourceError(row["first"]["problem"], at=row["first"]["id"]).as_dict()))
        else:
            outcomes.append(Outcome(*key, row["records"] if row is not None else 0))
    good = rows.where("problem is null")
    if bad:
        gone = spark.createDataFrame(bad, "_s int, _p string")
        good = good.join(F.broadcast(gone), (F.col("_source") == F.col("_s")) & (F.col("_path") == F.col("_p")), "left_anti")
    outcomes.sort(key=lambda o: o.source)
    return good.select("_source", "_path", "id", "record"), outcomes
