"""Whole runs: sources to clean, checked data sets; batches; manifests."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.errors import RecordError
from quarrymill.functions.names import dataset_name, plain
from quarrymill.functions.text import fingerprint
from quarrymill.operators.clean import CleanOptions, clean_dataset, clean_records, is_empty_record, keep_fields, remove_empty_fields, reorder_fields
from quarrymill.operators.dedup import batches, compare, deduplicate
from quarrymill.operators.privacy import sensitive_counts
from quarrymill.operators.quality import readiness, recommendations, validate
from quarrymill.sources.collect import collected
from quarrymill.sources.readers import Source, normalize_names

STEPS = ("read", "collect", "clean", "validate")


@dataclass
class Dataset:
    """Records with what is known of them."""

    df: DataFrame
    name: str
    report: dict
    figures: dict
    status: str
    sources: list[str] = field(default_factory=list)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def manifest(self) -> dict:
        return {
            "id": self.id, "name": self.name, "status": self.status, "createdAt": self.created_at,
            "columns": [c for c in self.df.columns if not c.startswith("_")], "sources": self.sources,
            "quality": self.report, "cleaning": self.figures,
        }


def cleaning_pipeline(df: DataFrame, columns: list[str], order: str, options: CleanOptions = CleanOptions(), drop_empty_fields: bool = False, keep: list[str] | None = None, first: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Empty fields, then kept fields, then cleaning, then field order. Returns (records, figures)."""
    rows = remove_empty_fields(df, columns) if drop_empty_fields else df
    rows = keep_fields(rows, keep or [], order)
    out, figures = clean_dataset(rows, [c for c in columns if c in rows.columns], order, options)
    return (reorder_fields(out, first) if first else out), figures


def process(df: DataFrame, columns: list[str], order: str, name: str = "dataset", options: CleanOptions = CleanOptions(), before: bool = True) -> Dataset:
    """An existing data set: equal records go, then cleaning, scores, readiness."""
    rows = deduplicate(df, columns, order) if before else df
    out, figures = cleaning_pipeline(rows, columns, order, options)
    names = [c for c in out.columns if c != "_row"]
    report = recommendations(readiness(validate(out, names))).first().asDict()
    found = figures.first().asDict()
    return Dataset(out, name, report, found, "ready_for_review" if report["ready"] else "needs_review")


def process_sources(spark: SparkSession, sources: list[Source], columns: list[str], name: str = "dataset", options: CleanOptions = CleanOptions(), fetcher=None) -> tuple[Dataset, list[dict]]:
    """Read all sources, leave failed ones out, merge, clean and score. Returns the data set and the steps as they went.

    Sources are read in one job (``collected``); a step of each says what became of it after reading, with its records or
    its error. Files of a source that can't be read are steps of their own, with their address.
    """
    steps: list[dict] = []

    def timed(name: str, run):
        """Runs a step and logs when it ran and how long it took."""
        started, began = datetime.now(UTC), time.perf_counter()
        out = run()
        steps.append({"name": name, "status": "completed", "startedAt": started.isoformat(), "finishedAt": datetime.now(UTC).isoformat(), "durationMs": round((time.perf_counter() - began) * 1000)})
        return out

    merged, outcomes = timed("read", lambda: collected(spark, sources, fetcher))
    whole = steps.pop()
    of_source = {o.source: [x for x in outcomes if x.source == o.source] for o in outcomes}
    for i, own in of_source.items():
        for o in own:
            step = whole | {"name": f"collect:{sources[i].name or i}", "status": "completed" if o.success else "failed", "records": o.records}
            step |= {"file": o.path} if len(own) > 1 else {}
            steps.append(step | ({} if o.success else {"error": o.error}))
    if merged is None or not any(o.success for o in outcomes):
        raise RecordError("NO_SOURCES", "no source could be read", steps=steps)
    at = F.struct(F.col("_source").alias("s"), "_path", "id").alias("_at")
    typed = merged.select(at, *[F.get_json_object("record", f"$['{c}']").alias(c) for c in columns])
    out, figures = cleaning_pipeline(typed, columns, "_at", options)
    found = timed("clean", lambda: figures.first().asDict())
    names = [c for c in out.columns if c != "_row"]
    report = timed("validate", lambda: recommendations(readiness(validate(out, names))).first().asDict())
    done = Dataset(out, name, report, found, "ready_for_review" if report["ready"] else "needs_review", [s.name for s in sources])
    return done, [{"name": "read", **{k: v for k, v in whole.items() if k != "name"}}, *steps]


def final_report(data: Dataset, steps: list[dict]) -> dict:
    """The manifest with the definition of the run, its steps and their time."""
    return data.manifest() | {"steps": steps, "definition": list(STEPS), "failed": [s["name"] for s in steps if s["status"] == "failed"], "durationMs": sum(s["durationMs"] for s in steps)}


def process_batches(df: DataFrame, columns: list[str], order: str, size: int = 1000, options: CleanOptions = CleanOptions()) -> tuple[DataFrame, DataFrame]:
    """(records with ``_row`` and ``batch``, report): every batch of ``size`` rows is cleaned and deduplicated on its own.

    All batches are one job. The report has batch (from 1), records_before, records_after and quality.
    """
    rows = clean_records(batches(df, order, size), columns, order, options, ["batch"])
    names = [c for c in rows.columns if not c.startswith("_") and c != "batch"]
    kept = (rows.where(~F.col("_empty")) if options.remove_empty else rows).select("_row", "batch", *names)
    out = deduplicate(kept, names, "_row", ["batch"]) if options.remove_duplicates else kept
    before = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("records_before"))
    after = validate(out, names, ["batch"]).select("batch", F.col("records").alias("records_after"), F.col("overall").alias("quality"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = before.join(after, "batch", "left").select((F.col("batch") + 1).alias("batch"), "records_before", none("records_after"), none("quality"))
    return out, report


def batch_quality(df: DataFrame, columns: list[str], order: str, size: int = 1000) -> DataFrame:
    """Scores of each batch of ``size`` rows: duplicates are those within a batch."""
    return validate(batches(df, order, size), columns, ["batch"])


def compare_process(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    return compare(before, after, columns)


def service_clean(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The service's clean: empty records go, then equal ones, then values are trimmed, so new equals can remain."""
    full = df.where(~is_empty_record(df, columns, "service"))
    return normalize_names(deduplicate(full, columns, order), "service")


def service_prepare(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The service's preparation: values are trimmed first, then empty and equal records go."""
    rows = normalize_names(df, "service")
    names, key = list(dict.fromkeys(plain(c, True) for c in columns)), plain(order, True)
    return deduplicate(rows.where(~is_empty_record(rows, names, "service")), names, key)


def draft(df: DataFrame, columns: list[str], name: str | None = None, kind: str = "general", source: str = "manual") -> dict:
    """A new data set under the service's rules: its records with their figures and the types of sensitive values."""
    rows = normalize_names(df.select(*columns), "service")
    report = validate(rows, rows.columns, None, "service").first().asDict()
    found = {r["type"]: r["findings"] for r in sensitive_counts(rows, rows.columns, "service").where("findings > 0").collect()}
    return {"id": uuid.uuid4().hex, "name": dataset_name(name), "type": kind[:50] or "general", "source": source, "df": rows, "recordCount": report["records"], "quality": report, "sensitive": found, "status": "draft", "createdAt": datetime.now(UTC).isoformat()}


def collection_report(steps: list[dict]) -> dict:
    """How many sources were asked for and read, and what failed."""
    asked = [s for s in steps if s["name"].startswith("collect:")]
    bad = [s for s in asked if s["status"] == "failed"]
    return {"success": len(bad) < len(asked), "sources": len(asked), "read": len(asked) - len(bad), "failed": [{"name": s["name"][8:], "error": s["error"]} for s in bad]}


def record_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(columns))
