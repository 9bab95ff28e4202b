"""A catalog of data sets, projects, collections, operations and settings: versions of entries in a folder; no HTTP server."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import partial
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.errors import RecordError, SourceError
from quarrymill.functions.names import plain
from quarrymill.operators.clean import is_empty_record
from quarrymill.operators.privacy import sensitive_counts
from quarrymill.operators.quality import validate
from quarrymill.plans.pipeline import draft, service_clean, service_prepare
from quarrymill.sources.fetch import Page, fetch
from quarrymill.sources.pages import fetch_pages
from quarrymill.sources.readers import record_fields, service_text

LEVELS = ("basic", "standard", "strict")
#: Operations that the log holds, the newest; tries of a change that others are ahead of.
LOGGED, TRIES = 500, 30
_HISTORY = "array<struct<action: string, at: string, before: bigint, removed_empty: bigint, removed_duplicates: bigint, after: bigint, findings: bigint>>"
SCHEMAS = {
    "datasets": f"id string, version long, name string, type string, source string, records long, quality long, findings long, privacy string, status string, path string, created_at string, updated_at string, history {_HISTORY}",
    "projects": "id string, version long, name string, description string, status string, created_at string, updated_at string",
    "collections": "id string, version long, type string, url string, dataset_id string, status string, created_at string",
    "operations": "id string, version long, at string, type string, dataset_id string, url string, records long, quality long, findings long",
    "settings": "id string, version long, value string, at string",
}


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one: then nothing changes and it is False.

    The text is written aside and gets its name in one step that fails if the name is taken: a link on mounted folders, a
    rename without overwriting elsewhere. On stores without such a rename two writers can both believe they were first.
    """
    target, fs = _place(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            _rename(spark, aside, target)
    except FileExistsError:
        return False
    finally:
        fs.delete(aside, False)
    return True


def _rename(spark: SparkSession, aside, target) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    options[0] = jvm.java.lang.Enum.valueOf(kind, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(aside, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(str(target)) from e
        raise


class Catalog:
    """Entries in versions under one folder. Nothing is overwritten: a change is a new version of its entry.

    A version is a small file named by entry and number, put there only if no other writer was first; who comes second reads
    again and tries again on top. A table is the newest version of every entry, of the last snapshot and of the files
    since. ``compact`` makes a new snapshot and deletes the files that the snapshot before the last had taken in, so who
    reads while that goes on still finds what was listed. Records of data sets are folders of their own; a change of
    records writes a new folder and then the version that names it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        place, fs = _place(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName()[0] not in "._") if fs.exists(place) else []

    def _text(self, path: str) -> str:
        place, fs = _place(self.spark, path)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _snapshot(self, name: str) -> tuple[int, dict]:
        """Number and contents of the newest pointer to a snapshot; 0 without one."""
        found = [n for n in self._names(f"snapshots/{name}") if n.endswith(".json")]
        return (int(found[-1][:-5]), json.loads(self._text(f"{self.path}/snapshots/{name}/{found[-1]}"))) if found else (0, {})

    def _versions(self, name: str, files: list[str], pointer: dict) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        kept = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{pointer['data']}") if pointer else empty
        new = self.spark.read.schema(SCHEMAS[name]).json([f"{self.path}/changes/{name}/{f}" for f in files]) if files else empty
        every = kept.unionByName(new)
        return every.groupBy("id").agg(F.max_by(F.struct(*every.columns), "version").alias("e")).select("e.*")

    def table(self, name: str) -> DataFrame:
        """The newest version of every entry; of operations the newest ``LOGGED``."""
        files = self._names(f"changes/{name}")  # before the pointer: what is deleted meanwhile is in the snapshot
        now = self._versions(name, files, self._snapshot(name)[1])
        return now.orderBy(F.desc("at"), F.desc("id")).limit(LOGGED) if name == "operations" else now

    def entry(self, table: str, key: str) -> dict | None:
        """An entry's newest version: of its own files only and of the snapshot."""
        files = [f for f in self._names(f"changes/{table}") if f.startswith(f"{quote(key, safe='')}.")][-1:]
        row = self._versions(table, files, self._snapshot(table)[1]).where(F.col("id") == key).first()
        return row.asDict(recursive=True) if row is not None else None

    def _put(self, table: str, values: dict) -> bool:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        text = json.dumps({n: values[n] for n in names if values.get(n) is not None}, default=str)
        return put_once(self.spark, f"{self.path}/changes/{table}/{quote(values['id'], safe='')}.{values['version']:09d}.json", text)

    def add(self, table: str, /, **values: object) -> str:
        stamp = datetime.now(UTC).isoformat()
        values = {"id": uuid.uuid4().hex, "created_at": stamp, "updated_at": stamp, "at": stamp} | values | {"version": 1}
        if not self._put(table, values):
            raise RecordError("ENTRY_EXISTS", id=values["id"])
        return values["id"]

    def change(self, table: str, key: str, edit: Callable[[dict], dict]) -> dict:
        """The next version of an entry: ``edit`` gets the newest and returns what changes. It is called again on what
        another writer put meanwhile; a folder of records that it wrote for nothing is deleted."""
        for n in range(TRIES):
            at = self._snapshot(table)[0]
            old = self.entry(table, key)
            if old is None:
                raise RecordError("DATASET_NOT_FOUND" if table == "datasets" else "NOT_FOUND", id=key)
            stamp = datetime.now(UTC).isoformat()
            new = old | {"updated_at": stamp, "at": stamp} | edit(old) | {"id": key, "version": old["version"] + 1}
            if self._snapshot(table)[0] < at + 2 and self._put(table, new):  # two snapshots on, files of versions may be gone
                return new
            if new.get("path") != old.get("path"):
                self._delete(new["path"])
            time.sleep(random.random() * 0.02 * 2 ** min(n, 6))
        raise RecordError("CONFLICT", "others kept changing the entry", id=key)

    def _delete(self, path: str) -> None:
        place, fs = _place(self.spark, f"{self.path}/{path}")
        fs.delete(place, True)

    def compact(self, name: str) -> int:
        """A new snapshot of a table, and its number. If another writer was first, theirs stands."""
        files = self._names(f"changes/{name}")
        number, pointer = self._snapshot(name)
        now, data = self._versions(name, files, pointer), f"snapshots/{name}/data-{uuid.uuid4().hex}"
        if name == "operations":
            now = now.orderBy(F.desc("at"), F.desc("id")).limit(LOGGED)
        now.coalesce(1 if len(files) < 100_000 else 16).write.parquet(f"{self.path}/{data}")
        if not put_once(self.spark, f"{self.path}/snapshots/{name}/{number + 1:09d}.json", json.dumps({"data": data, "merged": files})):
            self._delete(data)
            return number + 1
        for gone in pointer.get("merged", []):
            self._delete(f"changes/{name}/{gone}")
        return number + 1

    def save(self, name: str, kind: str, df: DataFrame, report: dict, source: str = "", status: str = "") -> str:
        """A data set's records and its entry, and the operation in the log."""
        key, stamp = uuid.uuid4().hex, datetime.now(UTC).isoformat()
        path = f"records/{key}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{path}")
        quality = int(report.get("overall", report.get("quality", 0)) or 0)
        status = status or ("ready_for_review" if report.get("ready") else "needs_review")
        self.add("datasets", id=key, name=name[:150], type=kind, source=source, records=report.get("records", 0), quality=quality, findings=report.get("findings"), status=status, path=path, history=[{"action": "created", "at": stamp}])
        self.add("operations", type="dataset_created", dataset_id=key, records=report.get("records", 0))
        return key

    def collect(self, name: str, text: str, kind: str = "auto", source: str = "manual", url: str | None = None) -> str:
        """A data set of a text, parsed by the service's rules; its columns are those of the records."""
        whole = self.spark.createDataFrame([(text,)], "text string")
        rows = service_text(whole, "text", kind, []).where("problem is null").select("id", "record")
        fields = [r["field"] for r in record_fields(rows, "record").orderBy("field").collect()]
        if not fields:
            raise RecordError("EMPTY_DATA")
        new = draft(rows.select(*[F.get_json_object("record", f"$['{f}']").alias(f) for f in fields]), fields, name, source=source)
        report = {"records": new["recordCount"], "quality": new["quality"]["quality"], "findings": sum(new["sensitive"].values())}
        key = self.save(new["name"], new["type"], new["df"], report, source, "collected")
        self.add("collections", type=source, url=url, dataset_id=key, status="completed")
        self.add("operations", type=f"{source}_collection", dataset_id=key, url=url, records=report["records"])
        return key

    def collect_url(self, url: str, name: str | None = None, get: Callable[[str], Page] = partial(fetch, profile="service")) -> str:
        """A data set of the page at ``url``, which a task fetches: JSON or CSV by its content type, text otherwise. A page
        has ``fetch.MAX_BYTES`` at most; many pages are a table's work (``pages.fetch_pages``)."""
        page = fetch_pages(self.spark.createDataFrame([(url,)], "url string"), get=get, tasks=1).first()
        if page["problem"]:
            raise SourceError(page["problem"], page["message"] or "", url=url)
        kind = next((k for k in ("json", "csv") if k in page["content_type"]), "text")
        return self.collect(name or f"Web Collection {datetime.now(UTC).date()}", page["text"], kind, "url", url)

    def load(self, key: str) -> DataFrame:
        found = self.entry("datasets", key)
        if found is None:
            raise RecordError("DATASET_NOT_FOUND", id=key)
        return self.spark.read.parquet(f"{self.path}/{found['path']}")

    def _figures(self, df: DataFrame) -> dict:
        """Records, score and sensitive values of a data set under the service's rules; each is one aggregation."""
        report = validate(df, df.columns, None, "service").first().asDict()
        found = sensitive_counts(df, df.columns, "service").agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("n")).first()["n"]
        return {"records": report["records"], "quality": int(report["quality"] or 0), "findings": found}

    def analyze(self, key: str) -> dict:
        """Scores the records anew."""

        def edit(old: dict) -> dict:
            figures = self._figures(self.spark.read.parquet(f"{self.path}/{old['path']}"))
            return {"quality": figures["quality"], "findings": figures["findings"], "history": [*old["history"], {"action": "analyzed", "at": datetime.now(UTC).isoformat()}]}

        new = self.change("datasets", key, edit)
        self.add("operations", type="dataset_analyzed", dataset_id=key, quality=new["quality"])
        return new

    def privacy_scan(self, key: str) -> dict:
        """Counts sensitive values and says whether someone has to look at them."""

        def edit(old: dict) -> dict:
            found = self._figures(self.spark.read.parquet(f"{self.path}/{old['path']}"))["findings"]
            return {"findings": found, "privacy": _privacy(found), "history": [*old["history"], {"action": "privacy_scan", "at": datetime.now(UTC).isoformat(), "findings": found}]}

        new = self.change("datasets", key, edit)
        self.add("operations", type="privacy_scan", dataset_id=key, findings=new["findings"])
        return new

    def _rewritten(self, key: str, how: Callable[[DataFrame, list[str], str], DataFrame], entry: Callable[[dict, dict, DataFrame], dict]) -> dict:
        def edit(old: dict) -> dict:
            rows = self.spark.read.parquet(f"{self.path}/{old['path']}")
            order = "row_order"
            while plain(order, True) in {plain(c, True) for c in rows.columns}:
                order += "_x"
            columns, path = rows.columns, f"records/{key}/{uuid.uuid4().hex}"
            out = how(rows.withColumn(order, F.monotonically_increasing_id()), columns, order)
            out.drop(plain(order, True)).write.parquet(f"{self.path}/{path}")
            figures = self._figures(self.spark.read.parquet(f"{self.path}/{path}"))
            return figures | {"path": path} | entry(old, figures, rows)

        return self.change("datasets", key, edit)

    def clean(self, key: str) -> dict:
        """Empty and equal records go, the rest is trimmed (``service_clean``); the history says how many went."""

        def entry(old: dict, figures: dict, rows: DataFrame) -> dict:
            full = rows.where(~is_empty_record(rows, rows.columns, "service")).count()
            step = {"action": "cleaned", "at": datetime.now(UTC).isoformat(), "before": old["records"], "removed_empty": old["records"] - full, "removed_duplicates": full - figures["records"], "after": figures["records"]}
            return {"status": "cleaned", "history": [*old["history"], step]}

        new = self._rewritten(key, service_clean, entry)
        self.add("operations", type="dataset_cleaned", dataset_id=key, records=new["records"])
        return new

    def prepare(self, key: str) -> dict:
        """Records as training takes them (``service_prepare``), for review; of their privacy first, if there are findings."""

        def entry(old: dict, figures: dict, rows: DataFrame) -> dict:
            status = "privacy_review_required" if figures["findings"] else "ready_for_review"
            return {"status": status, "privacy": _privacy(figures["findings"]), "history": [*old["history"], {"action": "prepared_for_training", "at": datetime.now(UTC).isoformat()}]}

        new = self._rewritten(key, service_prepare, entry)
        self.add("operations", type="dataset_prepared", dataset_id=key, records=new["records"], quality=new["quality"])
        return new

    def forget(self, key: str) -> int:
        """Deletes the records of a data set's earlier versions, and says how many folders; nobody may be reading them."""
        now = (self.entry("datasets", key) or {}).get("path", "")
        old = [f"records/{key}/{n}" for n in self._names(f"records/{key}") if f"records/{key}/{n}" != now]
        for path in old if now else []:
            self._delete(path)
        return len(old) if now else 0

    def operations(self, limit: int = 50) -> DataFrame:
        return top_operations(self.table("operations"), "at", "id", limit)

    def stats(self) -> DataFrame:
        return catalog_stats(self.table("datasets"))

    def set(self, name: str, value: str) -> None:
        if name == "validationLevel" and value not in LEVELS:
            raise RecordError("INVALID_LEVEL", f"level is one of {LEVELS}")
        new = {"value": json.dumps(value)}
        if self.entry("settings", name) is None:
            try:
                self.add("settings", id=name, **new)
                return
            except RecordError as e:
                if e.code != "ENTRY_EXISTS":
                    raise
        self.change("settings", name, lambda old: new)

    def settings(self) -> dict:
        return {r["id"]: json.loads(r["value"]) for r in self.table("settings").collect()}


def _privacy(findings: int) -> str:
    return "review-required" if findings else "no-obvious-findings"


def top_operations(df: DataFrame, at: str, key: str, limit: int = 50) -> DataFrame:
    """The newest entries, 1 to 200 of them; ties by key."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(min(max(int(limit), 1), 200))


def catalog_stats(datasets: DataFrame) -> DataFrame:
    """One row: data sets, their records, and the mean quality of those that have one, rounded."""
    mean = F.floor(F.avg(F.when(F.col("quality") > 0, F.col("quality"))) + 0.5)
    return datasets.agg(F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(mean, F.lit(0)).cast("long").alias("average_quality"))
