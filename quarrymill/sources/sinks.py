"""Exports as JSON, JSON lines, CSV and text, with manifests and checksums."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrymill.functions.errors import ExportError
from quarrymill.functions.names import file_name
from quarrymill.functions.text import canonical_json, csv_line, record_json

FORMATS = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv", "txt": "text/plain"}


def columns_for(df: DataFrame, preferred: list[str] | None = None) -> list[str]:
    """Preferred columns first, each once, then the rest."""
    first = [c for c in dict.fromkeys(p.strip() for p in preferred or []) if c in df.columns]
    return first + [c for c in df.columns if c not in first and not c.startswith("_")]


def line(df: DataFrame, form: str, columns: list[str] | None = None) -> Column:
    """Each record as one line of the format."""
    columns = columns or columns_for(df)
    if form in ("json", "jsonl"):
        return record_json(columns)
    if form == "csv":
        return csv_line(columns)
    if form == "txt":
        return F.coalesce(F.col(columns[0]).cast("string"), F.lit("")) if len(columns) == 1 else record_json(columns)
    raise ExportError("UNSUPPORTED_FORMAT", f"format is one of {sorted(FORMATS)}")


def lines(df: DataFrame, form: str, columns: list[str] | None = None) -> DataFrame:
    """``value``: each record as one line of the format."""
    return df.select(line(df, form, columns).alias("value"))


def to_string(df: DataFrame, form: str, order: str, columns: list[str] | None = None, wrap: bool = True) -> str:
    """The whole export as one string, for small data sets; rows pass through the driver one partition at a time."""
    columns = columns or [c for c in columns_for(df) if c != order]
    rows = (r["value"] for r in lines(df.orderBy(order), form, columns).toLocalIterator())
    if form == "json":
        records = [json.loads(r) for r in rows]
        body = {"version": "1.0", "exportedAt": datetime.now(UTC).isoformat(), "recordCount": len(records), "records": records} if wrap else records
        return json.dumps(body, ensure_ascii=False, indent=2)
    head = [",".join(columns)] if form == "csv" else []
    return "".join(f"{r}\n" for r in [*head, *rows])


def write(df: DataFrame, path: str, form: str, columns: list[str] | None = None, most: int | None = None) -> dict:
    """A directory of part files in the format, and the manifest of it; CSV parts have a header each.

    The rows are read once: counts, bytes and checksum are observed by the job that writes. The manifest is published as
    ``_manifest.json`` in the directory once that job has committed, so what failed has none. If ``most`` is given, the
    parts are written beside the directory and take its place unless they are of more bytes; then what was there stays.
    """
    columns = columns or columns_for(df)
    value = line(df, form, columns)
    seen, target = Observation(), path.rstrip("/") if most is None else f"{path.rstrip('/')}._{uuid.uuid4().hex}"
    rows = df.observe(seen, *figures(value, columns))
    if form == "csv":
        cells = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
        cells.write.mode("overwrite").csv(target, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    else:
        rows.select(value.alias("value")).write.mode("overwrite").text(target)
    done = described(seen.get, columns, form, path)
    if most is not None:
        folder, fs = _folder(df.sparkSession, target)
        if done["bytes"] > most:
            fs.delete(folder, True)
            raise ExportError("OUTPUT_TOO_LARGE", bytes=done["bytes"], most=most)
        delete_export(df.sparkSession, path)
        if not fs.rename(folder, _folder(df.sparkSession, path)[0]):
            raise ExportError("EXPORT_FAILED", path=path)
    publish(df.sparkSession, f"{path.rstrip('/')}/_manifest.json", done)
    return done


def publish(spark, path: str, what: dict) -> None:
    """A small JSON file that is there whole or not at all: written under another name, then renamed."""
    draft, fs = _folder(spark, f"{path}._{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(what, ensure_ascii=False).encode()))
    out.close()
    target = _folder(spark, path)[0]
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise ExportError("EXPORT_FAILED", path=path)


def write_document(df: DataFrame, path: str, order: str, columns: list[str] | None = None, head: dict | None = None) -> int:
    """All records, by ``order``, in one JSON document of any size: ``head``'s members, then ``records``. Returns its bytes.

    Tasks write the records as sorted parts, whose bytes are then copied in their order through a buffer; no record is held by the driver. The document gets its name when it is whole. An
    empty table gives an empty list.
    """
    spark, columns = df.sparkSession, columns or [c for c in columns_for(df) if c != order]
    parts, draft = (f"{path}._{uuid.uuid4().hex}-{x}" for x in ("parts", "whole"))
    rows = df.orderBy(order).select(F.monotonically_increasing_id().alias("_at"), record_json(columns).alias("_json"))
    first = F.when(F.col("_at") == 0, "").otherwise(",\n")  # ranges are cut at keys that occur, so the first one isn't empty
    rows.select(F.concat(first, "_json").alias("value")).write.option("lineSep", " ").text(parts)
    folder, fs = _folder(spark, parts)
    files = sorted((str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.rsplit("/", 1)[-1])
    opened = json.dumps(head or {}, ensure_ascii=False)[:-1] + (", " if head else "") + '"records": [\n'
    whole = _folder(spark, draft)[0]
    out = fs.create(whole, True)
    out.write(bytearray(opened.encode()))
    copy, conf = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes, spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        source = fs.open(_folder(spark, file)[0])
        copy(source, out, conf, False)
        source.close()
    out.write(bytearray(b"\n]}\n"))
    out.close()
    fs.delete(folder, True)
    target = _folder(spark, path)[0]
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise ExportError("EXPORT_FAILED", path=path)
    return fs.getFileStatus(target).getLen()


def to_service_json(df: DataFrame, order: str, name: str, kind: str, quality: int) -> str:
    """The service's export of a small data set: its name, type, records, quality and time in one JSON object."""
    columns = [c for c in columns_for(df) if c != order]
    records = [json.loads(r["value"]) for r in lines(df.orderBy(order), "json", columns).toLocalIterator()]
    return json.dumps({"name": name, "type": kind, "records": records, "quality": quality, "exportedAt": datetime.now(UTC).isoformat()}, ensure_ascii=False, indent=2)


def write_all(df: DataFrame, path: str, forms: list[str] | None = None, columns: list[str] | None = None) -> list[dict]:
    """The data set in several formats below ``path``: for each whether it succeeded, with its report or its error."""
    out = []
    for form in forms or list(FORMATS):
        began = datetime.now(UTC)
        try:
            done = write(df, f"{path}/{form}", form, columns)
            out.append({"success": True, "format": form, "report": export_report(done, began)})
        except ExportError as e:
            out.append({"success": False, "format": form, "error": e.as_dict()})
    return out


def export_report(done: dict, began: datetime) -> dict:
    """The manifest of an export with its file, times and duration."""
    ended = datetime.now(UTC)
    file = {"path": done["path"], "name": done["fileName"], "bytes": done["bytes"], "checksum": done["checksum"]}
    return {"success": True, "format": done["format"], "file": file, "manifest": done, "startedAt": began.isoformat(), "finishedAt": ended.isoformat(), "durationMs": round((ended - began).total_seconds() * 1000)}


def figures(value: Column, columns: list[str]) -> list[Column]:
    """Aggregates of an export: records ``n``, bytes ``b`` of its lines, and sums ``s0`` to ``s4`` of the records' digests."""
    size = F.coalesce(F.sum(F.octet_length(value) + 1), F.lit(0)).alias("b")
    return [F.count(F.lit(1)).alias("n"), size, *digest_sums(columns)]


def digest_sums(columns: list[str]) -> list[Column]:
    digest = F.sha2(canonical_json(columns), 256)
    return [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(5)]


def described(seen: dict, columns: list[str], form: str, path: str) -> dict:
    """The manifest that ``figures`` make."""
    digest = hashlib.sha256(":".join([*[seen[f"s{i}"] for i in range(5) if seen[f"s{i}"] is not None], str(seen["n"])]).encode()).hexdigest()
    return {"format": form, "mimeType": FORMATS[form], "path": path, "fileName": f"{file_name(path.rstrip('/').rsplit('/', 1)[-1])}", "records": seen["n"], "bytes": seen["b"], "columns": columns, "checksum": digest, "exportedAt": datetime.now(UTC).isoformat()}


def manifest(df: DataFrame, columns: list[str], form: str, path: str) -> dict:
    """Counts, sizes and a checksum that doesn't depend on partitions; one pass over the rows."""
    return described(df.agg(*figures(line(df, form, columns), columns)).first().asDict(), columns, form, path)


def checksum(df: DataFrame, columns: list[str]) -> str:
    """SHA-256 over the sums of the records' digests: any order and any partitions give the same value."""
    names = [f"s{i}" for i in range(5)]
    return df.agg(*digest_sums(columns), F.count(F.lit(1)).cast("string").alias("n")).select(F.sha2(F.concat_ws(":", *names, "n"), 256)).first()[0]


def ordered_checksum(df: DataFrame, columns: list[str], order: str) -> str:
    """SHA-256 of the records as one canonical JSON array in order; sequential by definition, streamed by the driver."""
    digest, first = hashlib.sha256(b"["), True
    for row in df.select(order, canonical_json(columns).alias("j")).orderBy(order).toLocalIterator():
        digest.update((("" if first else ",") + row["j"]).encode())
        first = False
    digest.update(b"]")
    return digest.hexdigest()


def write_training(records: DataFrame, path: str, name: str = "training", split: str = "split", splits: tuple[str, ...] = ("train", "validation", "test")) -> dict:
    """One directory of JSON lines a split, and a manifest of rows by split.

    One pass over the records: the job that writes them counts those of ``splits``; only if there are others are rows
    counted by split once more. The manifest is published in the directory after that job has committed.
    """
    columns = [c for c in records.columns if c != split and not c.startswith("_")]
    base, seen = file_name(name), Observation()
    count = [F.count_if(F.col(split) == s).alias(f"split{i}") for i, s in enumerate(splits)]
    rows = records.observe(seen, F.count(F.lit(1)).alias("n"), *count, *digest_sums(columns))
    rows.select(record_json(columns).alias("value"), split).write.mode("overwrite").partitionBy(split).text(f"{path}/{base}")
    got = seen.get
    found = {s: got[f"split{i}"] for i, s in enumerate(splits) if got[f"split{i}"]}
    if sum(found.values()) < got["n"]:
        found = {r[split]: r["n"] for r in records.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}
    digest = described(got | {"b": 0}, columns, "jsonl", path)["checksum"]
    out = {"name": base, "path": f"{path}/{base}", "columns": columns, "splits": found, "records": got["n"], "checksum": digest, "createdAt": datetime.now(UTC).isoformat()}
    publish(records.sparkSession, f"{path}/{base}/_manifest.json", out)
    return out


def card(manifest: dict, statistics: dict | None = None) -> dict:
    """What a reader of the training data needs first: rows by split, fields, checksum, statistics."""
    splits = manifest["splits"]
    return {
        "name": manifest["name"], "records": manifest["records"], **{s: splits.get(s, 0) for s in ("train", "validation", "test")},
        "fields": manifest["columns"], "checksum": manifest.get("checksum"), "statistics": statistics or {}, "generatedAt": manifest.get("createdAt"),
    }


def _folder(spark, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def inspect_export(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of an export."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        raise ExportError("EXPORT_NOT_FOUND", path=path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def delete_export(spark, path: str) -> bool:
    """Remove an export; false if there was none."""
    folder, fs = _folder(spark, path)
    return bool(fs.exists(folder) and fs.delete(folder, True))
