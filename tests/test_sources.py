"""Readers, sinks and the file stream."""

import http.server
import json
import socket
import threading
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import names
from quarrymill.functions.errors import ExportError, RecordError, SourceError
from quarrymill.functions.text import nfkc
from quarrymill.operators import training
from quarrymill.plans import catalog, pipeline
from quarrymill.sources import fetch, lines, pages, readers, sinks
from quarrymill.sources.readers import Source
from quarrymill.streaming import files as stream


def one(spark, text):
    return spark.createDataFrame([(1, text)], "k int, text string")


def test_csv(spark):
    text = 'a, b ,,a\r\n"x, ""y""", 2 ,3,last\nshort\n\nl,o,n,g,er\n"open,1\n'
    rows = readers.parse_csv(one(spark, text), "text", ["k"]).orderBy("id").collect()
    assert [r["record"] for r in rows] == [
        {"b": "2", "column_3": "3", "a": "last"},
        {"b": "", "column_3": "", "a": ""},
        {"b": "o", "column_3": "n", "a": "g"},
        {"b": "", "column_3": "", "a": ""},
    ]


def test_csv_in_blocks_is_as_in_one_text(spark):
    blocks = ["", "\n \n", 'a, b ,,a\r\n"x, ""y""", 2 ,3,last\n', "short\r\r\n", "", "l,o,n,g,er\n\n", '"open,1\n']
    parts = [(k, i, b) for k in (1, None) for i, b in enumerate(blocks)] + [(2, 0, "x\n"), (2, 5, "1\n2"), (3, 0, "\n")]
    got = readers.csv_blocks(spark.createDataFrame(parts, "k int, i int, text string"), "text", ["k"], "i")
    whole = spark.createDataFrame([(1, "".join(blocks)), (None, "".join(blocks)), (2, "x\n1\n2"), (3, "\n")], "k int, text string")
    rows = lambda df: sorted((str(r["k"]), r["id"], sorted(r["record"].items())) for r in df.collect())
    assert rows(got) == rows(readers.parse_csv(whole, "text", ["k"])) and got.count() == 10


def test_csv_text_of_many_lines_takes_time_by_its_lines(spark):
    text = "k,name\n" + "".join(f'{i},"n, {i}"\n' for i in range(40_000))
    began = time.monotonic()
    rows = readers.parse_csv(one(spark, text), "text", ["k"])
    assert tuple(rows.agg(F.count("*"), F.max("id"), F.countDistinct(F.col("record")["name"])).first()) == (40_000, 40_000, 40_000)
    assert time.monotonic() - began < 60  # cutting the text anew for each line took far longer


def test_json(spark):
    got = [r["record"] for r in readers.json_records(one(spark, '[{"a":1},2,"x"]'), "text", ["k"]).orderBy("index").collect()]
    assert got == ['{"a":1}', '{"value":2}', '{"value":"x"}']
    assert readers.json_records(one(spark, "{bad"), "text", ["k"]).first()["problem"] == "INVALID_JSON"
    lines = readers.json_lines(one(spark, '{"a":1}\n\nbad\r\n{"a":2}'), "text", ["k"]).orderBy("line").collect()
    assert [(r["line"], r["problem"]) for r in lines] == [(1, None), (2, "INVALID_LINE"), (3, None)]


def test_html(spark):
    html = "<title>T &amp;lt; x</title><script>if (a) { '</p>' }</script><!-- c --><p>one<br>two&nbsp;three</p>"
    r = one(spark, html).select(readers.html_title(F.col("text")).alias("t"), readers.strip_html(F.col("text")).alias("x")).first()
    assert r["t"] == "T < x" and r["x"] == "T < x one two three"
    assert one(spark, "no title").select(readers.html_title(F.col("text"))).first()[0] == ""


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe" + "é\n\nb".encode("utf-16-le"))
    (tmp_path / "b.jsonl").write_bytes(b"\xef\xbb\xbf" + b'{"x":"1"}\n{"x":"2"}')
    (tmp_path / "c.csv").write_text('x,y\n" 1 ",2\n3\n')
    (tmp_path / "d.exe").write_bytes(b"MZ")
    path = f"file://{tmp_path}"
    assert [json.loads(r["record"])["text"] for r in readers.read(spark, Source("file", f"{path}/a.txt")).orderBy("id").collect()] == ["é", "b"]
    assert readers.read(spark, Source("file", f"{path}/b.jsonl")).count() == 2
    assert [tuple(r) for r in readers.read_csv(spark, [f"{path}/c.csv"]).orderBy("x").collect()] == [("1", "2"), ("3", "")]
    assert {r["type"]: r["problem"] for r in readers.files(spark, [path]).collect()} == {"text": None, "jsonl": None, "csv": None, None: "BLOCKED_EXTENSION"}
    for bad, code in (("x.exe", "BLOCKED_EXTENSION"), ("x.pdf", "UNSUPPORTED_EXTENSION")):
        with pytest.raises(SourceError) as e:
            readers.file_type(bad)
        assert e.value.code == code


def test_sources_to_data_set(spark):
    sources = [Source("json", '[{"a":"1","b":"x"},{"a":"1","b":"x"}]', "one"), Source("csv", "a,b\n2,y\n", "two"), Source("url", "http://x.test", "three")]
    done, steps = pipeline.process_sources(spark, sources, ["a", "b"])
    assert sorted((r["a"], r["b"]) for r in done.df.collect()) == [(1.0, "x"), (2.0, "y")]
    assert [s["status"] for s in steps if s["name"].startswith("collect:")] == ["completed", "completed", "failed"]


def test_fetch_guards():
    for url, code in (("ftp://a.test", "UNSUPPORTED_PROTOCOL"), ("http://u:p@a.test", "URL_CREDENTIALS_NOT_ALLOWED"), ("http://localhost", "BLOCKED_HOST")):
        with pytest.raises(SourceError) as e:
            fetch.fetch(url)
        assert e.value.code == code
    with pytest.raises(SourceError) as e:
        fetch.check_host("a.test", lambda *_: [(0, 0, 0, "", ("10.0.0.1", 0))])
    assert e.value.code == "PRIVATE_ADDRESS"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACME AI", 14, "Gaza"), (2, "Data AI", 15, "Palestine"), (3, "Test", 16, "Nablus")], "_row int, name string, age int, city string")
    assert sinks.to_string(df, "csv", "_row") == "name,age,city\nACME AI,14,Gaza\nData AI,15,Palestine\nTest,16,Nablus\n"
    assert sinks.to_string(df, "jsonl", "_row").count("\n") == 3
    assert json.loads(sinks.to_string(df, "json", "_row"))["recordCount"] == 3
    for form in sinks.FORMATS:
        assert sinks.write(df, f"file://{tmp_path}/{form}", form)["records"] == 3
    assert sinks.checksum(df, ["name"]) == sinks.checksum(df.repartition(3), ["name"])
    assert sinks.ordered_checksum(df, ["name"], "_row") == sinks.ordered_checksum(df.repartition(3), ["name"], "_row")
    with pytest.raises(ExportError):
        sinks.lines(df, "xlsx")


def test_exports_read_their_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(500).selectExpr("id", "concat('t', id) AS text", "if(id % 5 = 0, 'test', 'train') AS split")
    once = df.mapInArrow(counted, df.schema)
    path = f"file://{tmp_path}/out"
    done = sinks.write(once, path, "jsonl", ["id", "text"], most=10**6)
    assert read.value == 500 and done["bytes"] == sum(len(r.value) + 1 for r in spark.read.text(path).collect())
    plain = sinks.manifest(df, ["id", "text"], "jsonl", path)
    assert {k: v for k, v in done.items() if k != "exportedAt"} == {k: v for k, v in plain.items() if k != "exportedAt"}
    assert done["checksum"] == sinks.checksum(df, ["id", "text"]) and json.loads((tmp_path / "out" / "_manifest.json").read_text()) == done
    with pytest.raises(ExportError):
        sinks.write(df.limit(9), path, "jsonl", ["id", "text"], most=3)
    assert spark.read.text(path).count() == 500 and [p.name for p in tmp_path.iterdir()] == ["out"]  # what was there stays
    with pytest.raises(Exception):
        sinks.write(df.withColumn("text", F.expr("if(id = 77, raise_error('x'), text)")), f"file://{tmp_path}/bad", "jsonl")
    assert not (tmp_path / "bad" / "_manifest.json").exists()
    read.value = 0
    done = sinks.write_training(once, f"file://{tmp_path}", "set")
    assert read.value == 500 and done["splits"] == {"train": 400, "test": 100} and done["checksum"] == sinks.checksum(df, ["id", "text"])
    assert sinks.write_training(df.replace("test", "odd", "split"), f"file://{tmp_path}", "set")["splits"] == {"train": 400, "odd": 100}
    empty = sinks.write(df.limit(0), path, "csv", ["id"])
    assert (empty["records"], empty["bytes"], empty["checksum"]) == (0, 0, sinks.checksum(df.limit(0), ["id"]))


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_one_document_of_any_size(spark, tmp_path, n):
    df = spark.range(n).selectExpr("id * 37 % 3001 AS _row", "id", "concat('\u00e9', id, '\n,') AS text").repartition(7)
    size = sinks.write_document(df, f"file://{tmp_path}/all.json", "_row", head={"version": "1.0"})
    whole = json.loads((tmp_path / "all.json").read_text())
    want = [{"id": r["id"], "text": r["text"]} for r in df.orderBy("_row").collect()]
    assert whole == {"version": "1.0", "records": want} and size == (tmp_path / "all.json").stat().st_size
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["all.json"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"at":"2024-01-01T00:00:00","text":" a  b "}\n{"at":"2024-01-01T00:00:01","text":" a  b "}\n{"at":"2024-01-01T00:00:02","text":"n/a"}\n')
    rows = stream.cleaned(stream.read_stream(spark, f"file://{tmp_path}/in", "at timestamp, text string"), ["text"])
    stream.run(stream.first_within(rows, ["text"], "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    assert [r["text"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["a b"]


def test_training_files_and_export_upkeep(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "c", "test")], "_row int, text string, split string")
    done = sinks.write_training(df, f"file://{tmp_path}", "my set")
    assert done["splits"] == {"train": 2, "test": 1} and sinks.card(done)["records"] == 3
    assert spark.read.json(f"file://{tmp_path}/my_set/split=train").count() == 2
    assert sinks.inspect_export(spark, f"file://{tmp_path}/my_set").count() >= 2
    assert sinks.delete_export(spark, f"file://{tmp_path}/my_set") and not sinks.delete_export(spark, f"file://{tmp_path}/my_set")
    with pytest.raises(ExportError):
        sinks.inspect_export(spark, f"file://{tmp_path}/my_set")


def test_sniffing():
    assert readers.looks_like_csv("a,b\n1,2\n") and not readers.looks_like_csv("a,b\n1\n") and not readers.looks_like_csv("a\nb")
    assert readers.sanitized({"url": "x", "apiKey": "y", "Token": "z"}) == {"url": "x"}


def test_files_of_several_types(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1},{"x":2}]')
    (tmp_path / "b.csv").write_text("x\n3\n")
    (tmp_path / "c.txt").write_text("one\n\ntwo\n")
    paths = [f"file://{tmp_path}/{n}" for n in ("a.json", "b.csv", "c.txt", "d.exe")]
    with pytest.raises(SourceError):
        readers.read(spark, Source("file", paths))
    rows, report = readers.read_many(spark, paths)
    assert sorted(r["record"] for r in rows.collect()) == ['{"id":1,"text":"one"}', '{"id":2,"text":"two"}', '{"x":"3"}', '{"x":1}', '{"x":2}']
    assert sorted(r["success"] for r in report) == [False, True, True, True]
    assert [r["error"]["code"] for r in report if not r["success"]] == ["BLOCKED_EXTENSION"]
    assert readers.read_many(spark, paths[3:])[0] is None


def test_service_texts(spark):
    rows = [(1, ' [{"a":1},{"a":2}] '), (2, "{bad\nline"), (3, None), (4, "a,b\n1,2")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = lambda kind: sorted((r["k"], r["id"], r["record"], r["problem"]) for r in readers.service_text(df, "t", kind, ["k"]).collect())
    json_rows = [(1, 1, '{"a":1}', None), (1, 2, '{"a":2}', None)]
    assert got("auto") == json_rows + [(2, 1, '{"text":"{bad"}', None), (2, 2, '{"text":"line"}', None), (4, 1, '{"text":"a,b"}', None), (4, 2, '{"text":"1,2"}', None)]
    assert got("csv")[-1] == (4, 1, '{"a":"1","b":"2"}', None)
    assert [x[0] for x in got("json") if x[3] == "INVALID_JSON"] == [2, 4]


def test_several_formats_and_measured_steps(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "_row int, text string")
    done = sinks.write_all(df, f"file://{tmp_path}/all", ["json", "csv", "xlsx"])
    assert [(d["format"], d["success"]) for d in done] == [("json", True), ("csv", True), ("xlsx", False)] and done[0]["report"]["manifest"]["records"] == 2
    data, steps = pipeline.process_sources(spark, [Source("json", '[{"a":"1"}]', "one"), Source("odd", "", "two")], ["a"])
    report = pipeline.final_report(data, steps)
    assert report["failed"] == ["collect:two"] and all(s["durationMs"] >= 0 for s in steps) and report["quality"]["records"] == 1


def test_columns_of_rules(spark):
    df = spark.createDataFrame([("a,b\n1,2\n", "/x/a:b  c?.CSV", 5), ("a\nb", "x.exe", 0), (None, None, None)], "t string, p string, n long")
    rows = df.select(readers.sniffed_csv(F.col("t")), names.file_name_of(F.col("p")), readers.type_of(F.col("p")), readers.file_problem(F.col("p"), F.col("n"))).collect()
    assert [tuple(r) for r in rows[:2]] == [(True, "_x_a_b_c_.CSV", "csv", None), (False, "x.exe", None, "BLOCKED_EXTENSION")]
    assert rows[2][1] == "dataset" and names.file_name("a//b") == "a__b"


def test_descriptions_of_sources():
    assert readers.source_of("http://a.test").kind == "url"
    made = readers.source_of({"type": "JSON", "text": "[]", "name": "n", "token": "t"})
    assert (made.kind, made.value, made.name, made.options) == ("json", "[]", "n", {"text": "[]"})
    assert readers.source_of({"url": "http://a.test"}).kind == "url" and readers.source_of({}).kind == "unknown"
    with pytest.raises(SourceError):
        readers.source_of(3)
    assert readers.records_of({"collection": {"records": [1]}}) == [1] and readers.records_of({"records": [2]}) == [2]
    assert readers.records_of([3]) == [3] and readers.records_of("x") == []
    assert fetch.allowed("application/vnd.api+json", "service") and not fetch.allowed("application/vnd.api+json")


def test_drafts_collections_and_sizes(spark, tmp_path):
    df = spark.createDataFrame([(1, " a@b.test "), (2, None)], "_row int, Text string")
    new = pipeline.draft(df, ["Text"], "")
    assert new["name"].startswith("Dataset ") and new["recordCount"] == 2 and new["sensitive"] == {"email": 1} and new["df"].columns == ["text"]
    store = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    key = store.collect("mine", '[{"a":"1","b":"2"},{"a":"3"}]')
    assert sorted((r["a"], r["b"]) for r in store.load(key).collect()) == [("1", "2"), ("3", None)] and store.table("collections").count() == 1
    with pytest.raises(RecordError):
        store.collect("none", "  ")
    with pytest.raises(ExportError):
        sinks.write(df, f"file://{tmp_path}/big", "jsonl", most=3)
    assert json.loads(sinks.to_service_json(df, "_row", "n", "general", 7))["records"][1] == {"Text": None}
    steps = [{"name": "collect:a", "status": "completed"}, {"name": "collect:b", "status": "failed", "error": {}}, {"name": "clean", "status": "completed"}]
    assert pipeline.collection_report(steps) == {"success": True, "sources": 2, "read": 1, "failed": [{"name": "b", "error": {}}]}


def test_compatibility_form_and_shuffle(spark):
    texts = ["ﬁne ① Ａ", "e\u0301", "plain", None, "№ ½ ㎏"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", nfkc(F.col("t"))).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    state, numbers = 42, []
    for _ in range(30):
        state = (state * 1664525 + 1013904223) % 2**32
        numbers.append(state / 2**32)
    order = list(range(20))
    for i, x in zip(range(19, 0, -1), numbers, strict=False):
        j = int(x * (i + 1))
        order[i], order[j] = order[j], order[i]
    split = training.lcg_split(spark.range(20).withColumnRenamed("id", "k"), "k").orderBy("place").collect()
    assert [r["k"] for r in split] == order and [r["split"] for r in split] == ["train"] * 16 + ["validation"] * 2 + ["test"] * 2


def test_lines_of_large_files_are_read_by_many_tasks(spark, tmp_path):
    n = 40_000
    with open(tmp_path / "large file.jsonl", "w", newline="") as f:
        f.write("\ufeff")
        for i in range(n):
            f.write(f'{{"i": {i}}}' + ("\r\n" if i % 3 else "\n") + ("  \n\n" if i % 5 == 0 else ""))
    (tmp_path / "small.jsonl").write_bytes(b'\xff\xfe' + '\n{"i": 1}\n\n{"i": 2}'.encode("utf-16-le"))
    (tmp_path / "odd.jsonl").write_bytes(b'{"i": "\xff"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        paths = [f"file://{tmp_path}/{x}" for x in ("large file.jsonl", "small.jsonl", "odd.jsonl")]
        assert spark.read.text(paths[0]).rdd.getNumPartitions() > 8
        rows = lines.json_rows(lines.file_lines(spark, paths))
        got = rows.withColumn("i", F.get_json_object("record", "$.i")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    large = sorted((r["id"], int(r["i"])) for r in got if r["_path"].endswith("large file.jsonl"))
    assert large == [(i + 1, i) for i in range(n)]
    assert sorted((r["id"], r["i"]) for r in got if r["_path"].endswith("small.jsonl")) == [(1, "1"), (2, "2")]
    assert [r["i"] for r in got if r["_path"].endswith("odd.jsonl")] == ["\ufffd"] and all(r["problem"] is None for r in got)


def test_csv_lines_are_as_texts_are(spark, tmp_path):
    text = 'a, b ,,a\r\n"x, ""y""", 2 ,3,last\nshort\n\nl,o,n,g,er\n"open,1\n'
    (tmp_path / "a.csv").write_text(text, newline="")
    (tmp_path / "b.csv").write_text("a\n1\n")
    got = lines.csv_rows(lines.file_lines(spark, [f"file://{tmp_path}/{x}.csv" for x in "ab"])).collect()
    want = readers.parse_csv(one(spark, text), "text", ["k"]).select("id", F.to_json("record").alias("r")).collect()
    assert sorted((r["id"], r["record"]) for r in got if r["_path"].endswith("a.csv")) == sorted(map(tuple, want))
    assert [(r["id"], r["record"]) for r in got if r["_path"].endswith("b.csv")] == [(1, '{"a":"1"}')]


def test_failed_sources_are_steps(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a":"1"}\n{"a":"2"}\n')
    (tmp_path / "bad.jsonl").write_text('{"a":"3"}\n\n{"a":\n')
    (tmp_path / "empty.csv").write_text("")
    at = lambda x: f"file://{tmp_path}/{x}"

    def fetcher(url):
        raise TimeoutError("slow")

    sources = [
        Source("file", at("missing.json"), "missing"), Source("json", "{bad", "invalid"), Source("file", at("good.jsonl"), "good"), Source("file", at("bad.jsonl"), "lines"),
        Source("file", [at("good.jsonl"), at("empty.csv")], "two"), Source("url", "http://x.test", "page"), Source("odd", "", "odd"),
    ]
    data, steps = pipeline.process_sources(spark, sources, ["a"], fetcher=fetcher)
    assert sorted(r["a"] for r in data.df.collect()) == [1.0, 2.0]
    failed = {s["name"]: s["error"]["code"] for s in steps if s["status"] == "failed"}
    assert failed == {"collect:missing": "FILE_NOT_FOUND", "collect:invalid": "INVALID_JSON", "collect:lines": "INVALID_JSONL", "collect:two": "EMPTY_FILE", "collect:page": "FETCH_FAILED", "collect:odd": "UNSUPPORTED_SOURCE_TYPE"}
    assert [s["error"]["details"]["at"] for s in steps if s["name"] == "collect:lines"] == [2]
    assert [s["records"] for s in steps if s["name"] in ("collect:good", "collect:two")] == [2, 0, 2] or [s["records"] for s in steps if s["name"] in ("collect:good", "collect:two")] == [2, 2, 0]
    assert all(s["finishedAt"] >= s["startedAt"] for s in steps)
    with pytest.raises(RecordError) as e:
        pipeline.process_sources(spark, sources[:2], ["a"])
    assert e.value.code == "NO_SOURCES" and len(e.value.details["steps"]) == 2


def test_pages_are_fetched_by_tasks_from_the_address_that_was_checked(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            kinds = {"/a.json": "application/json", "/b.csv": "text/csv", "/p": "text/html; charset=latin-1", "/bin": "image/png", "/large": "text/plain"}
            bodies = {"/a.json": b'[{"a":1},{"a":2}]', "/b.csv": b"x,y\n1,2\n", "/p": "<title>T</title><p>caf\u00e9</p>".encode("latin-1"), "/bin": b"x", "/large": b"x" * 3000}
            path = self.path.split("?")[0]
            self.send_response(302 if path == "/away" else 200 if path in kinds else 404)
            if path == "/away":
                self.send_header("Location", "http://127.0.0.1/")
            self.send_header("Content-Type", kinds.get(path, "text/plain"))
            self.end_headers()
            self.wfile.write(bodies.get(path, b""))

        def log_message(self, *args): ...

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    seen = []

    def resolve(host, _):  # a public address first, the machine's own afterwards
        seen.append(host)
        return [(0, 0, 0, "", ("93.184.216.34" if len(seen) == 1 else "127.0.0.1", 0))]

    def dial(place, timeout):
        assert place == ("93.184.216.34", 80)
        return socket.create_connection(("127.0.0.1", port), timeout)

    assert fetch.fetch("http://rebinding.test/b.csv", resolve=resolve, dial=dial).text == "x,y\n1,2\n" and seen == ["rebinding.test"]
    with pytest.raises(SourceError) as e:
        fetch.fetch("http://rebinding.test/b.csv", resolve=resolve, dial=dial)
    assert e.value.code == "PRIVATE_ADDRESS"

    def get(url):
        def away(host, _):
            if host == "gone.test":
                raise socket.gaierror("no such host")
            return [(0, 0, 0, "", ("10.0.0.7" if host == "inside.test" else "93.184.216.34", 0))]

        def to_server(place, timeout):
            assert place[0] == "93.184.216.34"
            return socket.create_connection(("127.0.0.1", port), timeout)

        return fetch.fetch(url, most=2000, resolve=away, dial=to_server)

    want = {
        "http://one.test/a.json": None, "http://one.test/b.csv?q=a%20b": None, "http://two.test/p": None, "http://two.test/bin": "UNSUPPORTED_CONTENT_TYPE", "http://two.test/away": "REDIRECT_NOT_ALLOWED",
        "http://two.test/large": "RESPONSE_TOO_LARGE", "http://two.test/none": "HTTP_ERROR", "http://inside.test/p": "PRIVATE_ADDRESS", "http://gone.test/p": "DNS_FAILED", "ftp://one.test/": "UNSUPPORTED_PROTOCOL",
        "http://localhost/p": "BLOCKED_HOST", None: "EMPTY_URL", "http://u:p@one.test/": "URL_CREDENTIALS_NOT_ALLOWED",
    }
    urls = spark.createDataFrame([(u,) for u in want] * 2, "url string")
    found = pages.fetch_pages(urls, get=get, tasks=4)
    assert {r["url"]: r["problem"] for r in found.collect()} == want and found.count() == len(want)
    records = {(r["url"], r["id"]): r["record"] for r in pages.page_records(found.where("problem is null"), ["url"]).collect()}
    assert [json.loads(r) for _, r in sorted(records.items())] == [{"a": 1}, {"a": 2}, {"x": "1", "y": "2"}, {"title": "T", "text": "T caf\u00e9"}]
    data, steps = pipeline.process_sources(spark, [Source("url", "http://one.test/a.json", "good"), Source("url", "http://two.test/none", "bad")], ["a"], fetcher=get)
    assert sorted(r["a"] for r in data.df.collect()) == [1.0, 2.0]
    assert [(s["name"], s["status"], s.get("error", {}).get("code")) for s in steps[1:3]] == [("collect:good", "completed", None), ("collect:bad", "failed", "HTTP_ERROR")]
    server.shutdown()


def test_catalog_entries_change_in_versions(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    key = store.collect("mine", '[{"a":"1","b":" 2 "},{"a":"1","b":" 2 "},{"a":"","b":null},{"a":"1","b":"2"},{"a":"x@y.test","b":"3"}]')
    assert store.entry("datasets", key)["status"] == "collected"
    new = store.clean(key)
    step = new["history"][-1]
    assert (new["status"], new["version"], new["records"]) == ("cleaned", 2, store.load(key).count()) and step["before"] == 5 and step["removed_empty"] == 1
    assert step["before"] - step["removed_empty"] - step["removed_duplicates"] == step["after"] == new["records"]
    assert store.analyze(key)["findings"] == 1 and store.privacy_scan(key)["privacy"] == "review-required"
    last = store.prepare(key)
    assert last["status"] == "privacy_review_required" and [h["action"] for h in last["history"]] == ["created", "cleaned", "analyzed", "privacy_scan", "prepared_for_training"]
    assert sorted((r["a"], r["b"]) for r in store.load(key).collect()) == [("1", "2"), ("x@y.test", "3")]
    assert store.forget(key) == 2 and store.load(key).count() == 2
    assert [r["type"] for r in store.operations().orderBy("at").collect()] == ["dataset_created", "manual_collection", "dataset_cleaned", "dataset_analyzed", "privacy_scan", "dataset_prepared"]
    before = store.table("datasets").collect()
    assert store.compact("datasets") == 1 and store.table("datasets").collect() == before
    store.change("datasets", key, lambda old: {"name": "other"})
    assert store.compact("datasets") == 2 and store.table("datasets").first()["name"] == "other" and store.table("datasets").count() == 1
    assert len(store._names("changes/datasets")) == 1  # the first snapshot's five are gone
    with pytest.raises(RecordError):
        store.change("datasets", "none", lambda old: {})

    def get(url):
        return fetch.Page("a,b\n1,2\n", "text/csv", 8, "csv")

    other = store.collect_url("http://x.test/c", "web", get)
    assert [(r["a"], r["b"]) for r in store.load(other).collect()] == [("1", "2")] and store.table("collections").where("url is not null").count() == 1
    with pytest.raises(SourceError) as e:
        store.collect_url("http://localhost/c", "web", get)
    assert e.value.code == "BLOCKED_HOST"


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    key = store.add("projects", name="p", description="")
    calls, both = [], threading.Barrier(2)

    def write(mark):
        def edit(old):
            calls.append(mark)
            if calls.count(mark) == 1:
                both.wait(60)  # both have read the same version
            return {"description": old["description"] + mark}

        store.change("projects", key, edit)

    writers = [threading.Thread(target=write, args=(m,)) for m in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    now = store.entry("projects", key)
    assert sorted(now["description"]) == ["a", "b"] and now["version"] == 3 and len(calls) == 3
    first, again = f"file://{tmp_path}/once", spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    assert catalog.put_once(spark, first, "1") and not catalog.put_once(spark, first, "2") and (tmp_path / "once").read_text() == "1"
    (tmp_path / "aside").write_text("3")
    with pytest.raises(FileExistsError):
        catalog._rename(spark, again(f"file://{tmp_path}/aside"), again(first))
    catalog._rename(spark, again(f"file://{tmp_path}/aside"), again(f"file://{tmp_path}/fresh"))
    assert (tmp_path / "fresh").read_text() == "3" and (tmp_path / "once").read_text() == "1"
