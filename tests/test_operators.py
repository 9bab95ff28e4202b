"""Operators on golden inputs, edge cases, and independence from partitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import ordering
from quarrymill.functions.errors import RecordError, TrainingError
from quarrymill.functions.ordering import placed
from quarrymill.functions.scratch import written
from quarrymill.operators import clean, dedup, mixed, privacy, profile, quality, training
from quarrymill.plans import catalog, pipeline

PEOPLE = [(1, "  ACME AI  ", "14", "test@example.com"), (2, "ACME AI", "14", "test@example.com"), (3, "   ", None, None)]


def people(spark):
    return spark.createDataFrame(PEOPLE, "r long, Name string, Age string, Email string")


def test_clean_golden(spark):
    out, figures = clean.clean_dataset(people(spark), ["Name", "Age", "Email"], "r")
    assert [(r["name"], r["age"], r["email"]) for r in out.collect()] == [("ACME AI", 14.0, "test@example.com")]
    f = figures.first()
    assert (f["before"], f["after"], f["removed_empty"], f["removed_duplicates"], f["changed_records"], f["retention_rate"], f["change_rate"]) == (3, 1, 1, 1, 2, 33, 67)


def test_clean_empty_table(spark):
    out, figures = clean.clean_dataset(people(spark).limit(0), ["Name", "Age", "Email"], "r")
    assert out.count() == 0 and figures.first()["retention_rate"] == 0


def test_process_golden(spark):
    df = spark.createDataFrame([(1, "  ACME AI  ", "14", "Gaza"), (2, "ACME AI", "14", "Gaza"), (3, "", "15", "")], "r long, Name string, Age string, City string")
    done = pipeline.process(df, ["Name", "Age", "City"], "r")
    assert done.df.count() == 2
    r = done.report
    assert (r["completeness"], r["uniqueness"], r["validity"], r["format"], r["privacy"], r["overall"], r["status"], r["ready"]) == (67, 100, 100, 100, 100, 92, "excellent", True)
    assert done.manifest()["status"] == "ready_for_review"


def test_dedup_keeps_first_whatever_the_partitions(spark):
    rows = [(i, f"v{i % 7}") for i in range(100)]
    results = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "r long, v string").repartition(n)
        results.append(sorted(r["r"] for r in dedup.deduplicate(df, ["v"], "r").collect()))
    assert results[0] == results[1] == list(range(7))
    once = dedup.deduplicate(spark.createDataFrame(rows, "r long, v string"), ["v"], "r")
    assert dedup.deduplicate(once, ["v"], "r").count() == once.count()


def test_duplicates_and_compare(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "r long, v string")
    assert sorted((r["index"], r["duplicate_of"]) for r in dedup.duplicates(df, ["v"], "r").collect()) == [(2, 1), (4, 3)]
    c = dedup.compare(df, df.where("r > 2"), ["v"]).first()
    assert (c["before_records"], c["after_records"], c["removed"], c["added"]) == (4, 2, 1, 0)


def test_dense_numbers_and_batches(spark):
    df = spark.range(0, 250, 1, 5).select((F.col("id") * 3).alias("k"))
    got = {r["k"]: r["n"] for r in placed(df, [F.col("k")], "n").collect()}
    assert got == {3 * i: i + 1 for i in range(250)}
    assert {r["batch"]: r["count"] for r in dedup.batches(df, "k", 100).groupBy("batch").count().collect()} == {0: 100, 1: 100, 2: 50}


def test_sensitive_traps(spark):
    rows = [(1, "\npassword: x"), (2, "password: x"), (3, "2024-01-01"), (4, "Bearer abc"), (5, "-----BEGIN RSA PRIVATE KEY-----"), (6, "épassword: x"), (7, None)]
    df = spark.createDataFrame(rows, "r long, v string")
    found = {(r["index"], r["type"]) for r in privacy.sensitive_values(df, ["v"], "r").collect()}
    assert found == {(2, "password"), (3, "phone"), (4, "bearer_token"), (5, "private_key"), (6, "password")}
    df = spark.createDataFrame([(1, "x")], "r long, password string")
    assert privacy.sensitive_values(df, ["password"], "r").count() == 0
    assert [r["field"] for r in privacy.privacy_check(df, ["password"], "r").collect()] == ["password"]


def test_scores_of_nothing(spark):
    r = quality.recommendations(quality.readiness(quality.validate(people(spark).limit(0), ["Name"]))).first()
    assert (r["records"], r["completeness"], r["overall"], r["ready"]) == (0, 0, 15, False) or r["records"] == 0
    assert "NO_RECORDS" in r["reasons"] and "NO_RECORDS" in r["recommendations"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 2.0), (3, None, 3.0)], "r long, v string, d double")
    p = {r["field"]: r for r in profile.field_profile(df, ["v", "d"]).collect()}
    assert (p["v"]["empty"], p["v"]["nulls"], p["d"]["empty"]) == (2, 1, 1)
    assert {r["field"]: r["types"] for r in profile.type_consistency(df, ["v", "d"]).collect()} == {"v": "null,string", "d": "null,number"}
    j = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"b":null}'), (3, "[1]"), (4, "5"), (5, "{bad")], "r long, j string")
    assert {(r["field"], r["type"]): r["records"] for r in profile.json_fields(j, "j").collect()} == {("a", "number"): 1, ("b", "string"): 1, ("b", "null"): 1}


@pytest.mark.parametrize("n,expected", [(0, (0, 0, 0)), (1, (0, 0, 1)), (10, (8, 1, 1)), (3, (2, 0, 1))])
def test_split_counts(n, expected):
    assert training.split_counts(n, training.normalize_splits()) == expected


def test_split_errors_and_lcg():
    assert training.normalize_splits(8, 1, 1) == (0.8, 0.1, 0.1)
    for bad, code in (((-1, 1, 1), "NEGATIVE_SPLIT"), ((0, 0, 0), "ZERO_SPLIT"), ((float("nan"), 1, 1), "INVALID_SPLIT")):
        with pytest.raises(TrainingError) as e:
            training.normalize_splits(*bad)
        assert e.value.code == code
    assert int(next(training.lcg(42)) * 2**32) == 1083814273
    assert training.permutation(2).tolist() == [1, 0]


@pytest.mark.parametrize("seed", [42, 0, float("nan"), 2**32 + 5])
def test_lcg_states_are_jumped_to(seed):
    numbers = training.lcg(seed)
    assert [next(numbers) for _ in range(300)] == (training.lcg_states(np.arange(1, 301), seed) / 2.0**32).tolist()


def test_lcg_split_of_more_rows_than_the_driver_shuffles(spark):
    n, numbers = 260_000, training.lcg(7)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        order[i], order[j] = order[j], order[i]
    got = training.lcg_split(spark.range(n).withColumnRenamed("id", "at"), "at", 7).orderBy("place").toArrow()
    assert got["place"].to_pylist() == list(range(n)) and got["at"].to_pylist() == order
    assert got["split"].to_pylist() == ["train"] * 208_000 + ["validation"] * 26_000 + ["test"] * 26_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_small_shuffles(spark, n):
    got = {r["place"]: r["at"] for r in training.shuffled(spark, n).collect()}
    assert [got[k] for k in range(n)] == training.permutation(n).tolist()


def test_training_golden(spark):
    df = spark.createDataFrame([(1, "Q1", "", "A1"), (2, "Q2", "c", "A2"), (3, "", "", "")], "r long, instruction string, input string, output string")
    records, rejected = training.prepare(df, ["instruction", "input", "output"], "r", "instruction")
    assert records.count() == 2 and rejected.count() == 0
    assert {r["split"]: r["count"] for r in records.groupBy("split").count().collect()} == {"train": 1, "test": 1}
    deal = {r["r"]: r["split"] for r in training.lcg_split(df.where("r < 3"), "r").collect()}
    assert deal == {2: "train", 1: "test"}
    with pytest.raises(TrainingError):
        training.transform(df, ["instruction"], "r", "other")


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, "bot", " ho "), (1, 2, "x", " "), (2, 0, "النظام", "s")], "c long, t int, role string, text string")
    got = {r["c"]: r["x"] for r in training.to_chat(df, "c", "t", "role", "text").select("c", training.chat_text(F.col("messages")).alias("x")).collect()}
    assert got == {1: "user: hi\nassistant: ho", 2: "system: s"}


def test_stratified_split_is_exact_within_groups(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"))
    got = {(r["g"], r["split"]): r["count"] for r in training.hash_split(df, "id", within=["g"]).groupBy("g", "split").count().collect()}
    assert got == {(g, s): n for g in range(4) for s, n in (("train", 20), ("validation", 2), ("test", 3))}


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    assert c.table("datasets").count() == 0
    key = c.save("n", "text", spark.range(3).toDF("x"), {"records": 3, "overall": 80, "ready": True})
    assert c.load(key).count() == 3 and c.stats().first()["average_quality"] == 80 and c.operations().count() == 1
    c.set("validationLevel", "strict")
    assert c.settings() == {"validationLevel": "strict"}
    with pytest.raises(RecordError):
        c.set("validationLevel", "none")
    with pytest.raises(RecordError):
        c.load("missing")


def test_duplicates_are_what_keep_first_drops(spark):
    rows = [(1, "a", 0), (1, "a", 0), (1, "a", 0), (2, "b", 0), (None, "b", 0), (None, "b", 1), (3, "c", 0), (1, "d", 1), (1, "d", 2), (None, None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "r long, v string, other long").repartition(3)
    found = dedup.duplicates(df, ["v"], "r").collect()
    assert sorted(((x["index"], x["duplicate_of"]) for x in found), key=str) == sorted([(1, 1), (1, 1), (None, 2), (None, 2), (1, 1), (None, None)], key=str)
    assert len(found) == df.count() - dedup.deduplicate(df, ["v"], "r").count()
    assert dedup.duplicates(df.where("false"), ["v"], "r").count() == 0


def test_places_of_sparse_and_other_keys(spark):
    rng = random.Random(0)
    keys = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)} | {*range(200), *(10**9 + i for i in range(100))})
    shuffled = rng.sample(keys, len(keys))
    df = spark.createDataFrame([(k, f"{k:020d}") for k in shuffled] + [(None, None)], "k long, s string")
    for column, want in (("k", keys), ("s", sorted(f"{k:020d}" for k in keys))):
        rows = placed(df, [F.col(column)], "n").orderBy("n").collect()
        assert [r["n"] for r in rows] == list(range(1, len(keys) + 2)) and [r[column] for r in rows] == [None, *want]
    nested = df.where("k is not null").select(F.struct("k", "s").alias("at"))
    rows = dedup.batches(nested, "at", 100).collect()
    assert all(r["batch"] == keys.index(r["at"]["k"]) // 100 for r in rows)
    assert placed(df.where("false"), [F.col("k")], "n").count() == 0


def test_places_share_the_work_whatever_the_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordering, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    n = 40_000
    df = spark.range(0, n, 1, 8).select(
        F.concat(F.lit("https://example.org/pages/"), F.xxhash64("id").cast("string")).alias("url"),
        F.struct(F.lit(0).alias("s"), F.lit("a file").alias("_path"), "id").alias("at"),
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("hot"),
        F.lit("x").alias("same"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for column in df.columns:
            rows = placed(df.select(column), [F.col(column)], "n")
            got = rows.orderBy("n").collect()
            assert [r["n"] for r in got] == list(range(1, n + 1))
            assert all(a[column] <= b[column] for a, b in itertools.pairwise(got))
            sizes = [r["count"] for r in seen[-1].groupBy(F.shiftrightunsigned("_place", 33)).count().collect()]
            assert len(sizes) > 1 and max(sizes) <= 2 * n / len(sizes), column
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keep_first_of_repeated_and_null_keys(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "b", 1), (None, "b", 2), (2, "b", 3), (None, "c", 4), (1, "d", 6), (1, "e", 7), (3, None, 8), (4, None, 9)]
    df = spark.createDataFrame(rows, "r long, v string, other long")
    got = sorted(((r["v"], r["r"], r["other"]) for r in dedup.deduplicate(df, ["v"], "r").collect()), key=str)
    assert got == sorted([("a", 1, 5), ("b", 2, 3), ("c", None, 4), ("d", 1, 6), ("e", 1, 7), (None, 3, 8)], key=str)
    within = dedup.deduplicate(df.where("r is not null"), ["v"], "r", ["r"]).collect()
    assert len(within) == 6 and dedup.deduplicate(df.limit(0), ["v"], "r").count() == 0
    again = sorted(((r["v"], r["r"], r["other"]) for r in dedup.deduplicate(df.repartition(3), ["v"], "r").collect()), key=str)
    assert again == got


def test_values_inside_of_containers(spark):
    df = spark.createDataFrame([(1, [" a  b ", "n/a"], {"k": " x "}, (" y ", [" z "])), (2, None, None, None)], "r long, v array<string>, m map<string,string>, s struct<a:string,b:array<string>>")
    out, _ = clean.clean_dataset(df, ["v", "m", "s"], "r")
    row = out.where("_row = 1").first()
    assert row["v"] == ["a b", ""] and row["m"] == {"k": "x"} and row["s"].asDict(True) == {"a": "y", "b": ["z"]}
    cut = clean.clean_value(F.lit("abcdef"), df.schema["v"].dataType.elementType, clean.CleanOptions(most=3))
    assert spark.range(1).select(cut).first()[0] == "abc"


def test_scores_of_json_records(spark):
    rows = [("a", '{"x":1}'), ("a", '{"x":1}'), ("a", '{"x":"1","password":"p"}'), ("a", "3"), ("a", "null"), ("b", '{"x":" "}'), ("b", "no json"), ("b", "{}"), ("b", '""')]
    df = spark.createDataFrame(rows, "g string, j string")
    got = {r["g"]: r for r in quality.validate_json(df, "j", ["g"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["records"], a["duplicates"], a["invalid"], a["fields"], a["structures"], a["mixed_fields"]) == (5, 1, 1, 2, 4, 1)
    assert (a["format"], a["validity"], a["completeness"], a["presence"]) == (100 - 15 - 3 - 10, 80, 40, 40)
    assert a["findings"] == 1 and b["invalid"] == 3 and (b["completeness"], b["presence"]) == (0, 25)
    whole = quality.validate_json(df, "j").first()
    assert whole["records"] == 9 and quality.validate_json(df.limit(0), "j").first()["records"] == 0
    found = {r["index"]: r["reason"] for r in quality.validity(df.withColumn("i", F.monotonically_increasing_id()), "j", "i").collect()}
    assert sorted(found.values()) == ["empty_object", "empty_string", "null_or_undefined", "null_or_undefined"]


def test_reports_before_and_by_mode(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "y")], "r long, text string, label string")
    seen = quality.preview(df, ["text"]).first()
    assert (seen["privacy_status"], seen["duplicates"]) == ("no-obvious-findings", 1)
    assert quality.strict_validate(df, ["text"]).first()["mode"] == "strict"
    report = training.statistics(df, ["text"], "classification", "r").first()
    assert (report["records"], report["characters"], report["classes"], report["most"]) == (3, 2, 2, 2)
    chats = df.select(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages"))
    assert training.statistics(chats, ["messages"], "chat", "r").first()["messages"] == 3


def test_mixed_values_are_converted_one_by_one(spark):
    texts = ['{"Age": "14", "age": "unknown", "Deep": {"a": [" 1,5 ", {"b": "Ａ  x"}]}}', '"  hi  "', "[1, \"2\"]", "3.50", '{"x": "n/a", "y": []}', "{bad", None, "{}", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "r long, json string")
    got = {x["r"]: (x["_record"], x["_problem"]) for x in mixed.clean_json(df, "json", clean.CleanOptions(remove_empty=False)).collect()}
    assert got == {
        0: ('{"age":14,"age_2":"unknown","deep":{"a":[15,{"b":"A x"}]}}', None), 1: ('{"text":"hi"}', None), 2: ('{"value":[1,2]}', None), 3: ('{"value":3.5}', None), 4: ('{"x":"","y":[]}', None),
        5: (None, "INVALID_JSON"), 6: (None, "INVALID_JSON"), 7: ("{}", None), 8: ('{"value":""}', None),
    }
    assert sorted(x["r"] for x in mixed.clean_json(df, "json").collect()) == [0, 1, 2, 3, 5, 6]
    flags = mixed.clean_json(df.limit(1).select(F.lit('{"a":"YES","b":"0"}').alias("json")), "json", clean.CleanOptions(normalize_booleans=True, normalize_numbers=False)).first()
    assert flags["_record"] == '{"a":true,"b":false}' and flags["_changed"]


def test_profile_of_any_structure(spark):
    texts = ['{"b": 1, "a": "x"}', '{"a": " ", "c": null}', "[1]", None, "{bad", '{"a": [], "b": {"d": 1}}', '{"a": "%s"}' % ("y" * 200), '{"a": true}']
    df = spark.createDataFrame(list(enumerate(texts)), "r long, json string").repartition(3)
    rows = {x["field"]: x for x in mixed.json_profile(df, "json", "r").collect()}
    a = rows["a"]
    assert (a["present"], a["missing"], a["empty"], a["non_empty"], a["completeness"], a["first_row"], a["first_pos"]) == (5, 3, 2, 3, 63, 0, 1)
    assert (a["n_string"], a["n_array"], a["n_boolean"], a["examples"]) == (3, 1, 1, ["x", "y" * 100, "true"])
    assert rows["b"]["examples"] == ["1", '{"d":1}'] and rows["b"]["first_pos"] == 0 and rows["c"]["n_null"] == 1 and rows["c"]["examples"] == []
    assert mixed.json_profile(df.where("false"), "json", "r").count() == 0
    shuffled = spark.range(50_000).select("id", F.lit('{"a": "x"}').alias("json"))
    plan = mixed.json_profile(shuffled, "json", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_findings_stop_after_the_record_that_reaches_the_limit(spark):
    rows = [(i, None if i % 3 == 0 else "x", float("nan") if i % 2 == 0 else 1.0) for i in range(300)] + [(7, "", None), (None, "", 1.0)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "i int, s string, d double").repartition(7)
    every = quality.value_findings(df, ["s", "d"], "i").collect()
    for most in (1, 5, 40, 10_000):
        got, total, want = quality.value_findings(df, ["s", "d"], "i", most).collect(), 0, []
        groups = {}
        for f in every:
            groups.setdefault(f["index"], []).append(f)
        for key in sorted(groups, key=lambda k: (k is not None, k or 0)):  # nulls first, as the engine sorts
            if total >= most:
                break
            want += groups[key]
            total += len(groups[key])
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert quality.value_findings(df.where("false"), ["s"], "i", 5).count() == 0
