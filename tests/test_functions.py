"""Scalar rules: golden inputs and a differential check against plain Python models."""

import hashlib
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import guards, names, text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, ["1,2", "007", "+5", "1e3", "1.", "--1", " 3.5 ", None, ""], text.as_number) == [12, 7, 5, None, None, None, 3.5, None, None]


def test_booleans(spark):
    assert values(spark, ["yes", "NO", " on ", "off", "1", "0", "maybe", None], text.as_boolean) == [True, False, True, False, True, False, None, None]


def test_empty_tokens(spark):
    assert values(spark, [" N/A ", "-", "nil", None, "x", " "], text.is_empty_token) == [True, True, True, True, False, True]


def test_whitespace_and_length(spark):
    assert values(spark, ["﻿ a  b　"], text.normalize_whitespace) == ["a b"]
    assert values(spark, ["a\U0001f600"], text.utf16_length) == [3]
    assert values(spark, ["ﬁ", None, "abc"], text.nfkc) == [unicodedata.normalize("NFKC", "ﬁ"), None, "abc"]


def test_csv_cell(spark):
    assert values(spark, ['a"b', "a,b", "a\nb", "plain", None], text.csv_cell) == ['"a""b"', '"a,b"', '"a\nb"', "plain", ""]


def test_fingerprint_is_of_sorted_json(spark):
    df = spark.createDataFrame([("x", None, 3)], "b string, a string, c long")
    assert df.select(text.fingerprint(["b", "a", "c"])).first()[0] == hashlib.sha256(b'{"a":null,"b":"x","c":3}').hexdigest()


@pytest.mark.parametrize("raw,clean", [(" First Name ", "first_name"), ("1st", "field_1st"), ("é-x-", "é-x"), ("", "field"), ("a__b", "a_b"), (None, "field"), ("a.b", "a_b")])
def test_field_names(raw, clean):
    assert names.normalized(raw) == clean


def test_unique_names():
    assert names.normalized_all(["A", "a", "a"]) == ["a", "a_2", "a_3"]
    assert names.sensitive(["id", "Api Key", "token", "token"]) == ["Api Key", "token"]
    assert names.file_name('a<b> c') == "a_b__c"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_names_are_stable(name):
    once = names.normalized(name)
    assert once and not once[0].isascii() or not once[:1].isdigit()
    if once.isascii():
        assert names.normalized(once) == once


@pytest.mark.parametrize("ip,expected", [("100.64.0.1", True), ("172.31.0.1", True), ("192.0.9.9", True), ("224.0.0.1", True), ("8.8.8.8", False), ("300.1.1.1", None), ("host", None)])
def test_addresses(spark, ip, expected):
    assert values(spark, [ip], guards.private_ipv4) == [expected]


def test_more_guards(spark):
    assert values(spark, ["fe80::1", "fd00::1", "2001:db8::1"], guards.private_ipv6) == [True, True, False]
    urls = ["http://example.com/a", "ftp://example.com", "http://u:p@example.com", "http://localhost/", "http://10.0.0.1/", "nothing", None]
    assert values(spark, urls, guards.url_problem) == [None, "UNSUPPORTED_PROTOCOL", "URL_CREDENTIALS_NOT_ALLOWED", "BLOCKED_HOST", "PRIVATE_ADDRESS", "INVALID_URL", "EMPTY_URL"]
    assert values(spark, ["text/html; charset=x", "image/png"], guards.allowed_type) == [True, False]


def test_record_json_keeps_nulls(spark):
    df = spark.createDataFrame([("x", None)], "b string, a string")
    assert json.loads(df.select(text.record_json(["b", "a"])).first()[0]) == {"b": "x", "a": None}
