"""JSON documents case by case."""

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import decisions, documents


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def found(spark):
    cases = [
        ('{"a":true}', {"a": True}, True), ('{"a":"true"}', {"a": True}, False), ('{"a":1}', {"a": True}, False), ('{"a":"10"}', {"a": 10}, False), ('{"a":10}', {"a": "10"}, False),
        ('{"a":10.0}', {"a": 10}, True), ('{"a":1e1}', {"a": 10}, True), ('{"a":{"b":[1,{"c":null}]}}', {"a": {"b": [{"c": None}]}}, True), ('{"a":{"b":[1,{"c":0}]}}', {"a": {"b": [{"c": None}]}}, False),
        ('{"a":{}}', {"a": {}}, True), ('{"a":[]}', {"a": {}}, False), ('[1,2]', [2, 1, 1], True), ('[1,2]', [3], False), ('["x"]', "x", True), ('"x"', "x", True), ('{"x":1}', "x", False), ('{"a.b":1,"a\\"c":2}', {"a.b": 1, 'a"c': 2}, True),
        ('{"a":0.5}', {"a": 0.5}, True), ('{}', {}, True), ('{', {}, False), (None, {}, False), ('{"a":null}', {"a": None}, True), ('{}', {"a": None}, False), ('12345678901234567890', 12345678901234567890, True), ('12345678901234567891', 12345678901234567890, False),
    ]
    row = spark.range(1).select(*(documents.contains(F.lit(d).cast("string"), w).alias(f"c{i}") for i, (d, w, _) in enumerate(cases))).first()
    return [(c, row[i]) for i, c in enumerate(cases)]


def test_contains(found):
    assert [c for c, got in found if got is not c[2]] == []


def test_merges(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, documents.merged(a, b), a='{"x":1,"y":[1],"é\\"":"\\n"}', b='{"y":null}') == '{"x":1,"y":null,"é\\"":"\\n"}'
    assert one(spark, documents.merged(a, b), a=None, b='{"y":[]}') == '{"y":[]}' and one(spark, documents.merged(a, b), a="oops", b="3") == "{}"
    assert one(spark, documents.without(a, "x", "q"), a='{"x":1,"y":2}') == '{"y":2}'
    assert one(spark, documents.with_field(a, "x", F.lit("[]")), a="{}") == '{"x":[]}' and one(spark, documents.with_field(a, "x", F.lit("[]"), False), a="{}") == "{}"
    kept = documents.merged_provenance(a, b, "live")
    assert one(spark, kept, a='{"source":"live","rawText":"r"}', b='{"source":"web","rawText":"w","n":1}') == '{"n":1,"rawText":"r","source":"live"}'
    assert one(spark, kept, a='{"source":"live","rawText":"r"}', b='{"source":"live","rawText":"w"}') == '{"rawText":"w","source":"live"}'
    assert one(spark, kept, a='{"rawText":"r"}', b='{"rawText":"w"}') == '{"rawText":"w"}'


@pytest.mark.parametrize(
    "payload, record",
    [("[null,0,{\"a\":1}]", '{"a":1}'), ("[]", None), ('{"mp3":[]}', None), ('{"mp3":"x","data":{"a":1}}', '{"a":1}'), ('{"data":null,"result":[false,"y"]}', '"y"'), ('{"a":1}', '{"a":1}'), ("3", None), ("null", None), ("{", None), (None, None)],
)
def test_unwrapped(spark, payload, record):
    assert one(spark, documents.unwrapped(F.col("a")), a=payload) == record


def test_merged_list(spark):
    schema = "known array<struct<title:string,n:int,ok:boolean>>, seen array<struct<title:string,n:int,ok:boolean>>"
    a, a2, b, bad, none = ("A", 1, True), (" a ", 2, True), ("B", 1, True), ("C", 1, False), (None, 1, True)
    rows = spark.createDataFrame([([a, b], None), ([a, b], []), ([a], [a2, b, bad, none]), (None, [b, a]), ([a, none], [a, a2])], schema)
    lists = lambda full: [None if r.x is None else [(x.title, x.n) for x in r.x] for r in rows.select(documents.merged_list(F.col("known"), F.col("seen"), F.lit(full), lambda x: x["ok"]).alias("x")).collect()]
    assert lists(False) == [[("A", 1), ("B", 1)], [("A", 1), ("B", 1)], [(" a ", 2), ("B", 1)], [("B", 1), ("A", 1)], [(" a ", 2)]]
    assert lists(True) == [[("A", 1), ("B", 1)], [], [(" a ", 2), ("B", 1)], [("B", 1), ("A", 1)], [("A", 1), (" a ", 2)]]


def test_an_empty_button_is_told_from_none(spark):
    mark = lambda *buttons: decisions.message_fingerprint(F.lit(1), F.lit("x"), F.array(*(F.lit(b).cast("string") for b in buttons)), F.lit(None).cast("string"), F.lit(None).cast("string"))
    r = spark.range(1).select(mark("a", None).alias("a"), mark("a").alias("b"), mark("a", "").alias("c")).first()
    assert r.a != r.b and r.a == r.c
