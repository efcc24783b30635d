"""Traps of the text functions, with values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import ids, salvage, text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [(" a b ", "a b"), ("\u00a0\n\ta\u2003", "a"), ("\x1ca\x1f", "a"), ("", ""), (None, None), ("\u200ba", "\u200ba")])
def test_strip(spark, raw, want):
    assert one(spark, text.strip, raw) == want


def test_trim_middle(spark):
    long = "x" * 379 + "  " + "y" * 300 + " " + "z" * 99
    got = one(spark, lambda c: text.trim_middle(c, 500), long)
    assert got == "x" * 379 + "\n...[trimmed]...\n" + "z" * 99
    assert one(spark, lambda c: text.trim_middle(c, 500), None) == "" and one(spark, lambda c: text.trim_middle(c, 500), " " + "a" * 500 + "\n") == "a" * 500
    assert len(one(spark, lambda c: text.trim_middle(c, 500), "w " * 200_000)) < 520


def test_field_text_by_type(spark):
    df = spark.createDataFrame([([" a ", "", None, "b"], {"text": " t ", "answer": None}, (None, "q"), 7)], T.StructType([T.StructField("l", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.StringType())), T.StructField("s", T.StructType([T.StructField("answer", T.StringType()), T.StructField("text", T.StringType())])), T.StructField("n", T.IntegerType())]))
    r = df.select(*[text.field_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert (r.l, r.m, r.s, r.n) == ("a\n\nb", "", "", "7")  # a present but null key gives ''


@pytest.mark.parametrize("raw, want", [('{"text": " a ", "x": 1}', "a"), ('["a", " ", "b"]', "a\n\nb"), ('[{"answer": "z"}, "y"]', "z\n\ny"), (" plain {", "plain {"), ("{broken", "{broken"), (None, ""), ("", "")])
def test_json_field_text(spark, raw, want):
    assert one(spark, text.json_field_text, raw) == want


@pytest.mark.parametrize("raw, kind, want", [("gen 12", "string", 12), ("-3.7", "string", -3), ("", "string", None), (None, "string", None), ("99999999999999", "string", None), (2.9, "double", 2), (-2.9, "double", -2), (float("nan"), "double", None), (True, "boolean", None), (5, "long", 5)])
def test_parse_iteration(spark, raw, kind, want):
    dt = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType()}[kind]
    assert one(spark, lambda c: text.parse_iteration(c, dt), raw, kind) == want


@pytest.mark.parametrize("raw, want", [(".5", 1.0), ("8/10", 1.0), ("-0.3", 0.0), ("about 0.45", 0.45), ("none", 0.0), (None, 0.0)])
def test_score(spark, raw, want):
    assert one(spark, text.score, raw) == want


@pytest.mark.parametrize("raw, want", [(" Yes!", True), ("correctly", True), ("1", True), ("no", False), ("", False), (None, False)])
def test_flag(spark, raw, want):
    assert one(spark, text.flag, raw) == want


@pytest.mark.parametrize("raw, want", [(0.125, "0.12"), (0.285, "0.28"), (0.155, "0.15"), (-2.675, "-2.67"), (123456.785, "123456.79"), (float("nan"), None), (0.7, "0.70"), (1.0, "1.00"), (None, None)])
def test_two_decimals(spark, raw, want):
    assert one(spark, text.two_decimals, raw, "double") == want


def test_headings(spark):
    assert one(spark, text.canonical_heading, "**Final-Answer**") == "answer" and one(spark, text.canonical_heading, "quality") == "depth"
    assert one(spark, text.canonical_heading, "other") is None and one(spark, text.is_meta_heading, "Parent problem:") is True


def test_tail_and_bullets(spark):
    t = lambda n: one(spark, lambda c: text.tail(c, n), ["a", "b", "c"], "array<string>")
    assert t(2) == ["b", "c"] and t(5) == ["a", "b", "c"] and t(0) == t(None) == ["a", "b", "c"]
    assert one(spark, lambda c: text.bullet_block("T", c), [], "array<string>") == "T: none yet" and one(spark, lambda c: text.bullet_block("T", c), ["a"], "array<string>") == "T:\n- a"


def test_rules_by_name(spark):
    assert one(spark, text.reasoning_model, "openai/gpt-4") is True  # starts with o
    assert one(spark, text.takes_temperature, "x-gpt-5.4") is False
    assert one(spark, lambda c: text.token_budget(c, F.lit(3000)), "o1") == 12000 and one(spark, lambda c: text.token_budget(c, F.lit(10)), "o1") == 8192
    assert one(spark, text.retryable, "Missing API key") is False and one(spark, text.retryable, "timeout") is True and one(spark, text.retryable, None) is True


def test_contents(spark):
    df = spark.createDataFrame([([(" a", None), (None, "b"), (" ", "c"), (None, None)],)], "p array<struct<text:string,content:string>>")
    assert df.select(text.flat_content(F.col("p")).alias("x")).first().x == "a\nb"
    assert one(spark, lambda c: text.first_text(F.lit(" "), F.lit(None).cast("string"), c), " z ") == "z"


def test_ids(spark):
    want = hashlib.sha256("a\x1f\x1f1".encode()).hexdigest()[:16]
    assert one(spark, lambda c: ids.stable_id(c, None, 1), "a") == want


@pytest.mark.parametrize("raw, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": "}"} end', '{"a": "}"}'), ("x [1, 2] y", "[1, 2]"), ("none", None), ("{", None), (None, None), ("", None)])
def test_salvage(spark, raw, want):
    assert salvage.salvage(raw) == want
    df = spark.createDataFrame([(1, raw)], "k int, c string")
    assert salvage.salvage_column(df, "k", "c").first().json == want
