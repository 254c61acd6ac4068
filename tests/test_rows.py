import json

import pytest
from pyspark.sql import functions as F

from memloom.operators import datasets, rows as R


def one(spark, column, **values):
    """The column over one row of the given text values."""
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "z int")
    return df.select(column.alias("y")).first().y


def test_reply_text(spark):
    r = lambda x: one(spark, R.reply_text(F.col("x")), x=x)
    assert r('{"choices": [{"message": {"content": "hi"}}]}') == "hi"
    assert r('{"choices": [{"message": {"content": [{"text": "a"}, {"image": 1}, {"text": "b"}]}}]}') == "a\nb"
    assert r('{"choices": []}') == "" and r("no json") == "" and r(None) == ""


def test_guards(spark):
    status = spark.createDataFrame([(400,), (500,), (None,)], "s int")
    assert [x.r for x in status.select(R.retryable(F.col("s")).alias("r")).collect()] == [False, True, True]
    assert one(spark, R.member(F.col("x"), ("token", "round")), x=" Token ") == "token"
    with pytest.raises(Exception, match="not one of"):
        one(spark, R.member(F.col("x"), ("token", "round")), x="word")
    with pytest.raises(Exception, match="must not be blank"):
        one(spark, R.required(F.col("x"), "name"), x="  ")
    paths = {"a/b.png": True, "../a": False, "/a": False, "a/../b": False, "C:\\x": False, "": False, "a..b/c": True}
    assert {p: one(spark, R.safe_path(F.col("x")), x=p) for p in paths} == paths


def test_ids_and_truths(spark):
    df = spark.createDataFrame([("c", 3, None), ("c", 3, "k")], "c string, n int, k string")
    assert [r.i for r in df.select(R.question_id(F.col("c"), F.col("n"), F.col("k")).alias("i")).collect()] == ["c_q0003", "c:k:Q003"]
    assert one(spark, R.answer_value(F.col("x")), x='["a ", "", "b"]') == "a, b"
    assert one(spark, R.answer_value(F.col("x")), x=" plain ") == "plain"
    assert json.loads(one(spark, R.answer_value(F.col("x")), x='{"b": 1}')) == {"b": 1}
    assert json.loads(one(spark, datasets.metadata_json({"b": F.lit(1), "a": F.col("x"), "c": F.lit(None)}), x="y")) == {"a": "y", "b": 1}


def test_texts(spark):
    assert one(spark, R.compressed_text(F.col("x")), x=" ") == "[empty]"
    assert one(spark, R.memory_view(F.col("x"), F.col("y")), x="a ", y=None) == "a"
    assert one(spark, R.external_result(F.col("x")), x="x </answer>") == "[invalid result]"
    assert one(spark, R.probe_solution(F.col("x")), x="<answer> a  b </answer> <answer>c") == "<answer>a b</answer>"
    assert one(spark, datasets.turn_text(F.lit("S1:2"), F.lit("user"), F.col("x"), F.lit("hi ")), x="Zoë") == "[Round S1:2]\nUser (Zoë): hi"
    assert one(spark, datasets.turn_text(F.lit("S1:2"), F.lit("user"), F.col("x"), F.lit(" ")), x="Zoë") == ""


def test_images(spark):
    df = spark.createDataFrame([(["p", "q"], ["c"], None)], "p array<string>, c array<string>, i array<string>")
    got = df.select(datasets.aligned_images(F.col("p"), F.col("c"), F.col("i")).alias("y")).first().y
    assert [(x.id, x.caption, x.path) for x in got] == [(None, "c", "p"), (None, None, "q")]


def test_specs(spark):
    specs = spark.createDataFrame([(1, "r", "p", None), (2, "r", "p", 5), (3, "s", "p", 7)], "pos int, route string, provider string, limit int")
    defaults = spark.createDataFrame([("p", 9)], "provider string, limit int")
    first = R.first_of_route(R.with_defaults(specs, defaults, "provider", ["limit"]), "route", "pos")
    assert {r.route: r["limit"] for r in first.collect()} == {"r": 9, "s": 7}


def test_calls_and_status(spark):
    df = spark.createDataFrame([(-1, None, float("nan")), (3, 2, -1.0)], "prompt_tokens int, completion_tokens int, memory_api_cost double")
    got = [(r.prompt_tokens, r.completion_tokens) for r in R.call_record(df).collect()]
    assert got == [(0, 0), (3, 2)]
    s = one(spark, R.format_status(F.col("x"), F.lit(False), F.lit(2)), x="<answer>a</answer>")
    assert (s.valid, s.errors) == (False, 3)


def test_banks_and_preview(spark):
    df = spark.createDataFrame([("raw", "small", True), ("raw", None, True), ("raw", "small", False)], "r string, c string, w boolean")
    assert [x.b for x in df.select(R.chosen_bank(F.col("c"), F.col("r"), F.col("w")).alias("b")).collect()] == ["small", "raw", "raw"]
    assert df.agg(R.preview(F.col("c"), 3).alias("p")).first().p == ["small"]
    q = spark.createDataFrame([("s", "c", "q1", "?", "t", "train", "{}"), ("s", "d", "q2", "?", "t", "train", "{}")], "src string, conv string, question_id string, question string, question_type string, split string, ground_truth string")
    b = spark.createDataFrame([("s", "c", "bank")], "src string, conv string, bank string")
    got = datasets.prepared_rows(q, b, ["src", "conv"]).collect()
    assert [(r.question_id, r.bank, r.extra_info.split, r.prompt[0].content) for r in got] == [("q1", "bank", "train", "?")]
