import json
import re
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from memloom.functions import judging, text as T
from memloom.functions.stemming import stem


def run(spark, rows, f, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(f(F.col("x")).alias("y")).collect()]


GOLD = [
    ("The cat and a dog.", "cat dog", "cat and dog", "cat and dog"),
    ("v1.2_x on 3/4", "v1.2_x on 3 4", "v1.2_x on 3 4", "v1.2 x on 3/4"),
    ("Plan A", "plan", "plan a", "plan a"),
    ("an answer: the", "answer", "answer the", "answer"),
    ("option a, b", "option b", "option a b", "option b"),
    (None, "", "", ""),
]


@pytest.mark.parametrize("k,f", [(1, T.normalize_d1), (2, T.normalize_d2)])
def test_dialects(spark, k, f):
    assert run(spark, [g[0] for g in GOLD], f) == [g[k] for g in GOLD]


def test_third_dialect(spark):
    # "a" goes only before a Latin word, so it stays before punctuation that became a space and a letter.
    got = run(spark, [g[0] for g in GOLD[:4]], T.normalize_d3)
    assert got == [g[3] for g in GOLD[:4]]


def by_hand(kind, s):
    t = (s or "").lower()
    word = lambda w: rf"(?<![^\W]){w}(?![^\W])"
    if kind == 3:
        out = []
        for i, c in enumerate(t):
            keep = c not in string.punctuation or (c in "./" and 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit())
            out.append(c if keep else " ")
        t = re.sub(r"\ba(?=\s+[a-z])", " ", "".join(out))
        return " ".join(re.sub(r"\b(an|the)\b", " ", t).split())
    t = re.sub(word("(?:a|an|the|and)"), " ", t) if kind == 1 else re.sub(r"\b(a|an|the)\s+(?=\w)", " ", t)
    out = []
    for i, c in enumerate(t):
        dot = c == "." and 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit()
        out.append(c if c == "_" or dot or c not in string.punctuation else " ")
    return " ".join("".join(out).split())


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAnNdthe .,_/-'1é中\t\n", max_size=25), min_size=5, max_size=30))
def test_dialects_by_hand(spark, texts):
    for kind, f in ((1, T.normalize_d1), (2, T.normalize_d2), (3, T.normalize_d3)):
        assert run(spark, texts, f) == [by_hand(kind, t) for t in texts]


def test_token_f1(spark):
    pairs = [("x x y", "x y y", 2 / 3), ("cat and dog", "cat dog", 0.8), ("", "", 0.0), ("a", "b", 0.0), ("a b", "a b", 1.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    tok = lambda c: T.tokens(F.col(c))
    got = [r[0] for r in df.select(T.f1_of_tokens(tok("a"), tok("b"))).collect()]
    assert got == pytest.approx([p[2] for p in pairs])
    assert df.filter("a = ''").select(T.f1_of_tokens(tok("a"), tok("b"), empty="equal")).first()[0] == 1.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6)), min_size=1, max_size=20))
def test_token_f1_by_hand(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for (a, b), r in zip(pairs, df.select(T.f1_of_tokens(F.col("a"), F.col("b")).alias("f")).collect()):
        n = sum((Counter(a) & Counter(b)).values())
        want = 0.0 if not a or not b or not n else 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b))
        assert r.f == pytest.approx(want)


def test_extraction(spark):
    texts = ["<tool_response><answer>z</answer></tool_response> ok <answer> a  b </answer>", "<answer>a</answer> tail", "<answer>a</answer><answer>b</answer>", "<answer></answer>", None]
    got = [(r["answer"], r["valid"]) for r in run(spark, texts, T.tagged_answer)]
    assert got == [("a b", True), (None, False), (None, False), ("", True), (None, False)]


def test_references(spark):
    texts = ['{"answers": ["a", " ", null, "b "]}', '{"answer": "B"}', "plain", '["x", "y"]', "{}", "", None, "7"]
    assert run(spark, texts, T.references) == [["a", "b"], ["B"], ["plain"], ["x", "y"], [], [], [], ["7"]]


def test_format_checks(spark):
    truth = json.dumps({"variant": "mcq", "answer": "B", "valid_choices": ["a", "B"]})
    df = spark.createDataFrame([("<answer>b</answer>",), ("<answer>C</answer>",), ("<answer>AB</answer>",), ("b",)], "x string")
    assert [r[0] for r in df.select(T.answer_format_valid(F.col("x"), F.lit(truth))).collect()] == [True, False, False, False]


def test_insufficient(spark):
    texts = ["", "Unknown", "I don't know", "it cannot be determined", "the red tent", "None of them", "n/a", "known"]
    assert run(spark, texts, T.is_insufficient) == [True, True, True, True, False, True, True, False]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("formalize", "formal"), ("adoption", "adopt"), ("controll", "control"), ("generalizations", "gener"), ("sky", "sky"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


def test_judging(spark):
    replies = ['```json\n{"score": 0.5, "reasoning": "r"}\n```', 'so {"score": 0.3}', "nothing", '{"score": 1, "label": "Good"}', '{"score": 0.2}']
    got = [(r["score"], r["label"], r["problem"]) for r in run(spark, replies, lambda c: judging.parsed_reply(c, "graded"))]
    assert got == [(0.5, "Partial", None), (None, None, "score out of domain"), (None, None, "no object"), (1.0, "Good", None), (None, None, "score out of domain")]
    world = ['{"evaluation_result": "omission", "reasoning": "r"}', '{"label": "Correct", "reasoning": "r", "score": 0}', '{"label": "Correct"}', '{"label": "x", "reasoning": "r"}']
    got = [(r["score"], r["label"], r["problem"]) for r in run(spark, world, lambda c: judging.parsed_reply(c, "world"))]
    assert got == [(0.0, "Omission", None), (None, None, "score disagrees"), (None, None, "no reasoning"), (None, None, "unknown label")]
    binary = ['{"answer_score": 1}', '{"score": 0, "label": "Correct"}', '[Scoring Rationale]: fine [JSON] {"score": 0}']
    got = [(r["score"], r["reasoning"], r["problem"]) for r in run(spark, binary, lambda c: judging.parsed_reply(c, "binary"))]
    assert got == [(1.0, "", None), (None, None, "label disagrees"), (0.0, "fine", None)]
    df = spark.createDataFrame([(0.2,), (0.25,), (0.74,), (0.75,), (None,)], "x double")
    assert [r[0] for r in df.select(judging.quantized(F.col("x"))).collect()] == [0.0, 0.5, 0.5, 1.0, None]


def test_small_tools(spark):
    assert run(spark, ["a b/c", "__", None, "x.y-z"], T.metric_component) == ["a_b_c", "unknown", "unknown", "x.y-z"]
    assert run(spark, ["key api_key=abc123, Bearer xyz.1 end"], T.redacted) == ["key api_key=[redacted], Bearer [redacted] end"]
    assert run(spark, [" a \r\n b\rc "], T.multiline) == ["a\nb\nc"]
    assert [r[0] for r in spark.createDataFrame([(1.25,), (float("nan"),), (None,)], "x double").select(T.fixed(F.col("x"), 1)).collect()][1:] == ["N/A", "N/A"]


def test_common_tokens_of_long_and_short_texts(spark):
    import random
    from collections import Counter

    rnd = random.Random(3)
    rows = [([rnd.choice("abcdefgh") for _ in range(n)], [rnd.choice("cdefghij") for _ in range(m)]) for n, m in ((0, 5), (3, 4), (40, 60), (300, 200), (1, 2000))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(T.common_tokens(F.col("a"), F.col("b")).alias("n"), T.f1_of_tokens(F.col("a"), F.col("b")).alias("f")).collect()
    for (a, b), r in zip(rows, got):
        n = (Counter(a) & Counter(b)).total()
        assert r.n == n and r.f == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)
