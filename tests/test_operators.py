import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import coerce, resources
from memloom.operators import advantage, banks, calls, checks, chunking, datasets, evaluation, retrieval, skew, splitting


def test_pack_by_hand(spark):
    def fold(sizes, target):
        out, held, chunk = [], 0, 0
        for n in sizes:
            if held and (held + n > target or held >= target):
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return out

    cases = {"a": [100, 100, 100, 300, 10], "b": [256, 1], "c": [200, 56, 56], "d": [0, 5, 0, 252], "e": [600]}
    df = spark.createDataFrame([(k, i, n) for k, v in cases.items() for i, n in enumerate(v)], "s string, i int, n int")
    got = {}
    for r in chunking.pack(df, ["s"], ["i"], F.col("n"), 256).orderBy("s", "i").collect():
        got.setdefault(r.s, []).append(r.chunk)
    assert got == {k: fold([n for n in v if n], 256) for k, v in cases.items()}


def test_critical_path(spark):
    df = spark.createDataFrame([("t", 0, 1, 2.0), ("t", 1, 1, 3.0), ("t", 2, 2, 1.0), ("t", 3, None, 0.5), ("t", 4, None, 0.25)], "trajectory string, call_index int, stage int, latency double")
    assert calls.critical_path(df, F.col("stage"), F.col("latency")).first().critical_path_latency == 4.75


@pytest.mark.parametrize("prompt,mask,want", [(10, [1, 1, 0, 0, 0, 1, 0], [(10, 2), (3, 1)]), (5, [0, 0], [(7, 0)]), (4, [1, 0, 1], [(4, 1), (1, 1)])])
def test_reuse_segments(spark, prompt, mask, want):
    rows = [("t", -1, 0, prompt)] + [("t", i, m, 1) for i, m in enumerate(mask)]
    df = spark.createDataFrame(rows, "t string, i int, m int, s int")
    got = calls.reuse_segments(df, ["t"], "i", F.col("m") == 1, F.col("s")).orderBy("segment").collect()
    assert [(r.input_tokens, r.output_tokens) for r in got] == want


def test_group_normalisation(spark):
    df = spark.createDataFrame([("a", -1.0, True), ("a", -3.0, True), ("b", 5.0, True), ("c", 5.0, False)], "g string, x double, m boolean")
    got = {(r.g, r.x): r.normalized for r in advantage.group_normalized(df, "g", "x", F.col("m")).collect()}
    assert got["a", -1.0] == pytest.approx(0.70710628) and got["a", -3.0] == pytest.approx(-0.70710628)
    assert got["b", 5.0] == 0 and got["c", 5.0] == 0  # a singleton, and a row outside the mask
    plain = {(r.g, r.x): r.normalized for r in advantage.group_normalized(df, "g", "x").collect()}
    assert plain["c", 5.0] == pytest.approx(5 / (1 + 1e-6)) and plain["a", -1.0] == pytest.approx(0.70710628)
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    got = sorted(r.whitened for r in advantage.masked_whitened(df, "x", F.lit(True)).collect())
    assert got == pytest.approx([-0.87287156, -0.21821789, 1.09108946])
    with pytest.raises(Exception, match="two values"):
        advantage.masked_whitened(df.limit(1), "x", F.lit(True)).collect()


def test_final_rows(spark):
    uids = ["a_0_0", "a_0_2", "a_0_1", "x", "b_1_0", "x", None, " ", None, "a_b_0_5 ", "a_b_0_7", "a_0_z", "a_0_2"]
    df = spark.createDataFrame([(k, "t" if k == 12 else "s", u) for k, u in enumerate(uids)], "pos int, source string, uid string")
    assert [r.pos for r in advantage.final_rows(df, "source", "uid", "pos").orderBy("pos").collect()] == [1, 3, 4, 6, 7, 8, 10, 11, 12]


def test_decoupled(spark):
    rows = [("a", 1.0, 2.0, True, True), ("a", 3.0, 4.0, True, True), ("a", 9.0, 9.0, True, False), ("b", 5.0, 1.0, False, True)]
    df = spark.createDataFrame(rows, "g string, task double, cost double, response boolean, ok boolean")
    got = {r.task: r.advantage for r in advantage.decoupled(df, "g", "task", {"cost": 1.0}, F.col("response"), {"cost": F.col("ok")}).collect()}
    fused = {1.0: 1 - 0.70710628, 3.0: 3 + 0.70710628, 9.0: 9.0}
    mean = sum(fused.values()) / 3
    var = sum((x - mean) ** 2 for x in fused.values()) / 2
    assert all(got[k] == pytest.approx((x - mean) / var**0.5, abs=1e-5) for k, x in fused.items()) and got[5.0] == 0
    for weights in ({"cost": -1.0}, {"cost": 0.0}):
        with pytest.raises(ValueError):
            advantage.decoupled(df, "g", "task", weights, F.col("response"))


def test_spans(spark):
    schema = "k int, spans array<struct<start:int,end:int>>, n int"
    rows = [(1, [(0, 2), (2, 5)], 5), (2, [(0, 3), (2, 5)], 5), (3, [(0, 6)], 5), (4, [(3, 3)], 5), (5, [], 0), (6, [(2, 3), (0, 1)], 5)]
    assert sorted(r.k for r in checks.span_order(spark.createDataFrame(rows, schema), "spans", F.col("n")).collect()) == [2, 3, 4, 6]


def test_coercion(spark):
    df = spark.createDataFrame([("Yes",), ("on",), ("2",), (None,), ("TRUE ",), ("1",)], "x string")
    assert [r[0] for r in df.select(coerce.as_bool(F.col("x"))).collect()] == [True, True, False, False, True, True]
    df = spark.createDataFrame([("3.7",), ("-2",), ("5",), (None,), ("x",)], "x string")
    assert [r[0] for r in df.select(coerce.nonnegative_int(F.col("x"))).collect()] == [0, 0, 5, 0, 0]
    assert [r[0].issue for r in df.select(coerce.audited_int(F.col("x"))).collect()] == ["fraction", "negative", None, "missing", "unparsable"]
    flag = coerce.present_bool(F.col("p"), F.col("v"), ~coerce.as_bool(F.lit("false")))
    df = spark.createDataFrame([(False, None), (True, None)], "p boolean, v string")
    assert [r[0] for r in df.select(flag).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(coerce.strict_bool(F.lit("maybe"))).collect()


def test_latency(spark):
    p = spark.createDataFrame([(0.332, 3e-6, 0.00664, 0.15)], "latency_base_seconds double, latency_input_seconds_per_token double, latency_output_seconds_per_token double, latency_image_seconds double").alias("p")
    assert p.select(resources.affine_latency("p", F.lit(2), F.lit(1000), F.lit(100), F.lit(1))).first()[0] == pytest.approx(1.481)


def test_banks(spark):
    rows = spark.createDataFrame([(1, "s", "c", None), (2, "s", "c", "k1"), (3, "s", "d", None)], "row int, ds string, conv string, ckpt string")
    provided = spark.createDataFrame([("s", "c", "k1", "bank")], "ds string, conv string, ckpt string, bank string")
    got = {r.row: r.bank for r in banks.attach_bank(rows, provided, ["ds", "conv"], "ckpt").collect()}
    assert got == {1: None, 2: "bank", 3: None}
    assert banks.missing_scopes(rows, provided, ["ds", "conv", "ckpt"]).count() == 2


def test_image_dedupe(spark):
    im = "struct<id:string,path:string,hf_repo_type:string,hf_repo_id:string,hf_filename:string,hf_revision:string>"
    rows = [[("a", "./x.png", None, None, None, None), ("b", "x.png", None, None, None, None), ("a", "y.png", None, None, None, None), ("c", "y.png", None, None, None, None), ("", "z\\q.png", None, None, None, None), ("", "z/q.png", None, None, None, None)]]
    df = spark.createDataFrame([(r,) for r in [*rows, []]], f"i array<{im}>")
    got = [[x.path for x in r[0]] for r in df.select(banks.dedupe_images(F.col("i"))).collect()]
    assert got == [["./x.png", "y.png", "z\\q.png"], []]


def test_flatten_items(spark):
    item = '[{"time": "t1", "text": "a", "turns": [{"user": "u", "assistant": "v"}, {"text": " "}, "plain"]}, {"messages": [{"content": "m", "date": "t2"}]}]'
    df = spark.createDataFrame([(1, item), (2, None), (3, "not json")], "k bigint, j string")
    got = [(r.id, r.item_text, r.item_time) for r in banks.flatten_items(df, "k", "j").orderBy("id", "position").collect()]
    assert got == [(1, "a", "t1"), (1, "u\nv", "t1"), (1, "plain", "t1"), (1, "m", "t2"), (3, "not json", "")]


def test_search_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    m = np.round(rnd.normal(size=(300, 8)), 1)
    df = spark.createDataFrame([(k, int(k % 3), [float(x) for x in v]) for k, v in enumerate(m)], "doc_id bigint, bank int, vector array<float>").repartition(5)
    q = df.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    docs = df.unionByName(spark.createDataFrame([(999, 0, None)], df.schema))
    for scope, block in ((None, 20_000), ("bank", 7)):
        got = {}
        for r in retrieval.top_k(q, docs, 4, scope=scope, block_queries=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for i in range(0, 300, 10):
            s = np.round(np.float32(m) .astype("float64") @ np.float32(m[i]).astype("float64"), 6)
            order = sorted((k for k in range(300) if scope is None or k % 3 == i % 3), key=lambda k: (-s[k], k))[:4]
            assert got[i] == order
    assert retrieval.top_k(q, docs, 0).count() == 0


def test_codec(spark):
    df = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<float>")
    back = df.select(retrieval.decode_vectors(retrieval.encode_vectors("v")).alias("b")).collect()
    assert [r.b for r in back] == [[0.5, -1.25], None]


@pytest.mark.parametrize("n,want", [(10, (7, 1, 2)), (3, (1, 1, 1)), (5, (3, 1, 1)), (25, (18, 2, 5))])
def test_group_split_sizes(spark, n, want):
    g = spark.createDataFrame([(f"c{k}", None) for k in range(n)], "c string, label string")
    got = {r.split: r["count"] for r in splitting.group_split(g, "c", "label", 0.7, 0.1, "13").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_group_split_keeps_labels(spark):
    g = spark.createDataFrame([("a", "test"), ("b", "val"), ("c", "train"), ("d", None)], "c string, label string")
    got = {r.c: r.split for r in splitting.group_split(g, "c", "label", 0.7, 0.1, "13").collect()}
    assert got["a"] == "test" and got["b"] == "val" and got["c"] == "train" and len(got) == 4


def test_group_split_refuses(spark):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", None), (4, None, None), (5, "", "val"), (6, "c", None)], "i int, c string, label string")
    g = splitting.split_groups(rows, "c", "i", F.col("label"))
    assert {r.group_key: r.conflict for r in g.collect()} == {"a": True, "b": False, "row 4": False, "row 5": False, "c": False}
    with pytest.raises(Exception, match="conflicting labels"):
        splitting.group_split(g, "group_key", "label", 0.7, 0.1, "13", "conflict").collect()
    assert splitting.group_split(g.filter("not conflict"), "group_key", "label", 0.7, 0.1, "13", "conflict").count() == 4
    for labels in ([None, None], ["train", "val"]):
        few = spark.createDataFrame(list(enumerate(labels)), "c int, label string")
        with pytest.raises(Exception, match="stays empty"):
            splitting.group_split(few, "c", "label", 0.7, 0.1, "13").collect()


def one_at_a_time(sizes, holdout, ratio):
    """Greatest marginal deficit first."""
    pairs = sum(n >= 2 for n in sizes.values())
    both = holdout >= pairs and sum(sizes.values()) - holdout >= pairs
    low = {s: int(both and n >= 2) for s, n in sizes.items()}
    free = [(j - n * ratio, s) for s, n in sizes.items() for j in range(low[s], n - low[s])]
    taken = sorted(free)[: holdout - sum(low.values())]
    return {s: low[s] + sum(t == s for _, t in taken) for s in sizes}


@pytest.mark.parametrize("sizes,holdout,ratio", [({"a": 10, "b": 5, "c": 1, "d": 22}, 8, 0.2), ({"a": 2, "b": 2, "c": 2, "d": 90}, 5, 0.05), ({f"s{k:02}": 1 + k % 3 for k in range(40)}, 9, 0.11), ({"a": 3, "b": 100}, 60, 0.2)])
def test_holdout_counts(spark, sizes, holdout, ratio):
    df = spark.createDataFrame(list(sizes.items()), "s string, n bigint")
    assert {r.s: r.held for r in splitting.holdout_counts(df, "n", holdout, ratio, ["s"]).collect()} == one_at_a_time(sizes, holdout, ratio)


def test_holdout_out_of_reach(spark):
    with pytest.raises(ValueError):
        splitting.holdout_counts(spark.createDataFrame([("a", 1)], "s string, n bigint"), "n", 2, 0.5, ["s"])


def test_stratified_split_keeps_all_strata(spark):
    df = spark.createDataFrame([(f"g{k}", f"s{k % 1500}") for k in range(4000)], "k string, s string")
    got = splitting.stratified_split(df, "k", ["s"], 0.7, 0.1, "13").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 2800, "val": 400, "test": 800}
    worlds = spark.createDataFrame([(f"g{k}", f"s{k % 4}") for k in range(38)], "k string, s string")
    got = splitting.stratified_split(worlds, "k", ["s"], 0.7, 0.1, "13").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 27, "val": 3, "test": 8}


def test_checks(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", " "), ("t", "a"), ("t", None)], "s string, k string")
    assert checks.blank_or_repeated(df, ["s"], "k").count() == 3
    with pytest.raises(ValueError, match="repeated"):
        checks.enforce(df, checks.blank_or_repeated(df, ["s"], "k"), "repeated")
    assert checks.enforce(df, df.limit(0), "fine") is df


def test_rotations(spark):
    df = spark.createDataFrame([(1, "right")], "k int, c string")
    got = datasets.rotations(df, "k", F.col("c"), F.array(F.lit("x"), F.lit("y"), F.lit("z"))).orderBy("rotation_index").collect()
    assert [(r.answer, r.choices[r.answer], len(set(r.choices.values()))) for r in got] == [(a, "right", 4) for a in "ABCD"]


def test_join_unique_keeps_hot_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), "id")
    dim = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("key"))
    out = skew.join_unique(rows, dim, "key", "n", 5000)
    assert out.count() == 5000 and out.filter("key = 'hot'").count() == 2000


def test_last_record_and_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {r.k: r.v for r in evaluation.last_record(df, "k", ["t"]).collect()} == {"a": "y", "b": "z"}
    df = spark.createDataFrame([("H2HMem-Dyadic",), (" other ",), (None,)], "s string")
    assert [r[0] for r in df.select(evaluation.reporting_source(F.col("s"))).collect()] == ["h2hmem", "other", "unknown"]


def test_positions_and_cutoffs(spark):
    rows = [("hot", k) for k in range(3000)] + [(f"k{k % 50}", k) for k in range(500)] + [(None, k) for k in range(5)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = {(r.k, r.i): r.position for r in skew.positions(df, ["k"], ["i"]).collect()}
    assert len(got) == len(rows)
    assert all(got["hot", k] == k for k in range(3000)) and all(got[f"k{k % 50}", k] == k // 50 for k in range(500)) and got[None, 4] == 4


def test_visible(spark):
    s = spark.createDataFrame([("c", f"s{k}", k) for k in range(1, 5)], "c string, session_id string, session_index int")
    cp = spark.createDataFrame([("c", 1, ["s2"]), ("c", 2, ["s3", "s1"]), ("c", 3, ["none"])], "c string, checkpoint int, covered array<string>")
    got = {}
    for r in chunking.visible_prefix(s, cp, ["c"]).collect():
        got.setdefault(r.checkpoint, set()).add(r.session_id)
    assert got == {1: {"s1", "s2"}, 2: {"s1", "s2", "s3"}}
    assert {r.checkpoint: r.sessions for r in chunking.visible_counts(s, cp, ["c"]).collect()} == {1: 2, 2: 3}
