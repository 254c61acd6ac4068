import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import splits

TARGETS = [("train", 0.7), ("val", 0.1), ("test", 0.2)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "split string, target_share double")


def test_spellings_of_one_conversation(spark):
    rows = [
        (1, "memlens_32k", "conv-01", "train"),
        (2, "MemLens-64K ", " CONV_01", " Test"),
        (3, "memlens", "conv 01\t", None),
        (4, "memeye", "conv-01", "val"),
        (5, None, "conv-01", "test"),
        (6, "memeye", "  ", "train"),
        (7, "memeye", None, "test"),
        (8, "memeye", "conv-02", "dev"),
        (9, "memeye", "conv-02", "Validation"),
        (9, "memeye", "conv-02", "bogus"),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, dataset_source string, conversation_id string, split string")
    args = (df, "row_id", ["dataset_source", "conversation_id"], splits.question_entities(df))
    assert sorted(r.row_id for r in splits.split_conflicts(*args, splits.split_label(F.col("split"))).collect()) == [1, 2, 3]
    got = splits.assign_splits(df, targets(spark), *args[1:], F.col("dataset_source")).collect()
    assert len(got) == len(rows)
    split = collections.defaultdict(set)
    for r in got:
        split[r.row_id].add(r.split)
    assert split[1] == split[2] == split[3] and len(split[9]) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, dataset_source string, conversation_id string, split string")
    args = (df, "row_id", ["dataset_source", "conversation_id"], splits.question_entities(df))
    assert splits.split_conflicts(*args, splits.split_label(F.col("split"))).count() == 0
    assert splits.assign_splits(df, targets(spark), *args[1:], F.col("split")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_over_two_entities(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice([None, *"abcdefghijkl"]), rnd.choice([None, *map(str, range(14))])) for k in range(40)]
    # A chain, the worst case of label propagation.
    rows += [(100 + k, f"x{k}", f"y{k // 2}") for k in range(16)] + [(200 + k, f"x{k}", f"y{(k + 1) // 2}") for k in range(16)]
    df = spark.createDataFrame(rows, "id bigint, author string, source string")
    entities = [F.concat(F.lit("a:"), "author"), F.concat(F.lit("s:"), "source")]
    nodes = splits.grouped_nodes(df, "id", ["author", "source"], entities)
    labels = {r.spelling: r.label for r in splits.propagate(nodes).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, s in rows:
        if a and s:
            parent[find("a" + a)] = find("s" + s)
    want = collections.defaultdict(set)
    for i, a, s in rows:
        if a or s:
            want[find("a" + a if a else "s" + s)].add(i)
    spelled = df.select("id", splits._spelling(["author", "source"]).alias("spelling")).collect()
    got = collections.defaultdict(set)
    for r in spelled:
        if r.spelling in labels:
            got[labels[r.spelling]].add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_hot_group_and_shares(spark):
    rnd = random.Random(5)
    rows = [(k, "memeye", "hot" if k % 10 < 3 else f"c{int(rnd.paretovariate(1))}", rnd.choice("pqr")) for k in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, dataset_source string, conversation_id string, kind string")
    got = splits.assign_labelled(df, targets(spark), "row_id", ["dataset_source", "conversation_id"], splits.question_entities(df), F.col("kind"))
    by = got.join(df, "row_id").groupBy("conversation_id").agg(F.countDistinct("split").alias("n")).filter("n > 1")
    assert by.count() == 0
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(n.values()) == 3000
    report = {r.split: r for r in splits.split_report(got, targets(spark)).collect()}
    assert report["train"].rows == n["train"] and report["val"].max_label_deviation < 0.1
    with pytest.raises(ValueError, match="positive share"):
        splits.assign_splits(df, targets(spark).limit(0), "row_id", ["conversation_id"], [F.col("conversation_id")], F.col("kind"))


def test_greedy_reaches_targets():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 5, (2000, 6))
    chosen = splits.assign_units(sizes, np.array([0.7, 0.1, 0.2]))
    for s, share in enumerate((0.7, 0.1, 0.2)):
        assert abs(sizes[chosen == s].sum() / sizes.sum() - share) < 0.002
        assert np.abs(sizes[chosen == s].sum(axis=0) / sizes.sum(axis=0) - share).max() < 0.01


def test_report_is_over_all_labels(spark):
    rows = [(k, f"g{k}", "train", f"l{k % 1000}") for k in range(2000)] + [(2000, "g", "test", "rare")]
    got = splits.split_report(spark.createDataFrame(rows, "id bigint, group_id string, split string, label string"), targets(spark))
    report = {r.split: r for r in got.collect()}
    assert report["test"].max_label_deviation == pytest.approx(2000 / 2001)
    assert report["train"].rows == 2000 and report["val"].rows == 0


def test_all_labels_and_many_small_groups(spark):
    # 300 labels, most of them rare, and more groups than any number of units on the driver.
    rows = [(k, f"c{k // 2}", f"l{min((k // 2) % 6000, 299)}") for k in range(24_000)] + [(100_000 + k, None, f"l{k % 300}") for k in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, c string, kind string")
    got = splits.assign_labelled(df, targets(spark), "row_id", ["c"], [F.col("c")], F.col("kind"))
    assert got.count() == len(rows) and got.join(df.filter("c is not null"), "row_id").groupBy("c").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert all(abs(n[s] / len(rows) - x) < 0.01 for s, x in TARGETS)
    label = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert all(abs(label["l299", s] / sum(label["l299", t] for t, _ in TARGETS) - x) < 0.01 for s, x in TARGETS)


def test_large_groups_leave_the_rest_to_small_ones(spark):
    rows = [(k, "hot", "q") for k in range(3000)] + [(3000 + k, f"c{k}", "q") for k in range(7000)]
    df = spark.createDataFrame(rows, "row_id bigint, c string, kind string")
    got = splits.assign_labelled(df, targets(spark), "row_id", ["c"], [F.col("c")], F.col("kind"))
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert all(abs(n[s] / 10_000 - x) < 0.002 for s, x in TARGETS)
