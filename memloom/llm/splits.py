"""Splits that keep related records together.

Method. Records and the entities they name form a bipartite graph. Every record carries the least record id it
knows of; in each round an entity takes the least label of its records and a record the least of its entities,
then labels jump to their own label, until nothing changes. Records with one label are one group. Groups are then
assigned to splits so that each label's rows reach the targets: large groups one by one, in order of size, each to the split in which it
leaves the least squared deviation of the label counts from the targets; the other groups, stratified by their commonest label, by a cut of the
stratum's running sum of sizes at what the large groups left of its targets.

Plan. Records that name the same entities alike are one node (map-side counts), so a conversation with a third of
all rows is one node of the graph. Groups above 1 / ``LARGE`` of all rows, at most ``LARGE`` by definition, come to the driver with their rows by
label; labels below 1 / ``LARGE`` of the rows are one label there, and there only. All other groups, of any number, are placed by distributed
running sums, which know every label. A stratum's cut starts at a place of its own, so strata of a single group are not all cut
alike. Rounds are cut by checkpoints in the shared folder.

Defined results: a record that names no entity (all null or blank) is a group of its own; a null id in such a
record stands for one group of all of them; repeated rows count again; an empty table gives no rows; labels that are
null count as the label ''. Only the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.skew import join_unique, running_sum
from memloom.session import cut_lineage

#: Groups that are assigned one by one, at most.
LARGE = 5_000
SPLITS = ("train", "val", "test")


# The benchmarks whose editions share conversations.
BENCHMARKS = ("memgallery", "memeye", "memlens", "h2hmem", "worldmemarena")


def benchmark(source: Column) -> Column:
    """The benchmark a source names, whatever its spelling and edition; null if it names none."""
    s = F.regexp_replace(F.lower(source), r"(?U)[^\p{Alnum}]", "")
    named = F.coalesce(*[F.when(s.startswith(b), F.lit(b)) for b in BENCHMARKS], s)
    return F.when(s != "", named)


def conversation_key(conversation: Column) -> Column:
    """Without letter case, white space, ``-`` and ``_``; null if nothing is left."""
    s = F.regexp_replace(F.lower(conversation), r"(?U)[\s_-]+", "")
    return F.when(s != "", s)


def split_label(split: Column) -> Column:
    s = F.regexp_replace(F.lower(split), r"(?U)^\s+|\s+$", "")
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("val", "valid", "validation", "dev"), "val")
        .when(s == "test", "test")
    )


def question_entities(df: DataFrame) -> list[Column]:
    """The one entity a question names: its conversation."""
    b, c = benchmark(F.col("dataset_source")), conversation_key(F.col("conversation_id"))
    return [F.when(b.isNotNull() & c.isNotNull(), F.concat_ws("/", b, c))]


def _spelling(columns: list[str]) -> Column:
    """One text per combination of the columns as they are written."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"k{k}") for k, c in enumerate(columns)]))


def grouped_nodes(df: DataFrame, id_col: str, written: list[str], entities: list[Column], bits: Column | None = None) -> DataFrame:
    """One row per combination of ``written`` columns that names an entity: spelling, node (least id), entities,
    n (rows) and bits (bitwise or of ``bits``)."""
    e = F.array_sort(F.array_distinct(F.filter(F.array(*entities), lambda x: x.isNotNull())))
    slim = df.select(F.col(f"`{id_col}`").alias("id"), _spelling(written).alias("spelling"), e.alias("entities"), (bits if bits is not None else F.lit(0)).alias("bits"))
    return (
        slim.filter(F.size("entities") > 0)
        .groupBy("spelling", "entities")
        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("bits"))
    )


def propagate(nodes: DataFrame) -> DataFrame:
    """(spelling, label): the least node id of the component, by rounds of minimum-label propagation."""
    edges = cut_lineage(nodes.select("spelling", F.col("node").alias("label"), F.explode("entities").alias("entity")))
    labels = edges.groupBy("spelling").agg(F.min("label").alias("label"))
    pairs = edges.select("spelling", "entity")
    while True:
        of_entity = pairs.join(labels, "spelling").groupBy("entity").agg(F.min("label").alias("least"))
        heard = pairs.join(of_entity, "entity").groupBy("spelling").agg(F.min("least").alias("least"))
        # A label is some node's id: what that node has heard by now holds for all that carry the label.
        moved = labels.join(heard, "spelling").select("spelling", "label", F.least("label", "least").alias("least"))
        jump = moved.groupBy("label").agg(F.min("least").alias("jump")).withColumnRenamed("label", "of")
        moved = moved.join(jump, moved["least"] == jump["of"], "left").select("spelling", "label", F.least("least", "jump").alias("new"))
        moved = cut_lineage(moved)
        changed = moved.filter(F.col("new") < F.col("label")).limit(1).count()
        labels = moved.select("spelling", F.col("new").alias("label"))
        if not changed:
            return labels


def split_conflicts(df: DataFrame, id_col: str, written: list[str], entities: list[Column], label: Column) -> DataFrame:
    """Ids of all rows of the groups whose rows name at least two splits, unlabelled rows included."""
    bits = F.coalesce(*[F.when(label == s, F.lit(1 << k)) for k, s in enumerate(SPLITS)], F.lit(0))
    nodes = cut_lineage(grouped_nodes(df, id_col, written, entities, bits))
    joined = nodes.select("spelling", "n", "bits").join(propagate(nodes), "spelling")
    bad = joined.groupBy("label").agg(F.bit_or("bits").alias("all")).filter(F.bit_count("all") >= 2).select("label")
    dim = cut_lineage(joined.join(bad, "label", "left_semi").groupBy("spelling").agg(F.sum("n").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    rows = df.select(F.col(f"`{id_col}`"), _spelling(written).alias("spelling"))
    return join_unique(rows, dim, "spelling", "n", total).select(id_col)


def assign_units(sizes: np.ndarray, shares: np.ndarray, totals: np.ndarray | None = None) -> np.ndarray:
    """The split of each unit. sizes: units x labels; shares: of the splits; totals: of the labels, by default of the units. Largest unit
    first, each to the split that leaves the least sum of squared deviations, each label's in units of its total."""
    totals = sizes.sum(axis=0) if totals is None else totals
    weight = 1.0 / np.maximum(totals, 1) ** 2
    goal = np.outer(shares, totals).astype(float)
    all_goal = goal.sum(axis=1)
    all_weight = sizes.shape[1] / max(totals.sum(), 1) ** 2
    have, have_all = np.zeros_like(goal), np.zeros(len(shares))
    out = np.zeros(len(sizes), dtype=np.int32)
    for u in np.lexsort((np.arange(len(sizes)), -sizes.sum(axis=1))):
        v = sizes[u]
        d = have - goal
        # Change of the sum of squares if v is added to a split.
        gain = ((2 * d + v) * v * weight).sum(axis=1) + (2 * (have_all - all_goal) + v.sum()) * v.sum() * all_weight
        s = int(np.argmin(gain))
        out[u] = s
        have[s] += v
        have_all[s] += v.sum()
    return out


def assign_splits(df: DataFrame, targets: DataFrame, id_col: str, written: list[str], entities: list[Column], label: Column) -> DataFrame:
    """(id, group_id, split) of every row; ``targets`` (split, target_share) has a few rows. ``label`` is what the
    splits' distributions should agree in."""
    return assign_labelled(df, targets, id_col, written, entities, label).drop("label")


def assign_labelled(df: DataFrame, targets: DataFrame, id_col: str, written: list[str], entities: list[Column], label: Column) -> DataFrame:
    """``assign_splits`` with the label of each row."""
    spark = df.sparkSession
    goal = sorted((r["split"], float(r["target_share"])) for r in targets.select("split", "target_share").collect())
    if not goal or sum(g[1] for g in goal) <= 0:
        raise ValueError("targets need a positive share")
    names = [g[0] for g in goal]
    shares = np.array([g[1] for g in goal])
    shares = shares / shares.sum()

    e = F.array_sort(F.array_distinct(F.filter(F.array(*entities), lambda x: x.isNotNull())))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), _spelling(written).alias("spelling"), e.alias("entities"), F.coalesce(label.cast("string"), F.lit("")).alias("label"))
    grouped = rows.filter(F.size("entities") > 0)
    alone = rows.filter(F.size("entities") == 0).select("id", F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("group_id"), "label")
    nodes = cut_lineage(grouped.groupBy("spelling", "entities").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    component = cut_lineage(propagate(nodes).select("spelling", F.col("label").cast("string").alias("group_id")))
    counts = grouped.groupBy("spelling", "label").agg(F.count(F.lit(1)).alias("k")).join(component, "spelling")
    per_group = counts.groupBy("group_id", "label").agg(F.sum("k").alias("k"))
    per_group = cut_lineage(per_group.unionByName(alone.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("k"))))
    of_label = cut_lineage(per_group.groupBy("label").agg(F.sum("k").alias("all")))
    total = of_label.agg(F.sum("all")).first()[0] or 0
    groups = per_group.groupBy("group_id").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", "label")).alias("main"))
    groups = cut_lineage(groups.withColumn("large", F.col("n") * LARGE > total))

    large = _large_groups(per_group, groups, of_label, shares, names)
    small = _small_groups(per_group, groups.filter("not large").drop("large"), large, of_label, shares, names)
    split = cut_lineage(large.select("group_id", "split").unionByName(small).join(groups.select("group_id", "n"), "group_id"))

    sizes = nodes.groupBy("spelling").agg(F.sum("n").alias("m"))
    dim = cut_lineage(sizes.join(component, "spelling").join(split.drop("n"), "group_id").select("spelling", "m", "group_id", "split"))
    kept = join_unique(grouped.select("id", "spelling", "label"), dim, "spelling", "m", total).select("id", "group_id", "split", "label")
    lone = join_unique(alone, split, "group_id", "n", total).select("id", "group_id", "split", "label")
    return kept.unionByName(lone).withColumnRenamed("id", id_col)


def _large_groups(per_group: DataFrame, groups: DataFrame, of_label: DataFrame, shares: np.ndarray, names: list[str]) -> DataFrame:
    """(group_id, split) of the large groups, by the greedy step."""
    spark = per_group.sparkSession
    total = of_label.agg(F.sum("all")).first()[0] or 0
    common = {r.label: (k, r["all"]) for k, r in enumerate(of_label.filter(F.col("all") * LARGE > total).orderBy("label").collect())}
    told = of_label.filter(F.col("all") * LARGE > total).select("label", F.col("label").alias("told"))
    cells = per_group.join(groups.filter("large").select("group_id"), "group_id").join(told, "label", "left")
    table = cells.groupBy("group_id", "told").agg(F.sum("k").alias("k")).collect()
    index = {g: k for k, g in enumerate(sorted({r.group_id for r in table}))}
    sizes = np.zeros((len(index), len(common) + 1), dtype=np.int64)
    for r in table:
        sizes[index[r.group_id], common[r.told][0] if r.told is not None else len(common)] += r.k
    totals = np.array([*(n for _, n in common.values()), total - sum(n for _, n in common.values())], np.int64)
    chosen = assign_units(sizes, shares, totals) if index else []
    return spark.createDataFrame([(g, names[int(chosen[k])]) for g, k in index.items()], "group_id string, split string")


def _small_groups(per_group: DataFrame, small: DataFrame, large: DataFrame, of_label: DataFrame, shares: np.ndarray, names: list[str]) -> DataFrame:
    """(group_id, split) of the groups of ``small`` (group_id, n, main): each stratum's running sum, cut at what is left of its targets."""
    have = per_group.join(large, "group_id").groupBy("label")
    have = have.agg(*[F.sum(F.when(F.col("split") == s, F.col("k")).otherwise(0)).alias(f"__have{i}") for i, s in enumerate(names)])
    strata = small.groupBy(F.col("main").alias("label")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("m"))
    strata = strata.join(of_label, "label").join(have, "label", "left")
    want = [F.greatest(F.lit(float(x)) * F.col("all") - F.coalesce(F.col(f"__have{i}"), F.lit(0)), F.lit(0.0)) for i, x in enumerate(shares)]
    whole = sum(want[1:], want[0])
    cuts, at = [], F.lit(0.0)
    for w, x in zip(want, shares):
        at = at + F.when(whole > 0, w / whole).otherwise(F.lit(float(x)))
        cuts.append(at)
    phase = F.pmod(F.xxhash64("label"), F.lit(1 << 20)) / float(1 << 20)
    strata = cut_lineage(strata.select(F.col("label").alias("main"), "rows", "m", phase.alias("phase"), F.array(*cuts).alias("cuts")))
    hashed = small.withColumn("h", F.xxhash64("group_id"))
    placed = running_sum(hashed, ["main"], ["h", "group_id"], F.col("n"), "before")
    placed = join_unique(placed, strata, "main", "m", small.count())
    place = F.pmod((F.col("before") + F.col("n") / 2) / F.col("rows") + F.col("phase"), F.lit(1.0))
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(place < F.col("cuts")[i], names[i]).otherwise(split)
    return placed.select("group_id", split.alias("split"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per split: target and actual share, rows, groups, and the largest difference, over all labels, between a
    label's share in the split and in the whole. ``assigned``: of ``assign_labelled``."""
    cells = cut_lineage(assigned.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))
    whole = cells.groupBy("label").agg(F.sum("n").alias("label_n")).crossJoin(F.broadcast(cells.agg(F.sum("n").alias("total"))))
    per = cells.groupBy("split").agg(F.sum("n").alias("split_n"))
    deviation = (
        whole.crossJoin(F.broadcast(per))
        .join(cells, ["split", "label"], "left")
        .groupBy("split")
        .agg(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("split_n") - F.col("label_n") / F.col("total"))).alias("max_label_deviation"), F.max("split_n").alias("rows"), F.max("total").alias("total"))
    )
    groups = assigned.groupBy("split").agg(F.countDistinct("group_id").alias("groups"))
    t = targets.select("split", "target_share")
    out = t.join(deviation, "split", "left").join(groups, "split", "left")
    return out.select("split", "target_share", (F.coalesce("rows", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("groups", F.lit(0)).alias("groups"), "max_label_deviation")
