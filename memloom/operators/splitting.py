"""Deterministic orders, samples and splits by hash, and checks that splits do not leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.operators.skew import positions
from memloom.session import cut_lineage


def keyed_hash(seed: str, *parts: Column) -> Column:
    """SHA-256 over seed and parts, NUL between; hexadecimal, so text order is byte order."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def permuted(df: DataFrame, key: str, seed: str, partition: list[str]) -> DataFrame:
    """Rank of each row in the permutation of its partition that the keyed hash gives; partitions of any size."""
    return positions(df.withColumn("__h", keyed_hash(seed, F.col(key))), partition, ["__h", key], "rank").drop("__h")


def sample_fixed(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: the least by keyed hash (a top-n, no full sort)."""
    return df.withColumn("__h", keyed_hash(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def sample_share(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Each row by itself with probability ``share``: the hash's first 32 bits below it."""
    h = F.conv(F.substring(keyed_hash(seed, F.col(key)), 1, 8), 16, 10).cast("double")
    return df.filter(h / 4294967296.0 < share)


def split_groups(rows: DataFrame, key: str, row_id: str, label: Column) -> DataFrame:
    """(group_key, label, conflict): the groups of rows with one key; a row whose key is null or empty is a group by itself.
    ``conflict``: whether the rows of a group name more than one split."""
    own = F.when(F.col(key).isNull() | (F.col(key) == ""), F.concat(F.lit("row "), F.col(row_id).cast("string"))).otherwise(F.col(key))
    g = rows.select(own.alias("group_key"), label.alias("label")).groupBy("group_key")
    return g.agg(F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("conflict")).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def group_split(groups: DataFrame, key: str, label: str, train: float, validation: float, seed: str, conflict: str | None = None) -> DataFrame:
    """(key, split): explicit labels stay; other groups are cut at rounded (half to even) shares of their hash order, so
    that no split is empty that no label fills. An error if a split stays empty all the same, and for a group that ``conflict`` marks.

    The position within the hash order is found without one sorted partition: a group's rank is the number of groups
    in smaller hash buckets plus its rank in its own."""
    if conflict:
        fail = F.raise_error(F.concat(F.lit("conflicting labels in group "), F.col(key).cast("string"))).cast("string")
        groups = groups.withColumn(label, F.when(F.col(conflict), fail).otherwise(F.col(label)))
    labelled = groups.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("split"))
    rest = groups.filter(F.col(label).isNull()).select(key, keyed_hash(seed, F.col(key)).alias("__h"))
    rest = rest.withColumn("__b", F.substring("__h", 1, 2))  # 256 buckets
    per = rest.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = per.withColumn("__before", F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).select("__b", "__before")
    inside = W.partitionBy("__b").orderBy("__h", key)
    ranked = rest.join(F.broadcast(before), "__b").withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    have = labelled.agg(*[F.coalesce(F.bool_or(F.col("split") == s), F.lit(False)).alias(f"__{s}") for s in ("train", "val", "test")])
    n = per.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
    cuts = n.crossJoin(have)
    short = (3 - sum(F.col(f"__{s}").cast("int") for s in ("train", "val", "test"))) > F.col("__all")
    cuts = cuts.withColumn("__all", F.when(short, F.raise_error(F.lit("a split stays empty")).cast("bigint")).otherwise(F.col("__all")))
    a = F.bround(F.col("__all") * train).cast("bigint")
    d = F.bround(F.col("__all") * (train + validation)).cast("bigint")
    a = F.when(F.col("__train"), a).otherwise(F.greatest(a, F.lit(1)))
    d = F.when(F.col("__val"), d).otherwise(F.greatest(d, a + 1))
    d = F.when(F.col("__test"), d).otherwise(F.least(d, F.col("__all") - 1))
    cuts = cuts.select(a.alias("__a"), d.alias("__d"), "__val", "__all").withColumn("__a", F.least("__a", "__d"))
    cuts = cuts.withColumn("__a", F.when(F.col("__val"), F.col("__a")).otherwise(F.least("__a", F.col("__d") - 1)))
    split = F.when(F.col("__rank") < F.col("__a"), "train").when(F.col("__rank") < F.col("__d"), "val").otherwise("test")
    kept = labelled.crossJoin(F.broadcast(cuts.select("__all"))).filter("__all >= 0").select(key, "split")
    return kept.unionByName(ranked.crossJoin(F.broadcast(cuts)).select(key, split.alias("split")))


def holdout_counts(strata: DataFrame, n: str, holdout: int, ratio: float, order: list[str]) -> DataFrame:
    """``strata`` (one row each, ``n`` = its groups) with ``held``, in all exactly ``holdout``. The j-th group of a stratum has the
    marginal deficit n * ratio - j; the ``holdout`` largest are held, ties by ``order``, after one on either side of every stratum of two
    or more where that is feasible. As all deficits of 1 and more come before all below 1, a stratum holds the whole part of its share,
    and each further round adds (or takes back) at most one from a stratum: a numbering of strata, of any number, by deficit."""
    t = strata.agg(F.coalesce(F.sum(n), F.lit(0)).alias("all"), F.count_if(F.col(n) >= 2).alias("pairs")).first()
    both = holdout >= t.pairs and t["all"] - holdout >= t.pairs
    low = F.when(F.lit(both) & (F.col(n) >= 2), 1).otherwise(0)
    high = F.when(F.lit(both) & (F.col(n) >= 2), F.col(n) - 1).otherwise(F.col(n))
    whole = F.greatest(low, F.least(high, F.floor(F.col(n) * ratio))).cast("bigint")
    out = cut_lineage(strata.withColumn("__low", low).withColumn("__high", high).withColumn("held", whole))
    while left := holdout - (out.agg(F.sum("held")).first()[0] or 0):
        room = F.col("held") < F.col("__high") if left > 0 else F.col("held") > F.col("__low")
        deficit = F.col(n) * ratio - F.col("held")
        free = out.filter(room).withColumn("__deficit", -deficit if left > 0 else deficit)
        placed = positions(free, [], ["__deficit", *order], "__place").drop("__deficit")
        step = F.when(F.col("__place") < abs(left), 1 if left > 0 else -1).otherwise(0)
        moved = placed.withColumn("held", F.col("held") + step)
        if not moved.filter(step != 0).limit(1).count():
            raise ValueError("the holdout cannot be reached")
        out = cut_lineage(out.filter(~room).unionByName(moved.drop("__place")))
    return out.drop("__low", "__high")


def stratified_split(groups: DataFrame, key: str, strata: list[str], train: float, validation: float, seed: str) -> DataFrame:
    """(key, strata, split) of ``groups``, one row each: every stratum is spread over train, val and test by its share, the groups by their hash
    order. An error with fewer than three groups, and for blank keys or strata."""
    n = groups.count()
    if n < 3:
        raise ValueError("a split needs three groups")
    if groups.filter(F.expr(" or ".join(f"coalesce(trim(`{c}`), '') = ''" for c in [key, *strata]))).limit(1).count():
        raise ValueError("keys and strata must not be blank")
    share = round(train + validation, 12)
    develop = min(max(round(n * share), 2), n - 1)
    trained = min(max(round(n * train), 1), develop - 1)
    hashed = groups.select(key, *strata).withColumn("__h", keyed_hash(seed, F.col(key)))
    ranked = positions(hashed, strata, ["__h", key], "__rank").drop("__h")
    tie = keyed_hash(seed, *[F.col(c) for c in strata])
    sizes = groups.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).withColumn("__tie", tie)
    tested = holdout_counts(sizes, "n", n - develop, 1.0 - share, ["__tie"]).withColumnRenamed("held", "tested")
    both = holdout_counts(tested.withColumn("n", F.col("n") - F.col("tested")), "n", develop - trained, (develop - trained) / develop, ["__tie"])
    both = both.select(*[F.col(c).alias(f"__{c}") for c in strata], "tested", "held")
    on = [F.col(c) == F.col(f"__{c}") for c in strata]
    split = F.when(F.col("__rank") < F.col("tested"), "test").when(F.col("__rank") < F.col("tested") + F.col("held"), "val").otherwise("train")
    return ranked.join(both, on).select(key, *strata, split.alias("split"))


def split_leaks(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    s = df.groupBy(*keys).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return s.filter(F.size("splits") > 1)


def natural_key(c: Column) -> list[Column]:
    """Order by the trailing integer, those without one last, then by the text."""
    n = F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")
    return [F.asc_nulls_last(n), F.asc(c)]


def union_all(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows, with the name of the table they come from."""
    out = None
    for name, t in sorted(tables.items()):
        t = t.withColumn("merged_from", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
