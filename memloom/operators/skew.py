"""Joins and positions where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.session import cut_lineage

#: Keys that hold more than this share of the rows are hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def join_unique(rows: DataFrame, dim: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``dim`` (one row per ``key``, with ``n`` = the key's rows in ``rows``, whose number
    is ``total``). Hot keys, fewer than 1 / HOT_SHARE by definition, are broadcast, so their rows are not shuffled;
    the rest is an ordinary join in which no key holds more than HOT_SHARE of the rows."""
    least = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(dim.filter(F.col(n) > least).drop(n))
    cold = dim.filter(F.col(n) <= least).drop(n)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row within its key by ``order``, which should be unique within the key. Rows
    are cut into ranges of (key, order); a sum is that of the key's earlier ranges plus that within the range. So a key
    with a third of the rows is spread over a third of the tasks. The ranges are checkpointed, as both steps must see the same."""
    ranged = df.withColumn("__v", value).repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("__range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__v").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__range")) - F.col("__n")).drop("__n")
    inside = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumn("__inside", F.sum("__v").over(inside) - F.col("__v"))
    on = F.col("a.__range") == F.col("b.__range")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = placed.alias("a").join(before.alias("b"), on)
    return out.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("__before") + F.col("__inside")).alias(name))


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) within its key by ``order``, which should be unique within the key, as by ``running_sum``."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name)
