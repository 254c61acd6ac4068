"""Constraints as queries: each returns the offending rows; ``enforce`` turns any of them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def blank_or_repeated(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Keys that are null or blank, or occur more than once within their scope."""
    k = F.trim(F.col(key).cast("string"))
    n = df.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce(k, F.lit("")) == "").alias("blank"))
    return n.filter("blank or n > 1")


def inconsistent(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one combination of values (nulls apart)."""
    return df.groupBy(*keys).agg(F.count_distinct(*[F.col(v) for v in values]).alias("n")).filter("n > 1")


def violating(df: DataFrame, allowed: Column) -> DataFrame:
    """Rows for which a predicate is not true."""
    return df.filter(~F.coalesce(allowed, F.lit(False)))


def unknown_references(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct references without a target, with how often each occurs."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def unlike_counts(df: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """Groups whose row count is not the expected one."""
    want = df.sparkSession.createDataFrame(sorted(expected.items()), "name string, expected bigint")
    have = df.groupBy(F.col(by).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("found"))
    out = F.broadcast(want).join(have, "name", "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.filter(~F.col("found").eqNullSafe(F.col("expected")))


def span_order(df: DataFrame, spans: str, length: Column) -> DataFrame:
    """Rows whose array of [start, end) spans is unordered, overlapping, empty or out of range."""
    s = F.col(spans)
    each = F.forall(s, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= length))
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a["end"] <= b["start"])
    return df.filter(~F.coalesce(each & F.forall(pairs, lambda x: x), F.lit(False)))


def enforce(df: DataFrame, offending: DataFrame, message: str) -> DataFrame:
    """``df``, or an error with the first offending row; checked by one action here."""
    bad = offending.limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
    return df
