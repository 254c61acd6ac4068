"""Accounting of model calls: success, routes, critical path, priced cost, ideal prefix reuse.

A call table has one row per call: ``trajectory``, ``call_index``, ``route``, and whatever measure columns a
function names. All are partial aggregations on the trajectory or route; nothing is windowed over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.functions.coerce import nonnegative_double, nonnegative_int
from memloom.functions.resources import guarded


def call_summary(calls: DataFrame, succeeded: Column, direct: Column) -> DataFrame:
    """Per trajectory: calls, successes, failures, direct returns, success rate (0 without calls), token sums."""
    ok = F.count_if(succeeded)
    n = F.count(F.lit(1))
    return calls.groupBy("trajectory").agg(
        n.alias("num_calls"),
        ok.alias("num_successful"),
        (n - ok).alias("num_failed"),
        F.count_if(direct).alias("num_direct"),
        guarded(ok, n).alias("success_rate"),
        F.sum(nonnegative_int(F.col("prompt_tokens"))).alias("prompt_tokens"),
        F.sum(nonnegative_int(F.col("completion_tokens"))).alias("completion_tokens"),
    )


def critical_path(calls: DataFrame, stage: Column, latency: Column) -> DataFrame:
    """Per trajectory: the sum over stages of the largest latency within the stage. A null stage is the call's own."""
    key = F.coalesce(F.concat(F.lit("stage "), stage.cast("string")), F.concat(F.lit("call "), F.col("call_index").cast("string")))
    longest = calls.groupBy("trajectory", key.alias("stage_key")).agg(F.max(nonnegative_double(latency)).alias("latency"))
    return longest.groupBy("trajectory").agg(F.sum("latency").alias("critical_path_latency"), F.count(F.lit(1)).alias("stages"))


def route_counts(calls: DataFrame, attempted: Column) -> DataFrame:
    """Attempted calls per route; a blank route is ``unknown``."""
    route = F.coalesce(F.nullif(F.trim("route"), F.lit("")), F.lit("unknown"))
    return calls.filter(attempted).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("calls"))


def with_registry(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """Counts of all configured and observed routes; 0 for those without calls. ``registry``: (route, model)."""
    routes = registry.select("route").union(counts.select("route")).distinct()
    out = routes.join(counts, "route", "left").join(registry, "route", "left")
    return out.select("route", F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("calls", F.lit(0)).alias("calls"))


def route_shares(calls: DataFrame, attempted: Column, succeeded: Column, cost: Column, registry: DataFrame) -> DataFrame:
    """Per route: share of attempted calls, success rate, cost per trajectory; zero rows for unused routes."""
    totals = calls.agg(F.countDistinct("trajectory").alias("samples"), F.count_if(attempted).alias("all_calls"))
    per = calls.filter(attempted).groupBy("route").agg(F.count(F.lit(1)).alias("calls"), F.count_if(succeeded).alias("ok"), F.sum(nonnegative_double(cost)).alias("cost"))
    routes = registry.select("route").union(per.select("route")).distinct()
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        routes.join(per, "route", "left")
        .crossJoin(F.broadcast(totals))  # one row
        .select("route", guarded(z("calls"), F.col("all_calls")).alias("call_share"), guarded(z("ok"), z("calls")).alias("success_rate"), guarded(z("cost"), F.col("samples")).alias("cost_per_sample"))
    )


def resolve_profiles(calls: DataFrame, profiles: DataFrame, model: str = "model", backend: str = "backend_model") -> DataFrame:
    """Each call with the canonical model that both of its names resolve to. ``profiles``: (identifier, canonical), one
    row per identifier, a configuration table. ``resolved`` is null where a name is unknown or the two disagree."""
    p = (profiles.select(F.lower(F.trim("identifier")).alias("identifier"), "canonical"))
    a = p.select(F.col("identifier").alias("__a"), F.col("canonical").alias("__ca"))
    b = p.select(F.col("identifier").alias("__b"), F.col("canonical").alias("__cb"))
    out = calls.join(a, F.lower(F.trim(model)) == F.col("__a"), "left").join(b, F.lower(F.trim(backend)) == F.col("__b"), "left")
    return out.withColumn("resolved", F.when(F.col("__ca") == F.col("__cb"), F.col("__ca"))).drop("__a", "__b", "__ca", "__cb")


def cost_formula(components: DataFrame) -> DataFrame:
    """Components summed by (model, prices), with raw and USD cost."""
    return components.groupBy("model", "input_price", "output_price").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")).alias("raw_cost"),
    ).withColumn("cost_usd", F.col("raw_cost") / 1e6)


def reconciled(parts: Column, total: Column) -> Column:
    """Whether a total agrees with its parts: relative 1e-9, absolute 1e-12."""
    return F.abs(parts - total) <= F.greatest(1e-9 * F.greatest(F.abs(parts), F.abs(total)), F.lit(1e-12))


def reuse_segments(tokens: DataFrame, group: list[str], position: str, is_output: Column, size: Column) -> DataFrame:
    """Calls under ideal prefix reuse: each run of output rows is a call; its input is what stands between it and the run
    before. Rows after the last run cost nothing; a group without a run is one call of input only.
    ``position`` orders a group; ``size`` is a row's tokens."""
    w = W.partitionBy(*group).orderBy(position)
    marked = tokens.select(*group, position, is_output.cast("int").alias("o"), size.alias("s"))
    # A segment is an input run (perhaps empty) and the output run behind it.
    starts = marked.withColumn("b", F.when((F.col("o") == 0) & (F.coalesce(F.lag("o").over(w), F.lit(0)) == 1), 1).otherwise(0))
    seg = starts.withColumn("segment", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    calls = seg.groupBy(*group, "segment").agg(
        F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("s"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("o") == 1, F.col("s"))), F.lit(0)).alias("output_tokens"),
        F.max("o").alias("has_output"),
    )
    return calls.filter((F.col("has_output") == 1) | (F.col("segment") == 0)).drop("has_output")


def usage_totals(calls: DataFrame, keys: list[str], price_in: str, price_out: str) -> DataFrame:
    """Running usage of a trajectory as totals; ``price_changed`` if it was not priced alike throughout."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") * F.col(price_in) + F.col("output_tokens") * F.col(price_out)).alias("api_cost"),
        (F.countDistinct(price_in, price_out) > 1).alias("price_changed"),
    )
