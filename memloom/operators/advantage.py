"""Group-normalised advantages, whitening, and step credit on token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def final_rows(df: DataFrame, source: str, uid: str, position: str) -> DataFrame:
    """Per session the row with the greatest output index, the first by ``position`` (unique) on ties. A uid is
    ``{uid}_{session}_{index}``, without white space around it; one that is not is a session by itself, a blank or null one a session
    per position. Sessions of different sources are different."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    u, form = trimmed(uid), r"(?s)^(.*_[^_]*)_\s*([+-]?\d+)\s*$"
    index = F.when(u.rlike(form), F.regexp_extract(u, form, 2).try_cast("bigint"))
    plain = F.concat(F.lit("plain:"), F.when(u == "", F.col(position).cast("string")).otherwise(u))
    key = F.concat(trimmed(source), F.lit(":"), F.when(index.isNull(), plain).otherwise(F.regexp_extract(u, form, 1)))
    out = df.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(index, F.lit(0)).alias("output_index")).alias("__row"))
    last = F.max_by("__row", F.struct(F.col("__row.output_index"), -F.col(f"__row.`{position}`")))
    return out.groupBy("__key").agg(last.alias("__row")).select("__row.*")


def marginal_deltas(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Signed differences of neighbouring values: K + 1 values give K deltas."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("stage", F.row_number().over(w) - 1).withColumn("delta", F.col(value) - F.lag(value).over(w)).filter("stage > 0")


def group_normalized(df: DataFrame, group: str, value: str, mask: Column | None = None) -> DataFrame:
    """``normalized``: (x - mean) / (sample deviation + 1e-6) over the rows of a group that the mask includes. Rows outside
    the mask (null is outside) and masked singletons are 0; without a mask at all a singleton is x / (1 + 1e-6). A partial aggregate
    and a join back, so a large group is never sorted."""
    x, inside = F.col(value), F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    rows = df.withColumn("__in", inside)
    chosen = F.when(F.col("__in"), x)
    stats = rows.groupBy(F.col(group).alias("__g")).agg(F.count_if("__in").alias("__m"), F.avg(chosen).alias("__avg"), F.stddev_samp(chosen).alias("__sd"))
    alone = F.lit(0.0) if mask is not None else x / (1 + 1e-6)
    out = F.when(~F.col("__in"), 0.0).when(F.col("__m") == 1, alone).otherwise((x - F.col("__avg")) / (F.col("__sd") + 1e-6))
    return rows.join(stats, F.col(group).eqNullSafe(F.col("__g"))).withColumn("normalized", out).drop("__g", "__in", "__m", "__avg", "__sd")


def masked_whitened(df: DataFrame, value: str, mask: Column) -> DataFrame:
    """(x - mean) * rsqrt(var + 1e-8) with masked moments over n + 1e-8 and Bessel's n / (n - 1); an error if at most one
    row is masked in. One aggregate of mergeable moments; the sum of squares around ``mean`` follows from those around the average."""
    x = F.when(mask, F.col(value))
    m = df.agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.avg(x).alias("a"), F.var_pop(x).alias("v"))
    mean = F.col("s") / (F.col("n") + 1e-8)
    squares = F.col("n") * (F.col("v") + F.pow(F.col("a") - mean, 2))
    bessel = F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.raise_error(F.lit("whitening needs two values")).cast("bigint"))
    moments = m.select(mean.alias("__mean"), (squares / (F.col("n") + 1e-8) * bessel).alias("__var"))
    return df.crossJoin(F.broadcast(moments)).withColumn("whitened", (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)).drop("__mean", "__var")


def decoupled(df: DataFrame, group: str, task: str, objectives: dict[str, float], response: Column, samples: dict[str, Column] | None = None) -> DataFrame:
    """``advantage``: task + sum of weight * group-normalised objective, whitened over the response mask and 0 outside it. ``samples``: the
    sample mask of an objective, all rows without one. An error for negative weights and if no weight is positive."""
    if any(w < 0 for w in objectives.values()) or not any(w > 0 for w in objectives.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    inside = F.coalesce(response, F.lit(False))
    total, out = F.col(task), df.withColumn("__response", inside)
    for k, (name, weight) in enumerate(sorted(objectives.items())):
        if weight:
            out = group_normalized(out, group, name, (samples or {}).get(name)).withColumnRenamed("normalized", f"__o{k}")
            total = total + F.when(F.col("__response"), F.lit(weight) * F.col(f"__o{k}")).otherwise(0.0)
    white = masked_whitened(out.withColumn("__fused", total), "__fused", F.col("__response"))
    shown = F.when(F.col("__response"), F.col("whitened")).otherwise(0.0)
    return white.withColumn("advantage", shown).select(*df.columns, "advantage")


def eligible(valid: Column, padding: Column, failures: Column, successes: Column, value: Column) -> Column:
    """Whether a resource reward counts."""
    return valid & ~padding & ((failures == 0) | (successes > 0) | (value > 0))


def last_to_session(df: DataFrame, session: str, order: list[Column], value: str) -> DataFrame:
    """Every row with its session's final value: aggregate and join back; ties by the whole order."""
    last = df.groupBy(session).agg(F.max_by(value, F.struct(*order)).alias("session_value"))
    return df.join(last, session)


def span_problems(spans: DataFrame, group: str, start: str, end: str, length: Column) -> DataFrame:
    """Spans that are empty, negative, out of range, or overlap the one before."""
    w = W.partitionBy(group).orderBy(start, end)
    before = F.lag(end).over(w)
    problem = F.when((F.col(start) < 0) | (F.col(end) <= F.col(start)), "empty").when(F.col(end) > length, "out of range").when(F.col(start) < before, "overlap")
    return spans.withColumn("problem", problem).filter("problem is not null")


def add_credit(tokens: DataFrame, spans: DataFrame, group: str, position: str, advantage: str, weight: float) -> DataFrame:
    """advantage + weight * delta for tokens within a span [start, end): an equi-join on the group with the range as its
    residual; spans are disjoint, so a token meets at most one."""
    s = spans.select(F.col(group).alias("__g"), F.col("span_start").alias("__s"), F.col("span_end").alias("__e"), F.col("delta").alias("__d"))
    hit = (F.col(group) == F.col("__g")) & (F.col(position) >= F.col("__s")) & (F.col(position) < F.col("__e"))
    out = tokens.join(s, hit, "left").withColumn("shaped", F.col(advantage) + F.coalesce(F.lit(weight) * F.col("__d"), F.lit(0.0)))
    return out.drop("__g", "__s", "__e", "__d")


def credit_status(stages: Column, format_valid: Column, probe_failures: Column) -> Column:
    return F.when(stages == 0, "no_stages").when(~format_valid, "invalid_format").when(probe_failures > 0, "probe_failed").otherwise("ok")
