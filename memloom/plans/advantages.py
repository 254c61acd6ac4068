"""Advantages and step credit over ``events``: a user is a group, an event a rollout or token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions.resources import resource_reward
from memloom.operators import advantage as A
from memloom.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", k.alias("k"))


_E = "(SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def marginal_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.marginal_deltas(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", F.col("stage").cast("bigint").alias("stage"), F.round("delta", 6).alias("delta"))


def final_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With uids that are no sessions, blank and null ones, and the same uids in two sources."""
    k = F.col("k") % 17
    uid = F.format_string("u_%s_%s_%d", F.col("user_id").cast("string"), F.col("event_type"), F.col("k"))
    uid = F.when(k == 0, F.concat(F.lit("odd"), F.col("event_type"))).when(k == 1, " ").when(k == 2, F.lit(None)).when(k == 3, F.concat(F.lit(" "), uid)).otherwise(uid)
    source = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, " a ").otherwise("b")
    out = A.final_rows(_events(spark, sf_dir).withColumn("uid", uid).withColumn("source", source), "source", "uid", "event_id")
    return out.select("uid", "event_id", "output_index")


def group_normalized_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.group_normalized(_events(spark, sf_dir), "user_id", "value", F.col("event_type") != "error")
    return out.select("event_id", F.round("normalized", 5).alias("normalized"))


def group_normalized_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("g", F.concat_ws("/", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 8).cast("string")))
    return A.group_normalized(e, "g", "value").select("event_id", F.round("normalized", 5).alias("normalized"))


def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.masked_whitened(_events(spark, sf_dir), "value", F.col("event_type") != "error")
    return out.select("event_id", F.round("whitened", 5).alias("whitened"))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = A.eligible(F.col("value").isNotNull(), F.col("k") % 10 == 0, F.col("k") % 3, F.col("k") % 2, F.col("value"))
    return _events(spark, sf_dir).withColumn("ok", ok).withColumn("cost", resource_reward(F.col("value"), ok).cast("double")).withColumn("task", F.col("k") / 100.0)


def decoupled_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.decoupled(_rewards(spark, sf_dir), "user_id", "task", {"cost": 0.5, "value": 0.0}, F.col("event_type") != "error", {"cost": F.col("ok")})
    return out.select("event_id", F.round("advantage", 4).alias("advantage"))


def eligibility_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewards(spark, sf_dir).select("event_id", "ok", F.round("cost", 4).alias("cost"))


def session_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.last_to_session(_events(spark, sf_dir), "user_id", [F.col("ts"), F.col("event_id")], "value")
    return out.select("event_id", "session_value")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over a user's event ids, some of them faulty."""
    e = _events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select("user_id", "event_id", F.col("event_id").cast("int").alias("span_start"), (F.col("event_id") + F.col("k") * 20 - 100).cast("int").alias("span_end"), (F.col("value") / 10).alias("delta"))


def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.span_problems(_spans(spark, sf_dir), "user_id", "span_start", "span_end", F.lit(9000)).select("user_id", "span_start", "span_end", "problem")


def span_credit_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).select("user_id", "span_start", F.least(F.col("span_start") + 60, F.col("span_start") + 1 + F.abs(F.col("span_end") - F.col("span_start"))).alias("span_end"), "delta")
    out = A.add_credit(_events(spark, sf_dir), spans, "user_id", "event_id", "value", 0.5)
    return out.groupBy("event_id").agg(F.round(F.sum("shaped"), 5).alias("shaped"), F.count(F.lit(1)).alias("spans"))


def credit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.credit_status(F.count_if(F.col("event_type") == "purchase"), F.max("k") > 50, F.count_if((F.col("event_type") == "error") & (F.col("k") > 95)))
    return _events(spark, sf_dir).groupBy("user_id").agg(s.alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        marginal_deltas, final_session_rows, group_normalized_advantage, group_normalized_unmasked, masked_whiten, decoupled_advantage, eligibility_mask, session_broadcast,
        span_validation, span_credit_range_join, credit_status,
    )
}

_SPANS = f"(SELECT user_id, event_id, CAST(event_id AS INT) AS span_start, CAST(event_id + k * 20 - 100 AS INT) AS span_end, value / 10 AS delta FROM {_E} WHERE event_type = 'purchase')"
_OK = "(value IS NOT NULL AND k % 10 <> 0 AND (k % 3 = 0 OR k % 2 > 0 OR value > 0))"


def _norm(source: str, column: str, mask: str, group: str = "user_id") -> str:
    """Zero outside the mask, and for the only row inside it."""
    return f"""(SELECT e.*, CASE WHEN coalesce({mask}, false) AND m > 1 THEN ({column} - a) / (sd + 1e-6) ELSE 0 END AS normalized FROM {source} e
      JOIN (SELECT {group} AS g, count(*) FILTER ({mask}) AS m, avg({column}) FILTER ({mask}) AS a, stddev_samp({column}) FILTER ({mask}) AS sd FROM {source} GROUP BY 1) s ON s.g IS NOT DISTINCT FROM {group})"""


def _white(source: str, column: str) -> str:
    return f"""(WITH s AS (SELECT * FROM {source}), m AS (SELECT count(*) FILTER (event_type <> 'error') AS n, sum({column}) FILTER (event_type <> 'error') / (count(*) FILTER (event_type <> 'error') + 1e-8) AS mean FROM s),
      v AS (SELECT sum(({column} - mean) * ({column} - mean)) FILTER (event_type <> 'error') / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM s, m)
      SELECT s.*, ({column} - mean) / sqrt(var + 1e-8) AS whitened FROM s, m, v)"""


_REWARDS = f"(SELECT *, CASE WHEN {_OK} THEN -CAST(CAST(value AS FLOAT) AS DOUBLE) ELSE 0 END AS cost, k / 100.0 AS task FROM {_E})"

ORACLES = {
    "marginal_deltas": f"""SELECT event_id, stage, round(delta, 6) AS delta FROM (SELECT event_id, row_number() OVER w - 1 AS stage, value - lag(value) OVER w AS delta FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE stage > 0""",
    "final_session_rows": f"""WITH u AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'a' ELSE 'b' END AS source, user_id || '_' || event_type AS session, k,
        CASE k % 17 WHEN 0 THEN 'odd' || event_type WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN ' u_' || user_id || '_' || event_type || '_' || k ELSE 'u_' || user_id || '_' || event_type || '_' || k END AS uid FROM {_E}),
        s AS (SELECT uid, event_id, CASE WHEN k % 17 < 3 THEN 0 ELSE k END AS output_index, CASE k % 17 WHEN 0 THEN [source, 'plain', uid] WHEN 1 THEN [source, 'row', event_id::VARCHAR] WHEN 2 THEN [source, 'row', event_id::VARCHAR] ELSE [source, 'session', session] END AS key FROM u)
        SELECT uid, event_id, output_index FROM s AS x WHERE NOT EXISTS (SELECT 1 FROM s AS y WHERE y.key = x.key AND (y.output_index > x.output_index OR y.output_index = x.output_index AND y.event_id < x.event_id))""",
    "group_normalized_advantage": f"SELECT event_id, round(normalized, 5) AS normalized FROM {_norm(_E, 'value', "event_type <> 'error'")}",
    "group_normalized_unmasked": f"""WITH e AS (SELECT *, user_id || '/' || event_type || '/' || event_id % 8 AS g FROM {_E}), s AS (SELECT g, count(*) AS n, avg(value) AS a, stddev_samp(value) AS sd FROM e GROUP BY g)
        SELECT event_id, round(CASE WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - a) / (sd + 1e-6) END, 5) AS normalized FROM e JOIN s USING (g)""",
    "masked_whiten": f"SELECT event_id, round(whitened, 5) AS whitened FROM {_white(_E, 'value')}",
    "decoupled_advantage": f"""WITH n AS (SELECT *, coalesce(event_type <> 'error', false) AS response FROM {_norm(_REWARDS, 'cost', _OK)}), f AS (SELECT *, task + CASE WHEN response THEN 0.5 * normalized ELSE 0 END AS fused FROM n),
        m AS (SELECT count(*) AS n, sum(fused) / (count(*) + 1e-8) AS mean FROM f WHERE response), v AS (SELECT sum((fused - mean) * (fused - mean)) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM f, m WHERE response)
        SELECT event_id, round(CASE WHEN response THEN (fused - mean) / sqrt(var + 1e-8) ELSE 0 END, 4) AS advantage FROM f, m, v""",
    "eligibility_mask": f"SELECT event_id, {_OK} AS ok, round(cost, 4) AS cost FROM {_REWARDS}",
    "session_broadcast": f"SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS session_value FROM {_E}",
    "span_validation": f"""SELECT user_id, span_start, span_end, problem FROM (SELECT *, CASE WHEN span_start < 0 OR span_end <= span_start THEN 'empty' WHEN span_end > 9000 THEN 'out of range'
        WHEN span_start < lag(span_end) OVER (PARTITION BY user_id ORDER BY span_start, span_end) THEN 'overlap' END AS problem FROM {_SPANS}) WHERE problem IS NOT NULL""",
    "span_credit_range_join": f"""WITH s AS (SELECT user_id, span_start, least(span_start + 60, span_start + 1 + abs(span_end - span_start)) AS span_end, delta FROM {_SPANS})
        SELECT e.event_id, round(sum(value + coalesce(0.5 * delta, 0)), 5) AS shaped, count(*) AS spans FROM {_E} e LEFT JOIN s ON s.user_id = e.user_id AND e.event_id >= span_start AND e.event_id < span_end GROUP BY 1""",
    "credit_status": f"""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'no_stages' WHEN NOT max(k) > 50 THEN 'invalid_format' WHEN count(*) FILTER (event_type = 'error' AND k > 95) > 0 THEN 'probe_failed' ELSE 'ok' END AS status FROM {_E} GROUP BY 1""",
}
