"""Call accounting over ``events`` (a user's events as a trajectory's calls) and ``answers``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memloom.functions.coerce import audited_double, nonnegative_int
from memloom.functions.resources import guarded, raw_cost, usage_tokens
from memloom.functions.resources import affine_latency
from memloom.operators import calls as C, chunking, evaluation
from memloom.session import table

ROUTES = [("click", "small"), ("view", "small"), ("purchase", "large"), ("refund", "large")]
# One row per identifier: canonical model, prices per million, latency terms. Numbers of this project's own making.
PROFILES = [
    ("small-answerer", "small", 0.5, 2.0, 0.2, 1e-5, 4e-3, 0.1),
    ("small", "small", 0.5, 2.0, 0.2, 1e-5, 4e-3, 0.1),
    ("medium-answerer", "medium", 1.0, 4.0, 0.3, 2e-5, 6e-3, 0.15),
    ("large-answerer", "large", 3.0, 12.0, 0.5, 4e-5, 1e-2, 0.2),
    ("large", "large", 3.0, 12.0, 0.5, 4e-5, 1e-2, 0.2),
]
_PROFILE_COLUMNS = "identifier string, canonical string, input_price_per_million_usd double, output_price_per_million_usd double, latency_base_seconds double, latency_input_seconds_per_token double, latency_output_seconds_per_token double, latency_image_seconds double"
PROFILE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}',{','.join(f'CAST({x!r} AS DOUBLE)' for x in r)})" for a, b, *r in PROFILES) + ") AS t(identifier, canonical, pin, pout, lbase, lin, lout, limg))"
ROUTE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in ROUTES) + ") AS t(route, model))"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, _PROFILE_COLUMNS)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "route string, model string")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").alias("trajectory"), F.col("event_id").alias("call_index"), F.col("event_type").alias("route"), k.alias("k"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), "value", "ts", F.hour("ts").alias("hour"))


_CALLS_SQL = "(SELECT user_id AS trajectory, event_id AS call_index, event_type AS route, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, ts, hour(ts) AS hour FROM events)"


def call_summary_by_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.call_summary(event_calls(spark, sf_dir), F.col("route") != "error", F.col("route") == "view")
    return out.withColumn("success_rate", F.round("success_rate", 6))


def critical_path_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.critical_path(event_calls(spark, sf_dir), F.col("hour"), F.col("value"))
    return out.withColumn("critical_path_latency", F.round("critical_path_latency", 4))


def critical_path_null_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("k") % 7 != 0, F.col("hour"))
    out = C.critical_path(event_calls(spark, sf_dir), stage, F.col("value"))
    return out.withColumn("critical_path_latency", F.round("critical_path_latency", 4))


def _critical_sql(stage: str) -> str:
    return f"""SELECT trajectory, round(sum(latency), 4) AS critical_path_latency, count(*) AS stages FROM (
      SELECT trajectory, coalesce('stage ' || CAST({stage} AS VARCHAR), 'call ' || CAST(call_index AS VARCHAR)) AS k, max(greatest(coalesce(value, 0), 0)) AS latency
      FROM {_CALLS_SQL} GROUP BY 1, 2) GROUP BY trajectory"""


def route_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route_counts(event_calls(spark, sf_dir), F.col("k") > 5)


def route_registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_registry(route_call_counts(spark, sf_dir), registry(spark))


def route_share_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.route_shares(event_calls(spark, sf_dir), F.col("k") > 5, F.col("value") > 10, F.col("value"), registry(spark))
    return out.select("route", *[F.round(c, 6).alias(c) for c in ("call_share", "success_rate", "cost_per_sample")])


def batch_runtime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_calls(spark, sf_dir)
    path = C.critical_path(c, F.col("hour"), F.col("value")).agg(F.sum("critical_path_latency").alias("path"))
    n, s = F.count(F.lit(1)), F.countDistinct("trajectory")
    out = c.agg(
        guarded(n, s).alias("calls_per_sample"),
        guarded(F.count_if(F.col("route") != "error"), n).alias("success_rate"),
        guarded(F.count_if(F.col("route") == "view"), n).alias("direct_share"),
        guarded(F.sum("prompt_tokens"), s).alias("tokens_per_sample"),
        s.alias("samples"),
    ).crossJoin(path)
    out = out.withColumn("path_per_sample", guarded(F.col("path"), F.col("samples"))).drop("path")
    return out.select("samples", *[F.round(c, 4).alias(c) for c in ("calls_per_sample", "success_rate", "direct_share", "tokens_per_sample", "path_per_sample")])


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select("answer_id", "dataset_source", "conversation_id", "answer_model", "input_tokens", "output_tokens")
    p = F.broadcast(profiles(spark)).alias("p")
    a = a.join(p, F.lower(F.trim("answer_model")) == F.col("p.identifier"))
    i, o = nonnegative_int(F.col("input_tokens")), nonnegative_int(F.col("output_tokens"))
    return a.withColumn("raw_cost", raw_cost("p", i, o)).withColumn("latency", affine_latency("p", F.lit(1), i, o, F.lit(0)))


def profile_priced_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _priced(spark, sf_dir)
    return p.select("answer_id", "canonical", F.round("raw_cost", 6).alias("raw_cost"), F.round("latency", 6).alias("latency"), F.round(F.col("raw_cost") / 1e6, 12).alias("cost_usd"))


def cost_formula_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _priced(spark, sf_dir).select(
        F.col("canonical").alias("model"), F.col("input_price_per_million_usd").alias("input_price"), F.col("output_price_per_million_usd").alias("output_price"),
        nonnegative_int(F.col("input_tokens")).alias("input_tokens"), nonnegative_int(F.col("output_tokens")).alias("output_tokens"), "raw_cost",
    )
    parts = C.cost_formula(c)
    total = c.groupBy("model").agg(F.sum("raw_cost").alias("total"))
    out = parts.join(total, "model").withColumn("agrees", C.reconciled(F.col("raw_cost"), F.col("total")))
    return out.select("model", "input_tokens", "output_tokens", F.round("raw_cost", 3).alias("raw_cost"), F.round("cost_usd", 9).alias("cost_usd"), "agrees")


def dual_key_profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select(F.regexp_extract("answer_model", "^[a-z]+", 0).alias("model"), F.col("answer_model").alias("backend_model"))
    out = C.resolve_profiles(a, profiles(spark).select("identifier", "canonical"))
    return out.groupBy("model", "backend_model", "resolved").agg(F.count(F.lit(1)).alias("n"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.metric_summary(table(spark, sf_dir, "events"), ["event_type"], F.col("value"))
    return out.select("event_type", F.round("mean", 6).alias("mean"), "max", "min", "n")


def dataset_means_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select("answer_model", *[F.col(c).cast("double").alias(c) for c in ("input_tokens", "output_tokens", "observed_wall_time_seconds")])
    long = a.unpivot(["answer_model"], ["input_tokens", "output_tokens", "observed_wall_time_seconds"], "metric", "value")
    return long.groupBy("answer_model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def usage_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    u = usage_tokens(F.lit(None).cast("bigint"), F.col("input_tokens"), F.lit(None).cast("bigint"), F.col("output_tokens"), F.lit(None).cast("bigint"))
    return a.select("answer_id", u.alias("u")).select("answer_id", F.col("u.input").alias("tokens_in"), F.col("u.output").alias("tokens_out"), F.col("u.total").alias("tokens_total"))


def audited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("observed_wall_time_seconds")
    a = table(spark, sf_dir, "answers").select(audited_double(F.when(F.col("answer_id") % 11 == 0, -o).when(F.col("answer_id") % 13 == 0, F.lit(float("nan"))).otherwise(o)).alias("v"))
    return a.groupBy(F.coalesce("v.issue", F.lit("fine")).alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v.value"), 4).alias("total"))


def _session(c: str = "") -> list[str]:
    return ["data_source", "conversation_id", "session_id"]


def _ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").select(*_session(), "turn_index", "ingested_at", "row_id", "role", "preview_text")
    return evaluation.last_record(t.withColumn("key", F.to_json(F.struct(*_session(), "turn_index"))), "key", ["ingested_at", "row_id"])


LAST_TURNS_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY data_source, conversation_id, session_id, turn_index ORDER BY ingested_at DESC, row_id DESC) AS rn FROM turns) WHERE rn = 1)"
WORDS_SQL = "len(list_filter(regexp_split_to_array({c}, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+'), lambda x: x <> ''))"


def kv_reuse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ordered_turns(spark, sf_dir)
    out = C.reuse_segments(t, _session(), "turn_index", F.lower(F.trim("role")) == "assistant", chunking.word_count(F.col("preview_text")))
    return out.withColumn("segment", F.col("segment").cast("bigint"))


def usage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _priced(spark, sf_dir).select("dataset_source", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.col("input_price_per_million_usd").alias("pin"), F.col("output_price_per_million_usd").alias("pout"))
    out = C.usage_totals(a, ["dataset_source"], "pin", "pout")
    return out.withColumn("api_cost", F.round("api_cost", 3))


QUERIES = {
    f.__name__: f
    for f in (
        call_summary_by_trajectory, critical_path_latency, critical_path_null_stage, route_call_counts, route_registry_counts, route_share_zero_fill,
        batch_runtime_metrics, profile_priced_cost, cost_formula_components, dual_key_profile_check, metric_summary, dataset_means_unpivot,
        usage_normalised, audited_values, kv_reuse_segments, usage_fold,
    )
}

_PRICED_SQL = f"(SELECT a.*, p.*, greatest(coalesce(input_tokens, 0), 0) AS i, greatest(coalesce(output_tokens, 0), 0) AS o FROM answers a JOIN {PROFILE_SQL} p ON lower(trim(answer_model)) = identifier)"

ORACLES = {
    "call_summary_by_trajectory": f"""SELECT trajectory, count(*) AS num_calls, count(*) FILTER (route <> 'error') AS num_successful, count(*) FILTER (route = 'error') AS num_failed,
        count(*) FILTER (route = 'view') AS num_direct, round(count(*) FILTER (route <> 'error') / count(*), 6) AS success_rate,
        CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(2 * k) AS BIGINT) AS completion_tokens FROM {_CALLS_SQL} GROUP BY trajectory""",
    "critical_path_latency": _critical_sql("hour"),
    "critical_path_null_stage": _critical_sql("CASE WHEN k % 7 <> 0 THEN hour END"),
    "route_call_counts": f"SELECT route, count(*) AS calls FROM {_CALLS_SQL} WHERE k > 5 GROUP BY route",
    "route_registry_counts": f"""WITH c AS (SELECT route, count(*) AS calls FROM {_CALLS_SQL} WHERE k > 5 GROUP BY route), r AS (SELECT * FROM {ROUTE_SQL})
        SELECT route, coalesce(model, 'unknown') AS model, coalesce(calls, 0) AS calls FROM (SELECT route FROM c UNION SELECT route FROM r) LEFT JOIN c USING (route) LEFT JOIN r USING (route)""",
    "route_share_zero_fill": f"""WITH e AS (SELECT * FROM {_CALLS_SQL}), t AS (SELECT count(DISTINCT trajectory) AS samples, count(*) FILTER (k > 5) AS all_calls FROM e),
        p AS (SELECT route, count(*) AS calls, count(*) FILTER (value > 10) AS ok, sum(greatest(value, 0)) AS cost FROM e WHERE k > 5 GROUP BY route)
        SELECT route, round(coalesce(calls, 0) / all_calls, 6) AS call_share, round(CASE WHEN coalesce(calls, 0) = 0 THEN 0 ELSE ok / calls END, 6) AS success_rate, round(coalesce(cost, 0) / samples, 6) AS cost_per_sample
        FROM (SELECT route FROM p UNION SELECT route FROM {ROUTE_SQL}) LEFT JOIN p USING (route), t""",
    "batch_runtime_metrics": f"""WITH e AS (SELECT * FROM {_CALLS_SQL}), p AS (SELECT sum(l) AS path FROM (SELECT max(greatest(value, 0)) AS l FROM e GROUP BY trajectory, hour))
        SELECT count(DISTINCT trajectory) AS samples, round(count(*) / count(DISTINCT trajectory), 4) AS calls_per_sample, round(count(*) FILTER (route <> 'error') / count(*), 4) AS success_rate,
        round(count(*) FILTER (route = 'view') / count(*), 4) AS direct_share, round(sum(k) / count(DISTINCT trajectory), 4) AS tokens_per_sample, round(max(path) / count(DISTINCT trajectory), 4) AS path_per_sample FROM e, p""",
    "profile_priced_cost": f"SELECT answer_id, canonical, round(i * pin + o * pout, 6) AS raw_cost, round(lbase + i * lin + o * lout, 6) AS latency, round((i * pin + o * pout) / 1e6, 12) AS cost_usd FROM {_PRICED_SQL}",
    "cost_formula_components": f"""SELECT canonical AS model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(i * pin + o * pout), 3) AS raw_cost, round(sum(i * pin + o * pout) / 1e6, 9) AS cost_usd, true AS agrees
        FROM {_PRICED_SQL} GROUP BY canonical""",
    "dual_key_profile_check": f"""WITH p AS (SELECT * FROM {PROFILE_SQL}), a AS (SELECT regexp_extract(answer_model, '^[a-z]+') AS model, answer_model AS backend_model FROM answers)
        SELECT model, backend_model, CASE WHEN x.canonical = y.canonical THEN x.canonical END AS resolved, count(*) AS n FROM a LEFT JOIN p x ON lower(trim(model)) = x.identifier LEFT JOIN p y ON lower(trim(backend_model)) = y.identifier GROUP BY 1, 2, 3""",
    "metric_summary": "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, count(value) AS n FROM events GROUP BY event_type",
    "dataset_means_unpivot": """SELECT answer_model, metric, round(avg(value), 6) AS mean, count(value) AS n FROM (
        SELECT answer_model, 'input_tokens' AS metric, CAST(input_tokens AS DOUBLE) AS value FROM answers UNION ALL SELECT answer_model, 'output_tokens', CAST(output_tokens AS DOUBLE) FROM answers
        UNION ALL SELECT answer_model, 'observed_wall_time_seconds', observed_wall_time_seconds FROM answers) GROUP BY 1, 2""",
    "usage_normalised": "SELECT answer_id, greatest(coalesce(input_tokens, 0), 0) AS tokens_in, greatest(coalesce(output_tokens, 0), 0) AS tokens_out, greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0) AS tokens_total FROM answers",
    "audited_values": """WITH v AS (SELECT CASE WHEN answer_id % 11 = 0 THEN -observed_wall_time_seconds WHEN answer_id % 13 = 0 THEN 'nan'::DOUBLE ELSE observed_wall_time_seconds END AS d FROM answers),
        w AS (SELECT d, CASE WHEN d IS NULL THEN 'missing' WHEN isnan(d) OR isinf(d) THEN 'not finite' WHEN d < 0 THEN 'negative' ELSE 'fine' END AS issue FROM v)
        SELECT issue, count(*) AS n, round(sum(CASE WHEN issue = 'fine' THEN d ELSE 0 END), 4) AS total FROM w GROUP BY issue""",
    "kv_reuse_segments": f"""WITH t AS (SELECT data_source, conversation_id, session_id, turn_index, CAST(lower(trim(role)) = 'assistant' AS INT) AS o, {WORDS_SQL.format(c="coalesce(preview_text, '')")} AS s FROM {LAST_TURNS_SQL}),
        b AS (SELECT *, CASE WHEN o = 0 AND coalesce(lag(o) OVER w, 0) = 1 THEN 1 ELSE 0 END AS b FROM t WINDOW w AS (PARTITION BY data_source, conversation_id, session_id ORDER BY turn_index)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY data_source, conversation_id, session_id ORDER BY turn_index) AS segment FROM b)
        SELECT data_source, conversation_id, session_id, CAST(segment AS BIGINT) AS segment, CAST(coalesce(sum(s) FILTER (o = 0), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(s) FILTER (o = 1), 0) AS BIGINT) AS output_tokens
        FROM g GROUP BY 1, 2, 3, 4 HAVING max(o) = 1 OR segment = 0""",
    "usage_fold": f"""SELECT dataset_source, count(*) AS num_calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
        round(sum(coalesce(input_tokens, 0) * pin + coalesce(output_tokens, 0) * pout), 3) AS api_cost, count(DISTINCT (pin, pout)) > 1 AS price_changed FROM {_PRICED_SQL} GROUP BY dataset_source""",
}
