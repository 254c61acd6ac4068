"""Evaluation reports and resumable progress over ``answers``, ``questions`` and ``judgements``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions import text as T
from memloom.functions.coerce import nonnegative_int
from memloom.functions.resources import affine_latency, raw_cost
from memloom.operators import evaluation as E
from memloom.plans.answers import _ALL_BLOCKS, _BLOCKS, _D3, _FINAL, _LASTQ, _PLAIN, _TOK, _VALID, _collapse, _d, _strip
from memloom.plans.calls import PROFILE_SQL, profiles
from memloom.session import table


def last_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgements").select("row_key", "judged_at", "judgement_id", "status", "score", "label")
    return E.last_record(j, "row_key", ["judged_at", "judgement_id"])


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answer with its question's type, local F1, priced cost and latency, and last judgement."""
    refs = E.reference_rows(table(spark, sf_dir, "questions")).select("question_id", "question_type", "question_subtype", "reference_answers")
    a = table(spark, sf_dir, "answers").select("answer_id", "row_key", "dataset_source", "conversation_id", "question_id", "answer_model", "text", "input_tokens", "output_tokens")
    p = F.broadcast(profiles(spark)).alias("p")  # a fixed table of a few rows
    j = last_judgements(spark, sf_dir).select("row_key", F.col("status").alias("judge_status"), F.col("score").alias("judge_score"))
    r = a.join(refs, "question_id", "left").join(p, F.lower(F.trim("answer_model")) == F.col("p.identifier"), "left").join(j, "row_key", "left")
    i, o = nonnegative_int(F.col("input_tokens")), nonnegative_int(F.col("output_tokens"))
    t = T.tokens(T.normalize_d3(F.regexp_replace(T.text(F.col("text")), "</?answer>", " ")))
    r = r.withColumn("t", t).withColumn("refs", F.transform(F.coalesce("reference_answers", F.array().cast("array<string>")), lambda x: T.tokens(T.normalize_d3(x))))
    return r.select(
        "answer_id", "dataset_source", "conversation_id", "question_type", "question_subtype",
        T.best(F.col("refs"), lambda x: T.f1_of_tokens(F.col("t"), x)).alias("f1"),
        (raw_cost("p", i, o) / 1e6).alias("cost_usd"),
        affine_latency("p", F.lit(1), i, o, F.lit(0)).alias("latency"),
        "judge_status", "judge_score",
    )


def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.report(evaluation_rows(spark, sf_dir))
    digits = {"f1": 6, "cost_per_sample": 9, "latency": 6, "judge_score": 6}
    # Ties are lifted before rounding, so that the order of summation does not decide them.
    return out.select(*[F.round(F.col(c) + 1e-11, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def evaluation_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.report(evaluation_rows(spark, sf_dir))
    # Ties are lifted before digits are cut, so that the order of summation does not decide them.
    lift = {"f1": 1e-11, "cost_per_sample": 1e-13, "latency": 1e-11, "judge_score": 1e-11}
    return E.report_lines(m.select(*[(F.col(c) + lift[c]).alias(c) if c in lift else F.col(c) for c in m.columns]))


def sample_mean_of_query_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = E.sample_mean(j, F.col("l_extendedprice"), ["o_custkey"], ["o_orderpriority"])
    return out.select("o_orderpriority", "samples", F.round("mean_per_sample", 3).alias("mean_per_sample"))


def last_progress_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_judgements(spark, sf_dir).select("row_key", "judgement_id", "status")


def progress_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers still to be judged: those whose last record is not complete."""
    done = last_judgements(spark, sf_dir).filter("status = 'complete'").select("row_key")
    return table(spark, sf_dir, "answers").select("answer_id", "row_key").join(done, "row_key", "left_anti")


def judge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgements")
    return j.groupBy("protocol_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.coalesce("json_repaired", F.lit(False))).alias("repaired"),
        F.countDistinct("row_key").alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def replacement_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.answer_model_output(F.col("text"))["outcome"]
    return table(spark, sf_dir, "answers").groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def metric_publication_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type").distinct().join(table(spark, sf_dir, "region").select("r_name"))
    names = e.select(F.explode(F.array(
        F.concat(F.lit("val-aux/"), "r_name", F.lit("/"), "event_type", F.lit("/mean@4")), F.concat(F.lit("val-aux/"), "event_type", F.lit("/"), "r_name", F.lit("/f1/mean@1")),
        F.concat(F.lit("val-core/"), "r_name"), F.lit("val-aux/num_turns/mean"), F.lit("val-aux/num_turns/max"))).alias("name")).distinct()
    return E.published_metrics(names, "name", ("f1", "click"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row keys of answers: the question and the first 20 hex digits over what the row asks."""
    a = table(spark, sf_dir, "answers")
    body = F.concat_ws("\x1f", T.text(F.col("answer_model")), T.text(F.col("question_id")), T.text(F.col("messages")[F.size("messages") - 1]["content"]))
    return a.select("answer_id", F.concat(T.text(F.col("question_id")), F.lit(":"), F.substring(F.sha2(body, 256), 1, 20)).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        report_grouping_sets, evaluation_report_text, sample_mean_of_query_sum, last_progress_record, progress_resume_anti, judge_counters,
        replacement_counters, metric_publication_filter, cache_keys,
    )
}

_LASTJ = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY judged_at DESC NULLS LAST, judgement_id DESC) AS rn FROM judgements) WHERE rn = 1)"
_ROWS = f"""p AS (SELECT * FROM {PROFILE_SQL}), j AS (SELECT row_key, status, score FROM {_LASTJ}), q AS (SELECT * FROM {_LASTQ}),
  tq AS (SELECT question_id, {_TOK.format(x=_d(_D3, 'ref'))} AS r FROM (SELECT question_id, unnest(reference_answers) AS ref FROM q)),
  ta AS (SELECT answer_id, question_id, {_TOK.format(x=_d(_D3, _PLAIN))} AS t FROM answers),
  f AS (SELECT answer_id, max(CASE WHEN len(t) = 0 OR len(r) = 0 OR coalesce(b, 0) = 0 THEN 0 ELSE 2 * (b / len(t)) * (b / len(r)) / (b / len(t) + b / len(r)) END) AS f1 FROM
    (SELECT answer_id, t, r, list_sum(list_transform(list_distinct(t), lambda x: least(len(list_filter(t, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) AS b FROM ta JOIN tq USING (question_id)) GROUP BY answer_id),
  e AS (SELECT a.answer_id, a.dataset_source, a.conversation_id, q.question_type, q.question_subtype, coalesce(f.f1, 0) AS f1,
    (greatest(coalesce(input_tokens, 0), 0) * pin + greatest(coalesce(output_tokens, 0), 0) * pout) / 1e6 AS cost_usd,
    lbase + greatest(coalesce(input_tokens, 0), 0) * lin + greatest(coalesce(output_tokens, 0), 0) * lout AS latency, j.status AS judge_status, j.score AS judge_score,
    CASE WHEN replace(lower(trim(a.dataset_source)), '-', '_') IN ('h2hmem', 'h2hmem_dyadic', 'h2hmem_multiparty') THEN 'h2hmem' ELSE coalesce(nullif(trim(a.dataset_source), ''), 'unknown') END AS dataset
    FROM answers a LEFT JOIN q USING (question_id) LEFT JOIN p ON lower(trim(answer_model)) = identifier LEFT JOIN j ON j.row_key = a.row_key LEFT JOIN f ON f.answer_id = a.answer_id),
  k AS (SELECT *, dataset || '/' || coalesce(nullif(question_type, ''), 'unknown') || CASE WHEN coalesce(trim(question_subtype), '') <> '' THEN '/' || trim(question_subtype) ELSE '' END AS type_key FROM e)"""
_METRICS = """count(*) AS num_queries, count(DISTINCT (dataset_source, conversation_id)) AS num_samples, round(avg(f1) + 1e-11, 6) AS f1, round(sum(cost_usd) / count(DISTINCT (dataset_source, conversation_id)) + 1e-11, 9) AS cost_per_sample,
  round(avg(latency) + 1e-11, 6) AS latency, count(*) FILTER (judge_status = 'complete') AS judge_complete, count(*) FILTER (judge_status = 'pending') AS judge_pending, count(*) FILTER (judge_status = 'error') AS judge_error, round(avg(judge_score) + 1e-11, 6) AS judge_score"""

_EXACT = _METRICS.replace("round(avg(f1) + 1e-11, 6)", "avg(f1) + 1e-11").replace("round(sum(cost_usd)", "(sum(cost_usd)").replace(" + 1e-11, 9)", " + 1e-13)").replace("round(avg(latency) + 1e-11, 6)", "avg(latency) + 1e-11").replace("round(avg(judge_score) + 1e-11, 6)", "avg(judge_score) + 1e-11")


def _fixed(c: str, digits: int) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.{digits}f', {c}) END"


ORACLES = {
    "report_grouping_sets": f"WITH {_ROWS} SELECT 'overall' AS grain, 'overall' AS name, {_METRICS} FROM k UNION ALL SELECT 'dataset', dataset, {_METRICS} FROM k GROUP BY dataset UNION ALL SELECT 'type', type_key, {_METRICS} FROM k GROUP BY type_key",
    "evaluation_report_text": f"""WITH {_ROWS}, m AS (SELECT 'overall' AS grain, 'overall' AS name, {_EXACT} FROM k UNION ALL SELECT 'dataset', dataset, {_EXACT} FROM k GROUP BY dataset UNION ALL SELECT 'type', type_key, {_EXACT} FROM k GROUP BY type_key)
        SELECT grain, name, concat_ws(chr(10), '=== ' || name || ' ===', 'Queries: ' || num_queries, 'Samples: ' || num_samples, 'F1: ' || {_fixed('f1', 4)}, 'Judge: ' || {_fixed('judge_score', 4)} || ' (' || judge_complete || '/' || num_queries || ' successful)',
        'Cost: ' || {_fixed('cost_per_sample', 8)} || ' USD/sample', 'Latency: ' || {_fixed('latency', 4)} || ' s/query') AS report FROM m""",
    "replacement_counters": f"""WITH r AS (SELECT {_strip("coalesce(text, '')")} AS s FROM answers), t AS (SELECT s, CASE WHEN {_VALID} THEN {_collapse(_BLOCKS.format(x=_FINAL) + '[1]')} ELSE '' END AS strict, {_ALL_BLOCKS} AS blocks, {_collapse("regexp_replace(s, '(?i)</?answer" + chr(92) + "b[^>]*>', '', 'g')")} AS plain FROM r)
        SELECT CASE WHEN s = '' THEN 'empty_response' WHEN strict <> '' THEN 'strict_tagged' WHEN len(blocks) > 0 THEN 'recovered_tagged' WHEN plain = '' THEN 'empty_tagged' ELSE 'plain_text_wrapped' END AS outcome, count(*) AS n FROM t GROUP BY 1""",
    "sample_mean_of_query_sum": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS samples, round(sum(l_extendedprice) / count(DISTINCT o_custkey), 3) AS mean_per_sample FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "last_progress_record": f"SELECT row_key, judgement_id, status FROM {_LASTJ}",
    "progress_resume_anti": f"SELECT answer_id, row_key FROM answers WHERE row_key NOT IN (SELECT row_key FROM {_LASTJ} WHERE status = 'complete' AND row_key IS NOT NULL)",
    "judge_counters": "SELECT protocol_id, count(*) AS attempts, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (coalesce(json_repaired, false)) AS repaired, count(DISTINCT row_key) AS rows, round(avg(score), 6) AS mean_score FROM judgements GROUP BY 1",
    "metric_publication_filter": """WITH n AS (SELECT DISTINCT unnest(['val-aux/' || r_name || '/' || event_type || '/mean@4', 'val-aux/' || event_type || '/' || r_name || '/f1/mean@1', 'val-core/' || r_name, 'val-aux/num_turns/mean', 'val-aux/num_turns/max']) AS name
        FROM (SELECT DISTINCT event_type FROM events), region) SELECT name FROM n WHERE NOT starts_with(name, 'val-aux/') OR name = 'val-aux/num_turns/mean' OR regexp_extract(name, '([^/]+)/(mean@[^/]*)$', 1) IN ('f1', 'click')""",
    "cache_keys": """SELECT answer_id, coalesce(question_id, '') || ':' || substr(sha256(concat_ws(chr(31), coalesce(answer_model, ''), coalesce(question_id, ''), coalesce(messages[len(messages)].content, ''))), 1, 20) AS key FROM answers""",
}
