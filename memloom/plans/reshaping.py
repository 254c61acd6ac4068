"""Row-level reshaping over ``turns``, ``questions``, ``answers`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions.text import text
from memloom.functions.coerce import nonnegative_int
from memloom.functions.resources import affine_latency, raw_cost
from memloom.operators import calls as C, rows as R
from memloom.plans.answers import _collapse, _strip
from memloom.plans.calls import PROFILE_SQL, profiles
from memloom.session import table


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").filter(F.size("images") > 0)
    ims = F.transform("images", lambda im, i: im.withField("id", F.when(i % 2 == 0, im["id"])))
    out = R.image_records(ims, "img", "memory")
    return t.select("row_id", F.array_join(F.transform(out, lambda i: F.concat(i["id"], F.lit("="), i["caption"])), "|").alias("images"), F.size(F.filter(out, R.is_query_image)).alias("query_images"))


def evidence_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").filter(F.size("images") > 0)
    out = R.evidence_images(F.array("images", F.slice("images", 1, 1)), F.slice("images", 1, 2))
    return t.select("row_id", F.size(out).alias("n"), F.array_join(F.transform(out, lambda i: i["id"]), ",").alias("ids"))


def numbered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    return q.select("row_id", R.numbered_evidence(F.col("reference_answers")).alias("evidence"), R.direct_result(F.col("reference_answers")).alias("direct"))


def memory_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns")
    return t.select("row_id", F.sha2(R.memory_view(F.col("preview_text"), F.col("protected_preview_text")), 256).alias("view_sha"))


def ground_truth_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").filter("choices is not null")
    return q.select("row_id", R.choice_truth(F.col("answer"), F.col("choices")).alias("truth"), R.ground_truth(F.col("reference_answers")).alias("open_truth"))


def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").filter("conversation_id is not null")
    return q.select("row_id", R.question_id(F.col("conversation_id"), F.col("record_index"), F.col("checkpoint_id")).alias("derived"))


def argument_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_QUERY_SQL).alias("q"), F.col("event_type").alias("m"), k.alias("k"))
    return e.select("event_id", R.argument_problem(F.col("q"), F.col("m"), ["click", "view", "purchase"], F.col("k") - 5).alias("problem"))


_QUERY_SQL = "CASE event_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN repeat('q', 600) WHEN 2 THEN 'x </answer> y' ELSE 'what was said' END"


def policy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    m = R.policy_model(F.when(F.col("answer_id") % 3 == 0, F.col("answer_model")), F.when(F.col("answer_id") % 2 == 0, F.lit("Policy_Model")).otherwise(F.lit("own")), "small")
    return a.select(m.alias("m")).groupBy("m.model", "m.origin").agg(F.count(F.lit(1)).alias("n"))


def merged_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select("answer_id", "row_key", F.concat(F.lit("seen "), "question_id").alias("prefix"))
    j = table(spark, sf_dir, "judgements").filter("row_key is not null").groupBy("row_key").agg(F.max("reasoning").alias("reply"))
    return R.merged_replacement(a, j, "row_key", "prefix", "reply").select("answer_id", "solution", "replaced")


def probe_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    return a.select("answer_id", R.probe_solution(F.col("text")).alias("probe"), R.external_result(F.col("text")).alias("external"))


def composed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").select("event_id", k.alias("k"), "value", "event_type")
    r = R.composed_reward(F.col("k") / 100, F.col("event_type") != "error", F.array(-F.col("value"), F.col("k"), F.lit(-1.5)), F.col("k") - 50)
    return e.select("event_id", F.round(r["score"], 6).alias("score"), F.round(r["cost"], 6).alias("cost"))


def stage_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return R.stages(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", F.col("stage").cast("bigint").alias("stage"))


def reward_on_last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.reward_on_last(e, "user_id", "event_id", F.col("event_type") != "error", "value").select("event_id", "token_reward")


def trajectory_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation as a trajectory: priced cost of its answers as calls, latency along the critical path with a stage per question
    type, and the part of the model it used most."""
    p = F.broadcast(profiles(spark)).alias("p")
    a = table(spark, sf_dir, "answers").filter("conversation_id is not null").join(p, F.lower(F.trim("answer_model")) == F.col("p.identifier"))
    i, o = nonnegative_int(F.col("input_tokens")), nonnegative_int(F.col("output_tokens"))
    c = a.select(F.col("conversation_id").alias("trajectory"), F.col("answer_id").alias("call_index"), (F.col("answer_id") % 4).alias("stage"), raw_cost("p", i, o).alias("raw"), affine_latency("p", F.lit(1), i, o, F.lit(0)).alias("latency"))
    cost = c.groupBy("trajectory").agg(F.sum("raw").alias("raw_cost"), F.count(F.lit(1)).alias("calls"))
    path = C.critical_path(c, F.when(F.col("stage") > 0, F.col("stage")), F.col("latency"))
    out = cost.join(path, "trajectory")
    return out.select("trajectory", "calls", "stages", F.round("raw_cost", 3).alias("raw_cost"), F.round("critical_path_latency", 5).alias("critical_path_latency"))


def answer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    v = F.when(F.col("row_id") % 3 == 0, F.to_json("reference_answers")).otherwise(F.col("answer"))
    return q.select("row_id", R.answer_value(v).alias("value"))


def safe_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").select("row_id", F.posexplode("images").alias("pos", "im"))
    p = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("../"), text(F.col("im.path")))).otherwise(text(F.col("im.path")))
    return t.select("row_id", "pos", R.safe_path(p).alias("safe"))


def rollout_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    s = R.sample_text(F.col("answer_id"), F.col("row_key"), F.col("question_id"), F.col("text"), F.coalesce("observed_wall_time_seconds", F.lit(0.0)))
    return a.select("answer_id", F.sha2(s, 256).alias("sha"), F.size(F.split(s, "\n")).alias("lines"))


def split_written_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").select("row_id", F.struct(F.lit("x").alias("kept"), F.lit("").alias("split"), F.struct(F.col("conversation_id"), F.lit("").alias("split"), F.lit(1).alias("scratch")).alias("extra_info")).alias("r"))
    r = R.with_split(R.without(F.col("r"), "extra_info.scratch"), F.lit("val"))
    return q.select("row_id", F.to_json(r).alias("row"))


QUERIES = {
    f.__name__: f
    for f in (
        image_records, evidence_images, numbered_evidence, memory_views, ground_truth_payloads, question_ids, argument_guards, policy_precedence, merged_replacements,
        probe_solutions, composed_rewards, stage_numbers, reward_on_last_token, trajectory_resources, answer_values, safe_image_paths, rollout_samples, split_written_in_row,
    )
}

_PRICED = f"(SELECT a.*, p.*, greatest(coalesce(input_tokens, 0), 0) AS i, greatest(coalesce(output_tokens, 0), 0) AS o FROM answers a JOIN {PROFILE_SQL} p ON lower(trim(answer_model)) = identifier WHERE conversation_id IS NOT NULL)"
_REFS = f"list_filter(list_transform(reference_answers, lambda x: {_strip('coalesce(x, chr(0))').replace('chr(0)', repr(''))}), lambda x: x <> '')"

ORACLES = {
    "image_records": """SELECT row_id, array_to_string(list_transform(images, lambda im, i: CASE WHEN i % 2 = 1 AND coalesce(trim(im.id), '') <> '' THEN trim(im.id) ELSE printf('img_%04d', i - 1) END || '=' || trim(coalesce(im.caption, ''))), '|') AS images,
        CAST(len(list_filter(images, lambda im, i: i % 2 = 1 AND (im.id = 'query_image' OR starts_with(im.id, 'query_image_')))) AS INT) AS query_images FROM turns WHERE len(images) > 0""",
    "evidence_images": """WITH t AS (SELECT row_id, list_transform(list_concat(images, images[1:1], images[1:2]), lambda i: coalesce(i.id, '')) AS ids FROM turns WHERE len(images) > 0)
        SELECT row_id, CAST(len(list_filter(ids, lambda x, i: list_position(ids, x) = i)) AS INT) AS n, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS ids FROM t""",
    "numbered_evidence": f"""SELECT row_id, array_to_string(list_transform({_REFS}, lambda x, i: '[Evidence ' || i || ']' || chr(10) || x), chr(10) || chr(10)) AS evidence,
        coalesce(nullif(array_to_string({_REFS}, chr(10) || chr(10)), ''), 'No memory items.') AS direct FROM questions""",
    "memory_views": f"SELECT row_id, sha256(concat_ws(chr(10) || chr(10), nullif({_strip('preview_text')}, ''), nullif({_strip('protected_preview_text')}, ''))) AS view_sha FROM turns",
    "question_ids": "SELECT row_id, CASE WHEN checkpoint_id IS NULL THEN printf('%s_q%04d', conversation_id, record_index) ELSE printf('%s:%s:Q%03d', conversation_id, checkpoint_id, record_index) END AS derived FROM questions WHERE conversation_id IS NOT NULL",
    "argument_guards": f"""SELECT event_id, CASE WHEN trim(q) = '' THEN 'missing query' WHEN length(q) > 512 THEN 'query too long' WHEN contains(q, '</answer') THEN 'answer tag in query' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown model'
        WHEN k - 5 <= 0 THEN 'no items' END AS problem FROM (SELECT event_id, event_type, {_QUERY_SQL} AS q, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "policy_precedence": f"""SELECT model, origin, count(*) AS n FROM (SELECT CASE WHEN a IS NOT NULL THEN a WHEN answer_id % 2 = 1 THEN 'own' ELSE 'small' END AS model, CASE WHEN a IS NOT NULL THEN 'answer_model' WHEN answer_id % 2 = 1 THEN 'policy_trace_model' ELSE 'default_policy_model' END AS origin
        FROM (SELECT answer_id, CASE WHEN answer_id % 3 = 0 THEN nullif({_strip('answer_model')}, '') END AS a FROM answers)) GROUP BY 1, 2""",
    "merged_replacements": """WITH j AS (SELECT row_key, max(reasoning) AS reply FROM judgements WHERE row_key IS NOT NULL GROUP BY 1)
        SELECT answer_id, CASE WHEN reply IS NOT NULL THEN 'seen ' || question_id || '<answer>' || reply || '</answer>' ELSE 'seen ' || question_id END AS solution, reply IS NOT NULL AS replaced FROM answers LEFT JOIN j USING (row_key)""",
    "probe_solutions": f"""WITH t AS (SELECT answer_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '(?is)</answer>.*$', '') AS h FROM answers)
        SELECT answer_id, '<answer>' || {_collapse("regexp_replace(h, '(?i)</?answer[^>]*>', ' ', 'g')")} || '</answer>' AS probe, CASE WHEN {_strip('t')} = '' OR regexp_matches(t, '(?i)</?answer' || chr(92) || 'b') THEN '[invalid result]' ELSE {_strip('t')} END AS external FROM t""",
    "composed_rewards": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
        SELECT event_id, round(CASE WHEN event_type <> 'error' THEN k / 100 ELSE -1 END, 6) AS score, round(greatest(0, value) + greatest(0, -k) + 1.5 + greatest(k - 50, 0), 6) AS cost FROM e""",
    "stage_numbers": "SELECT event_id, CAST(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stage FROM events",
    "reward_on_last_token": "SELECT event_id, CASE WHEN event_id = max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) THEN value ELSE 0 END AS token_reward FROM events",
    "trajectory_resources": f"""WITH c AS (SELECT conversation_id AS trajectory, answer_id, nullif(answer_id % 4, 0) AS stage, i * pin + o * pout AS raw, lbase + i * lin + o * lout AS latency FROM {_PRICED}),
        p AS (SELECT trajectory, sum(l) AS path, count(*) AS stages FROM (SELECT trajectory, coalesce('s' || stage, 'c' || answer_id) AS k, max(latency) AS l FROM c GROUP BY 1, 2) GROUP BY 1)
        SELECT trajectory, count(*) AS calls, max(stages) AS stages, round(sum(raw), 3) AS raw_cost, round(max(path), 5) AS critical_path_latency FROM c JOIN p USING (trajectory) GROUP BY 1""",
    "answer_values": f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN array_to_string({_REFS}, ', ') ELSE {_strip('''coalesce(answer, '')''')} END AS value FROM questions",
    "safe_image_paths": """WITH t AS (SELECT row_id, unnest(images) AS im, generate_subscripts(images, 1) - 1 AS pos FROM turns WHERE len(images) > 0), p AS (SELECT row_id, pos, CASE WHEN row_id % 5 = 0 THEN '../' || coalesce(im.path, '') ELSE coalesce(im.path, '') END AS p FROM t)
        SELECT row_id, CAST(pos AS INT) AS pos, trim(p) <> '' AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AS safe FROM p""",
    "split_written_in_row": """SELECT row_id, '{"kept":"x","split":"val","extra_info":{' || CASE WHEN conversation_id IS NULL THEN '' ELSE '"conversation_id":' || to_json(conversation_id) || ',' END || '"split":"val"}}' AS row FROM questions""",
    "ground_truth_payloads": """SELECT row_id, '{"variant":"mcq","answer":' || to_json(answer) || ',"valid_choices":' || to_json(list_sort(map_keys(choices))) || '}' AS truth, '{"answers":' || to_json(reference_answers) || '}' AS open_truth
        FROM questions WHERE choices IS NOT NULL""",
    "rollout_samples": f"""SELECT answer_id, sha256(s) AS sha, CAST(len(string_split(s, chr(10))) AS INT) AS lines FROM (SELECT answer_id, concat_ws(chr(10), printf('[step %d] %s', answer_id, row_key), 'prompt: ' || {_collapse("coalesce(question_id, '')")},
        'answer: ' || {_collapse("coalesce(text, '')")}, printf('score: %.4f', coalesce(observed_wall_time_seconds, 0))) AS s FROM answers)""",
}
