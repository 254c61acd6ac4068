"""Answer text over ``answers``, ``questions``, ``judgements``: extraction, normalisation, scores, judge replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions import judging, text as T
from memloom.functions.stemming import stems
from memloom.operators import datasets
from memloom.operators.evaluation import last_record, reference_rows
from memloom.session import table

# Answers wrapped as a policy would write them, in several valid and invalid ways.
_WRAPPED_SQL = """CASE answer_id % 5 WHEN 0 THEN '<tool_response><answer>z</answer></tool_response> ok <answer> ' || coalesce(text, '') || ' </answer>'
  WHEN 1 THEN '<answer>' || coalesce(text, '') || '</answer> tail' WHEN 2 THEN coalesce(text, '') WHEN 3 THEN '<tool_response> kept ' || answer_id || ' </tool_response>' || coalesce(text, '')
  ELSE '<answer>a</answer><answer>' || coalesce(text, '') || '</answer>' END"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("answer_id", F.expr(_WRAPPED_SQL).alias("solution"))


def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tagged_answer(F.col("solution"))
    return _wrapped(spark, sf_dir).select("answer_id", t["answer"].alias("answer"), t["valid"].alias("valid"))


def answer_model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.answer_model_output(F.col("solution"))
    return _wrapped(spark, sf_dir).select("answer_id", o["answer"].alias("answer"), o["outcome"].alias("outcome"))


def policy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("answer_id", F.array_join(T.evidence(F.col("solution")), "|").alias("evidence"), F.size(T.evidence(F.col("solution"))).alias("n"))


def final_answer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.split_final_answer(F.col("solution"))
    return _wrapped(spark, sf_dir).select("answer_id", s["prefix"].alias("prefix"), s["answer"].alias("answer"))


def _normalized(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "answers").select("answer_id", f(F.col("text")).alias("normalized"))

    return query


answer_normalize_d1, answer_normalize_d2, answer_normalize_d3 = map(_normalized, (T.normalize_d1, T.normalize_d2, T.normalize_d3))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the references of their question (its last sent row)."""
    refs = reference_rows(table(spark, sf_dir, "questions")).select("question_id", "question_type", "reference_answers")
    return table(spark, sf_dir, "answers").select("answer_id", "question_id", "text").join(refs, "question_id")


def token_f1_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(T.normalize_d3(F.regexp_replace(T.text(F.col("text")), "</?answer>", " ")))
    s = _scored(spark, sf_dir).withColumn("t", t).withColumn("r", F.transform("reference_answers", lambda r: T.tokens(T.normalize_d3(r))))
    f1 = T.best(F.col("r"), lambda r: T.f1_of_tokens(F.col("t"), r))
    return s.select("answer_id", F.round(f1, 6).alias("f1"))


def token_f1_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stems(T.tokens(T.normalize_d1(F.regexp_replace(T.text(F.col("text")), "</?answer>", " "))))
    s = _scored(spark, sf_dir).withColumn("t", t).select("answer_id", "t", F.explode("reference_answers").alias("ref"))
    s = s.withColumn("r", stems(T.tokens(T.normalize_d1(F.col("ref")))))
    f1 = T.f1_of_tokens(F.col("t"), F.col("r"), empty="equal")
    return s.groupBy("answer_id").agg(F.round(F.max(f1), 6).alias("f1"))


def exact_and_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.normalize_d3(F.regexp_replace(T.text(F.col("text")), "</?answer>", " "))
    s = _scored(spark, sf_dir).withColumn("p", p).withColumn("r", F.transform("reference_answers", T.normalize_d3))
    return s.select("answer_id", F.exists("r", lambda r: r == F.col("p")).alias("exact"), F.exists("r", lambda r: (r != "") & F.col("p").contains(r)).alias("contained"))


def refusal_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("answer_id", T.is_insufficient(F.col("text")).alias("insufficient"))


def abstention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    abstain = T.collapse(F.lower(T.text(F.col("question_type")))) == "refusal"
    return s.groupBy(abstain.alias("abstention")).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_insufficient(F.col("text"))).alias("insufficient"))


def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = last_record(table(spark, sf_dir, "questions").filter("answer_variant = 'mcq'").select("question_id", "ingested_at", "row_id", "ground_truth"), "question_id", ["ingested_at", "row_id"])
    a = table(spark, sf_dir, "answers").select("answer_id", "question_id", "text").join(q, "question_id")
    v = F.try_parse_json("ground_truth")
    said = F.upper(T.strip(F.regexp_replace(T.text(F.col("text")), "</?answer>", " ")))
    right = F.upper(T.strip(F.try_variant_get(v, "$.answer", "string")))
    valid = F.array_contains(F.try_variant_get(v, "$.valid_choices", "array<string>"), right)
    return a.select("answer_id", (said == right).alias("correct"), valid.alias("valid_truth"))


def tool_call_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_TOOL_SQL).alias("t")).select("event_id", T.tool_calls_valid(F.col("t")).alias("valid"), T.tool_calls_valid(F.col("t"), required=True).alias("valid_required"))


_TOOL_SQL = """CASE event_id % 6 WHEN 0 THEN 'no call' WHEN 1 THEN '<tool_call>{"name": "retrieve_memory", "arguments": {"retrieval_query": "' || event_type || '"}}</tool_call>'
  WHEN 2 THEN '<tool_call>{"name": "runtime_memory", "arguments": {"retrieval_query": "q", "instruction": "i", "model": ""}}</tool_call>' WHEN 3 THEN '<tool_call>{"name": "other"}</tool_call>'
  WHEN 4 THEN '<tool_call>not json</tool_call>' ELSE '<tool_call>{"name": "retrieve_memory", "arguments": {"retrieval_query": " "}}' END"""


def json_reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.references(F.col("ground_truth"))
    return table(spark, sf_dir, "questions").select("row_id", F.size(r).alias("n"), F.array_join(r, "|").alias("refs"))


def metric_component_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.metric_component(F.concat_ws(" / ", "p_name", "p_brand")).alias("component"), T.identifier(F.col("p_brand")).alias("identifier"))


def one_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse(T.text(F.col("text"))), 256).alias("sha"), F.length(T.collapse(T.text(F.col("text")))).alias("n"))


def mcq_rotation_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = datasets.rotations(p, "p_partkey", F.col("p_name"), F.array(F.lit("x"), F.col("p_brand"), F.col("p_type")))
    c = F.col("choices")
    return r.select("p_partkey", "rotation_index", "answer", c["A"].alias("a"), c["B"].alias("b"), c["C"].alias("c"), c["D"].alias("d"))


def protocol_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    return q.groupBy(datasets.route_of(F.col("dataset_source")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def paired_variants_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios that have an mcq or an open file, but not both."""
    m = table(spark, sf_dir, "memeye_records").select("scenario_id", F.lower(F.trim("answer_variant")).alias("v"))
    return datasets.paired(m.filter("v = 'mcq'"), m.filter("v = 'open'"), ["scenario_id"])


def judge_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judging.parsed_reply(F.col("raw_response"), "graded")
    return table(spark, sf_dir, "judgements").select("judgement_id", r["score"].alias("score"), r["label"].alias("label"), r["reasoning"].alias("reasoning"), r["problem"].alias("problem"))


def judge_score_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgements")
    return j.select("judgement_id", judging.snapped(F.col("score"), judging.GRADED).alias("snapped"), judging.quantized(F.col("score")).alias("quantized"), judging.graded_label(judging.snapped(F.col("score"), judging.GRADED)).alias("label"))


QUERIES = {
    **{
        f.__name__: f
        for f in (
            answer_extraction, answer_model_outcomes, policy_evidence, final_answer_split, token_f1_unstemmed, token_f1_stemmed, exact_and_contained, refusal_detection,
            abstention_scores, mcq_accuracy, tool_call_format, json_reference_parse, metric_component_clean, one_line_text, mcq_rotation_explode, protocol_routing,
            paired_variants_check, judge_reply_parse, judge_score_snap,
        )
    },
    "answer_normalize_d1": answer_normalize_d1,
    "answer_normalize_d2": answer_normalize_d2,
    "answer_normalize_d3": answer_normalize_d3,
}

# SQL without look-around: borders are matched and put back, twice for neighbours.
_W = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _twice(sql: str, pattern: str, new: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '{pattern}', '{new}', 'g'), '{pattern}', '{new}', 'g')"


def _collapse(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{_W}+', ' ', 'g'))"


def _points(sql: str, chars: str) -> str:
    """Points between digits to control characters; each kind alone, as matches may share a digit."""
    out = sql
    for k, c in enumerate(chars):
        out = _twice(out, rf"(\p{{Nd}})\{c}(\p{{Nd}})", f"\\1{chr(1 + k)}\\2")
    return out


_PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~]"
_D1 = _collapse(f"replace(regexp_replace({_points(_twice('lower({c})', _B + '(?:a|an|the|and)' + _E, chr(92) + '1 ' + chr(92) + '2'), '.')}, '{_PUNCT}', ' ', 'g'), chr(1), '.')")
_D2 = _collapse(f"replace(regexp_replace({_points(_twice('lower({c})', _B + '(?:a|an|the)' + _W + r'+([\p{L}\p{N}_])', chr(92) + '1 ' + chr(92) + '2'), '.')}, '{_PUNCT}', ' ', 'g'), chr(1), '.')")
_D3 = "replace(replace(regexp_replace(" + _points("lower({c})", "./") + ", '" + _PUNCT.replace("`", "_`") + "', ' ', 'g'), chr(1), '.'), chr(2), '/')"
_D3 = _collapse(_twice(_twice(_D3, _B + "a(" + _W + "+[a-z])", r"\1 \2"), _B + "(?:an|the)" + _E, r"\1 \2"))


def _d(template: str, sql: str) -> str:
    return template.replace("{c}", sql)


_PLAIN = "regexp_replace(coalesce(text, ''), '</?answer>', ' ', 'g')"
_LASTQ = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ingested_at DESC, row_id DESC) AS rn FROM questions) WHERE rn = 1)"
_TOK = "list_filter(string_split({x}, ' '), lambda z: z <> '')"
_INSUFFICIENT_SQL = "|".join(T.INSUFFICIENT).replace("'", "''")
_FINAL = r"regexp_replace(s, '(?is)^.*</tool_response>', '')"
_POLICY = r"regexp_replace(s, '(?is)<tool_response>.*?</tool_response>', '', 'g')"
_BLOCKS = r"regexp_extract_all({x}, '(?s)<answer>\s*(.*?)\s*</answer>', 1)"
_VALID = rf"(len(regexp_extract_all({_POLICY}, '(?i)</?answer\b')) = 2 AND len({_BLOCKS.format(x=_POLICY)}) = 1 AND len({_BLOCKS.format(x=_FINAL)}) = 1 AND regexp_matches({_FINAL}, '(?s)</answer>\s*$'))"


def _strip(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{_W}+', ''), '{_W}+$', '')"


_ALL_BLOCKS = r"list_filter(list_transform(regexp_extract_all(s, '(?is)<answer>\s*(.*?)\s*</answer>', 1), lambda z: " + _collapse("z") + "), lambda z: z <> '')"

ORACLES = {
    "answer_extraction": f"WITH t AS (SELECT answer_id, {_WRAPPED_SQL} AS s FROM answers) SELECT answer_id, CASE WHEN {_VALID} THEN {_collapse(_BLOCKS.format(x=_FINAL) + '[1]')} END AS answer, {_VALID} AS valid FROM t",
    "answer_model_outcomes": f"""WITH r AS (SELECT answer_id, {_strip(_WRAPPED_SQL)} AS s FROM answers),
        t AS (SELECT *, CASE WHEN {_VALID} THEN {_collapse(_BLOCKS.format(x=_FINAL) + '[1]')} ELSE '' END AS strict, {_ALL_BLOCKS} AS blocks, {_collapse("regexp_replace(s, '(?i)</?answer" + chr(92) + "b[^>]*>', '', 'g')")} AS plain FROM r)
        SELECT answer_id, CASE WHEN s = '' THEN '' WHEN strict <> '' THEN strict WHEN len(blocks) > 0 THEN blocks[-1] ELSE plain END AS answer,
        CASE WHEN s = '' THEN 'empty_response' WHEN strict <> '' THEN 'strict_tagged' WHEN len(blocks) > 0 THEN 'recovered_tagged' WHEN plain = '' THEN 'empty_tagged' ELSE 'plain_text_wrapped' END AS outcome FROM t""",
    "policy_evidence": f"""WITH t AS (SELECT answer_id, list_filter(list_transform(regexp_extract_all({_WRAPPED_SQL}, '(?is)<tool_response>(.*?)</tool_response>', 1), lambda z: {_strip('z')}), lambda z: z <> '') AS e FROM answers)
        SELECT answer_id, array_to_string(e, '|') AS evidence, CAST(len(e) AS INT) AS n FROM t""",
    "final_answer_split": f"""WITH t AS (SELECT answer_id, {_WRAPPED_SQL} AS s FROM answers)
        SELECT answer_id, CASE WHEN {_VALID} THEN substr(s, 1, length(s) - length({_FINAL}) + instr({_FINAL}, '<answer>') - 1) END AS prefix, CASE WHEN {_VALID} THEN {_strip(_BLOCKS.format(x=_FINAL) + '[1]')} END AS answer FROM t""",
    "answer_normalize_d1": f"SELECT answer_id, {_d(_D1, 'coalesce(text, chr(0))').replace('chr(0)', repr(''))} AS normalized FROM answers",
    "answer_normalize_d2": f"SELECT answer_id, {_d(_D2, 'coalesce(text, chr(0))').replace('chr(0)', repr(''))} AS normalized FROM answers",
    "answer_normalize_d3": f"SELECT answer_id, {_d(_D3, 'coalesce(text, chr(0))').replace('chr(0)', repr(''))} AS normalized FROM answers",
    "token_f1_unstemmed": f"""WITH p AS (SELECT answer_id, question_id, {_TOK.format(x=_d(_D3, _PLAIN))} AS t FROM answers), q AS (SELECT question_id, unnest(reference_answers) AS ref FROM {_LASTQ}),
        r AS (SELECT question_id, {_TOK.format(x=_d(_D3, 'ref'))} AS r FROM q), j AS (SELECT answer_id, t, r, list_sum(list_transform(list_distinct(t), lambda x: least(len(list_filter(t, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) AS b FROM p JOIN r USING (question_id)),
        f AS (SELECT answer_id, CASE WHEN len(t) = 0 OR len(r) = 0 OR coalesce(b, 0) = 0 THEN 0 ELSE 2 * (b / len(t)) * (b / len(r)) / (b / len(t) + b / len(r)) END AS f FROM j)
        SELECT answer_id, round(max(f), 6) AS f1 FROM f GROUP BY answer_id""",
    "exact_and_contained": f"""WITH p AS (SELECT answer_id, question_id, {_d(_D3, _PLAIN)} AS p FROM answers), q AS (SELECT question_id, unnest(reference_answers) AS ref FROM {_LASTQ}), r AS (SELECT question_id, {_d(_D3, 'ref')} AS r FROM q)
        SELECT answer_id, bool_or(p = r) AS exact, bool_or(r <> '' AND contains(p, r)) AS contained FROM p JOIN r USING (question_id) GROUP BY answer_id""",
    "refusal_detection": f"SELECT answer_id, t = '' OR regexp_matches(t, '{_INSUFFICIENT_SQL}') AS insufficient FROM (SELECT answer_id, {_collapse('''lower(coalesce(text, ''))''')} AS t FROM answers)",
    "abstention_scores": f"""WITH a AS (SELECT question_id, {_collapse('''lower(coalesce(text, ''))''')} AS t FROM answers)
        SELECT {_collapse('''lower(coalesce(question_type, ''))''')} = 'refusal' AS abstention, count(*) AS n, count(*) FILTER (t = '' OR regexp_matches(t, '{_INSUFFICIENT_SQL}')) AS insufficient FROM a JOIN {_LASTQ} USING (question_id) GROUP BY 1""",
    "mcq_accuracy": f"""WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ingested_at DESC, row_id DESC) AS rn FROM questions WHERE answer_variant = 'mcq') WHERE rn = 1)
        SELECT answer_id, upper({_strip(_PLAIN)}) = upper(json_extract_string(ground_truth, '$.answer')) AS correct, list_contains(CAST(json_extract(ground_truth, '$.valid_choices') AS VARCHAR[]), upper(json_extract_string(ground_truth, '$.answer'))) AS valid_truth
        FROM answers JOIN q USING (question_id)""",
    "tool_call_format": "SELECT event_id, event_id % 6 IN (0, 1) AS valid, event_id % 6 = 1 AS valid_required FROM events",
    "json_reference_parse": f"""WITH t AS (SELECT row_id, CAST(json_extract(ground_truth, '$.answers') AS VARCHAR[]) AS a, json_extract_string(ground_truth, '$.answer') AS b FROM questions),
        r AS (SELECT row_id, list_filter(list_transform(CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN [b] ELSE [] END, lambda z: {_strip('z')}), lambda z: z <> '') AS r FROM t)
        SELECT row_id, CAST(len(r) AS INT) AS n, array_to_string(r, '|') AS refs FROM r""",
    "metric_component_clean": r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(concat_ws(' / ', p_name, p_brand), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown') AS component, replace(lower(trim(p_brand)), '-', '_') AS identifier FROM part""",
    "one_line_text": f"SELECT doc_id, sha256(t) AS sha, CAST(length(t) AS INT) AS n FROM (SELECT doc_id, {_collapse('''coalesce(text, '')''')} AS t FROM documents)",
    "mcq_rotation_explode": """WITH r AS (SELECT p_partkey, p_name AS n, 'x' AS o0, p_brand AS o1, p_type AS o2, CAST(unnest(range(4)) AS INT) AS rotation_index FROM part)
        SELECT p_partkey, rotation_index, chr(CAST(65 + rotation_index AS INT)) AS answer, CASE WHEN rotation_index = 0 THEN n ELSE o0 END AS a, CASE rotation_index WHEN 0 THEN o0 WHEN 1 THEN n ELSE o1 END AS b,
        CASE rotation_index WHEN 3 THEN o2 WHEN 2 THEN n ELSE o1 END AS c, CASE WHEN rotation_index = 3 THEN n ELSE o2 END AS d FROM r""",
    "protocol_routing": """SELECT CASE WHEN contains(s, 'worldmemarena') THEN 'worldmemarena' WHEN contains(s, 'h2hmem') THEN 'h2hmem' WHEN contains(s, 'mem_gallery') THEN 'mem_gallery' WHEN contains(s, 'memeye') THEN 'memeye' WHEN contains(s, 'memlens') THEN 'memlens' END AS route, count(*) AS n
        FROM (SELECT replace(lower(trim(coalesce(dataset_source, ''))), '-', '_') AS s FROM questions) GROUP BY 1""",
    "paired_variants_check": """WITH m AS (SELECT scenario_id, lower(trim(answer_variant)) AS v FROM memeye_records)
        SELECT scenario_id, 'left' AS only_in FROM (SELECT scenario_id FROM m WHERE v = 'mcq' EXCEPT SELECT scenario_id FROM m WHERE v = 'open') UNION ALL
        SELECT scenario_id, 'right' FROM (SELECT scenario_id FROM m WHERE v = 'open' EXCEPT SELECT scenario_id FROM m WHERE v = 'mcq')""",
    "judge_score_snap": """SELECT judgement_id, s AS snapped, CASE WHEN score < 0.25 THEN 0.0 WHEN score < 0.75 THEN 0.5 WHEN score IS NOT NULL THEN 1.0 END::DOUBLE AS quantized,
        CASE s WHEN 0 THEN 'Incorrect' WHEN 0.25 THEN 'Poor' WHEN 0.5 THEN 'Partial' WHEN 0.75 THEN 'Good' WHEN 1 THEN 'Correct' END AS label
        FROM (SELECT *, CASE WHEN abs(score - round(score * 4) / 4) < 1e-8 AND score BETWEEN -1e-8 AND 1 + 1e-8 THEN round(score * 4) / 4 END AS s FROM judgements)""",
    "judge_reply_parse": """WITH t AS (SELECT judgement_id, CASE WHEN json_valid(raw_response) AND json_type(raw_response) = 'OBJECT' THEN raw_response
          WHEN json_valid(raw_response) THEN NULL WHEN json_valid(regexp_extract(raw_response, '(?s)\\{.*\\}')) AND regexp_extract(raw_response, '(?s)\\{.*\\}') <> '' THEN regexp_extract(raw_response, '(?s)\\{.*\\}') END AS v FROM judgements),
        u AS (SELECT judgement_id, v, TRY_CAST(json_extract_string(v, '$.score') AS DOUBLE) AS n, trim(coalesce(json_extract_string(v, '$.reasoning'), '')) AS reasoning, nullif(trim(coalesce(json_extract_string(v, '$.label'), '')), '') AS l FROM t),
        w AS (SELECT *, CASE WHEN n IN (0, 0.25, 0.5, 0.75, 1) THEN n END AS s FROM u)
        SELECT judgement_id, s AS score, CASE WHEN s IS NOT NULL THEN coalesce(l, CASE s WHEN 0 THEN 'Incorrect' WHEN 0.25 THEN 'Poor' WHEN 0.5 THEN 'Partial' WHEN 0.75 THEN 'Good' WHEN 1 THEN 'Correct' END) END AS label,
        CASE WHEN s IS NOT NULL THEN reasoning END AS reasoning, CASE WHEN v IS NULL THEN 'no object' WHEN s IS NULL THEN 'score out of domain' END AS problem FROM w""",
}
