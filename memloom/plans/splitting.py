"""Splits, samples, set operations and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memloom.operators import checks as K, splitting as S
from memloom.session import table


def _label(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "valid", "validation", "dev"), "val").when(s == "test", "test")


_LABEL_SQL = "CASE WHEN lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))) IN ('train', 'training') THEN 'train' WHEN lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))) = 'test' THEN 'test' END"


def group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and questions without one: labelled groups keep their split, the others are split by hash; groups with conflicting
    labels, which a split refuses, are named."""
    g = S.split_groups(table(spark, sf_dir, "questions"), "conversation_id", "row_id", _label(F.col("split")))
    out = S.group_split(g.filter("not conflict"), "group_key", "label", 0.7, 0.1, "13", "conflict")
    return out.unionByName(g.filter("conflict").select("group_key", F.lit("conflict").alias("split")))


def split_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").filter("conversation_id is not null").select("dataset_source", "conversation_id", _label(F.col("split")).alias("label"))
    return K.inconsistent(q, ["dataset_source", "conversation_id"], ["label"])


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").select("conversation_id", _label(F.col("split")).alias("split")).filter("conversation_id is not null and split is not null")
    out = S.split_leaks(q, ["conversation_id"], "split")
    return out.select("conversation_id", F.array_join("splits", ",").alias("splits"))


def stratified_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, stratified by their source."""
    t = table(spark, sf_dir, "turns").select(F.concat_ws("/", "data_source", "conversation_id").alias("conversation"), "data_source").distinct()
    return S.stratified_split(t, "conversation", ["data_source"], 0.7, 0.1, "13")


def hash_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.permuted(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "order", ["p_brand"]).select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    w = W.partitionBy("s_nationkey").orderBy(*S.natural_key(F.col("s_name")))
    return s.select("s_suppkey", F.row_number().over(w).cast("bigint").alias("rank"))


def hash_sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_fixed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "sample")


def hash_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_share(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, "share")


def union_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and source over two prepared tables put together."""
    q = table(spark, sf_dir, "questions").select("split", F.col("dataset_source").alias("source"))
    d = table(spark, sf_dir, "documents").select(F.lit("train").alias("split"), "source")
    u = S.union_all({"questions": q, "documents": d})
    return u.groupBy("merged_from", "split", "source").agg(F.count(F.lit(1)).alias("n"))


def ordered_subset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that answers refer to, in the order of the first answer that does."""
    index = table(spark, sf_dir, "answers").groupBy("question_id").agg(F.min("answer_id").alias("pos"))
    return table(spark, sf_dir, "questions").select("row_id", "question_id").join(index, "question_id")


def unknown_question_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unknown_references(table(spark, sf_dir, "judgements"), "row_key", table(spark, sf_dir, "answers"), "row_key")


def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def repeated_turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.blank_or_repeated(table(spark, sf_dir, "turns"), ["data_source", "conversation_id", "session_id"], "turn_id")
    return out.select("data_source", "conversation_id", "session_id", "turn_id", "n", "blank")


def source_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that occur in documents and questions, or in one of them only."""
    d = table(spark, sf_dir, "documents").select("conversation_id").filter("conversation_id is not null")
    q = table(spark, sf_dir, "questions").select("conversation_id").filter("conversation_id is not null")
    both = d.intersect(q).withColumn("where", F.lit("both"))
    return both.union(d.subtract(q).withColumn("where", F.lit("documents"))).union(q.subtract(d).withColumn("where", F.lit("questions")))


def negative_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    return K.violating(a, (F.col("input_tokens") > 0) & (F.col("output_tokens") > 0) & (F.col("observed_wall_time_seconds") >= 0)).select("answer_id")


def cardinality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unlike_counts(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "r_name", {"AFRICA": 5, "ASIA": 4, "NOWHERE": 1})


QUERIES = {
    f.__name__: f
    for f in (
        group_split_hash, split_label_conflicts, split_leakage, stratified_split_hash, hash_permutation, natural_sort_rank, hash_sample_fixed, hash_bernoulli,
        union_merge_counts, ordered_subset_semi, unknown_question_references, dedupe_first_wins, repeated_turn_ids, source_set_operations, negative_measures, cardinality_check,
    )
}

def _holdout(strata: str, holdout: str, ratio: str) -> str:
    """(s, held): the largest marginal deficits, one at a time."""
    return f"""(WITH z AS (SELECT * FROM {strata}), w AS (SELECT {holdout} AS want, {ratio} AS ratio FROM c), t AS (SELECT want, ratio, want >= count(*) FILTER (n >= 2) AND sum(n) - want >= count(*) FILTER (n >= 2) AS paired FROM z, w GROUP BY want, ratio),
      l AS (SELECT s, n, CASE WHEN paired AND n >= 2 THEN 1 ELSE 0 END AS low, CASE WHEN paired AND n >= 2 THEN n - 1 ELSE n END AS high, want, ratio FROM z, t),
      j AS (SELECT s, unnest(range(low::BIGINT, high::BIGINT)) AS j, n, want, ratio FROM l), r AS (SELECT s, row_number() OVER (ORDER BY n * ratio - j DESC, sha256('13' || chr(0) || s)) AS r FROM j)
      SELECT l.s, low + count(r.s) AS held FROM l LEFT JOIN r ON r.s = l.s AND r.r <= want - (SELECT sum(low) FROM l) GROUP BY l.s, low)"""


def _stratified() -> str:
    return f"""WITH g AS (SELECT DISTINCT data_source || '/' || conversation_id AS k, data_source AS s FROM turns), z AS (SELECT s, count(*) AS n FROM g GROUP BY s),
        c0 AS (SELECT count(*) AS n, least(greatest(round_even(count(*) * 0.8, 0), 2), count(*) - 1)::BIGINT AS dev FROM g), c AS (SELECT *, least(greatest(round_even(n * 0.7, 0), 1), dev - 1)::BIGINT AS tr FROM c0),
        te AS {_holdout('z', 'n - dev', '1.0::DOUBLE - 0.8::DOUBLE')}, z2 AS (SELECT z.s, n - te.held AS n FROM z JOIN te USING (s)), va AS {_holdout('z2', 'dev - tr', '(dev - tr)::DOUBLE / dev')}
        SELECT conversation, data_source, CASE WHEN r <= te.held THEN 'test' WHEN r <= te.held + va.held THEN 'val' ELSE 'train' END AS split
        FROM (SELECT k AS conversation, s AS data_source, row_number() OVER (PARTITION BY s ORDER BY sha256('13' || chr(0) || k), k) AS r FROM g) JOIN te ON te.s = data_source JOIN va ON va.s = data_source"""


ORACLES = {
    "group_split_hash": f"""WITH c AS (SELECT coalesce(nullif(conversation_id, ''), 'row ' || row_id) AS group_key, {_LABEL_SQL.format(c='split')} AS label FROM questions),
        x AS (SELECT group_key, count(DISTINCT label) AS labels, max(label) AS label FROM c GROUP BY 1), g AS (SELECT * FROM x WHERE labels < 2),
        r AS (SELECT group_key, row_number() OVER (ORDER BY sha256('13' || chr(0) || group_key), group_key) - 1 AS k, count(*) OVER () AS n FROM g WHERE label IS NULL),
        h AS (SELECT bool_or(label = 'train') AS tr, bool_or(label = 'val') AS va, bool_or(label = 'test') AS te FROM g),
        a AS (SELECT r.*, h.*, CASE WHEN tr THEN round_even(n * 0.7, 0) ELSE greatest(round_even(n * 0.7, 0), 1) END AS a0, round_even(n * (0.7 + 0.1), 0) AS d0 FROM r, h),
        b AS (SELECT *, CASE WHEN va THEN d0 ELSE greatest(d0, a0 + 1) END AS d1 FROM a), c2 AS (SELECT *, CASE WHEN te THEN d1 ELSE least(d1, n - 1) END AS d FROM b),
        e AS (SELECT *, CASE WHEN va THEN least(a0, d) ELSE least(least(a0, d), d - 1) END AS a FROM c2)
        SELECT group_key, label AS split FROM g WHERE label IS NOT NULL UNION ALL SELECT group_key, CASE WHEN k < a THEN 'train' WHEN k < d THEN 'val' ELSE 'test' END FROM e
        UNION ALL SELECT group_key, 'conflict' FROM x WHERE labels > 1""",
    "stratified_split_hash": _stratified(),
    "split_label_conflicts": f"SELECT dataset_source, conversation_id, count(DISTINCT {_LABEL_SQL.format(c='split')}) AS n FROM questions WHERE conversation_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT {_LABEL_SQL.format(c='split')}) > 1",
    "split_leakage": f"""WITH q AS (SELECT conversation_id, {_LABEL_SQL.format(c='split')} AS s FROM questions WHERE conversation_id IS NOT NULL)
        SELECT conversation_id, array_to_string(list_sort(list(DISTINCT s)), ',') AS splits FROM q WHERE s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1""",
    "hash_permutation": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('order' || chr(0) || p_partkey), p_partkey) - 1 AS rank FROM part",
    "natural_sort_rank": "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY TRY_CAST(nullif(regexp_extract(s_name, '([0-9]+)$', 1), '') AS BIGINT) NULLS LAST, s_name) AS rank FROM supplier",
    "hash_sample_fixed": "SELECT doc_id FROM documents ORDER BY sha256('sample' || chr(0) || doc_id), doc_id LIMIT 100",
    "hash_bernoulli": "SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('share' || chr(0) || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1",
    "union_merge_counts": "SELECT 'questions' AS merged_from, split, dataset_source AS source, count(*) AS n FROM questions GROUP BY 1, 2, 3 UNION ALL SELECT 'documents', 'train', source, count(*) FROM documents GROUP BY 1, 2, 3",
    "ordered_subset_semi": "SELECT row_id, question_id, pos FROM questions JOIN (SELECT question_id, min(answer_id) AS pos FROM answers GROUP BY 1) USING (question_id)",
    "unknown_question_references": "SELECT row_key, count(*) AS n FROM judgements WHERE row_key IS NOT NULL AND row_key NOT IN (SELECT row_key FROM answers WHERE row_key IS NOT NULL) GROUP BY 1",
    "dedupe_first_wins": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "repeated_turn_ids": "SELECT data_source, conversation_id, session_id, turn_id, count(*) AS n, coalesce(trim(turn_id), '') = '' AS blank FROM turns GROUP BY 1, 2, 3, 4 HAVING count(*) > 1 OR coalesce(trim(turn_id), '') = ''",
    "source_set_operations": """WITH d AS (SELECT conversation_id FROM documents WHERE conversation_id IS NOT NULL), q AS (SELECT conversation_id FROM questions WHERE conversation_id IS NOT NULL)
        SELECT conversation_id, 'both' AS "where" FROM (SELECT * FROM d INTERSECT SELECT * FROM q) UNION ALL SELECT conversation_id, 'documents' FROM (SELECT * FROM d EXCEPT SELECT * FROM q) UNION ALL SELECT conversation_id, 'questions' FROM (SELECT * FROM q EXCEPT SELECT * FROM d)""",
    "negative_measures": "SELECT answer_id FROM answers WHERE NOT coalesce(input_tokens > 0 AND output_tokens > 0 AND observed_wall_time_seconds >= 0, false)",
    "cardinality_check": """WITH h AS (SELECT r_name AS name, count(*) AS found FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), w AS (SELECT * FROM (VALUES ('AFRICA', 5::BIGINT), ('ASIA', 4), ('NOWHERE', 1)) AS t(name, expected))
        SELECT name, expected, coalesce(found, 0) AS found FROM w FULL OUTER JOIN h USING (name) WHERE coalesce(found, 0) IS DISTINCT FROM expected""",
}
