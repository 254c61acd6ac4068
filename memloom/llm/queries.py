"""Queries of the operators for training data, over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memloom.llm import garbled, mixing, pairs, pieces, splits, tokens
from memloom.session import cut_lineage, table


_WRITTEN = ["dataset_source", "conversation_id"]


def _question_label() -> Column:
    return F.concat_ws("|", splits.benchmark(F.col("dataset_source")), F.lower(F.trim("question_type")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    return splits.split_conflicts(q, "row_id", _WRITTEN, splits.question_entities(q), splits.split_label(F.col("split")))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    return splits.assign_labelled(q, table(spark, sf_dir, "split_targets"), "row_id", _WRITTEN, splits.question_entities(q), _question_label())


def p1_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).drop("label")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(cut_lineage(_assigned(spark, sf_dir)), table(spark, sf_dir, "split_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "answers"), table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.split_oversized(table(spark, sf_dir, "turns"), ["row_id"])
    return found.filter("piece = 0").select("row_id", F.col("forced").cast("int").alias("forced"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "turns"), ["row_id", "turn_id"], images="images")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), ["doc_id"])


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, source, n_tokens) of the documents of the named sources, and the targets (a fixed table of a few rows)."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    docs = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")
    return tokens.token_counts(docs, ["id", "source"]), targets


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as all documents of the named sources."""
    sized, targets = _sized(spark, sf_dir)
    return mixing.mix_sources(sized, targets).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir)
    sized = cut_lineage(sized)
    total = mixing.available_tokens(sized, targets)
    return mixing.mix_report(mixing.mix_sources(sized, targets, total), targets, total)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, sf_dir, "documents"), "doc_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restored_documents(table(spark, sf_dir, "documents"), "doc_id")


def p1_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assignment must not have: groups in two splits, questions without a split or with two, conversations in two groups."""
    q = table(spark, sf_dir, "questions")
    a = cut_lineage(p1_assignment(spark, sf_dir))
    two = a.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("group in two splits").alias("what"), F.col("group_id").alias("key"))
    per = q.select("row_id").join(a, "row_id", "left").groupBy("row_id").agg(F.count("split").alias("n")).filter("n <> 1")
    c = q.select("row_id", splits.question_entities(q)[0].alias("entity")).filter("entity is not null").join(a, "row_id")
    torn = c.groupBy("entity").agg((F.min("group_id") != F.max("group_id")).alias("torn")).filter("torn")
    return two.unionByName(per.select(F.lit("question without one split").alias("what"), F.col("row_id").cast("string").alias("key"))).unionByName(
        torn.select(F.lit("conversation in two groups").alias("what"), F.col("entity").alias("key"))
    )


def p4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose pieces are too long, do not overlap as they must, or do not make up the text; those of whole turns with a lost image."""
    p = p4_pieces(spark, sf_dir).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("piece", F.col("piece_text").alias("text"), "images"))).alias("p"))  # the pieces of one text
    rebuilt = F.aggregate("p", F.lit(""), lambda s, x: F.concat(s, F.when(x["piece"] == 0, x["text"]).otherwise(F.substring(x["text"], F.lit(81), F.length(x["text"])))))
    overlaps = F.forall(F.sequence(F.lit(1), F.size("p")), lambda k: (k == F.size("p")) | F.get("p", k)["text"].startswith(F.right(F.get("p", k - 1)["text"], F.lit(80))))
    images = F.aggregate("p", F.lit(0), lambda s, x: s + F.coalesce(F.size(x["images"]), F.lit(0)))
    t = table(spark, sf_dir, "turns").filter(F.length("text") > 1000).select("row_id", F.col("text").alias("whole"), F.coalesce(F.size("images"), F.lit(0)).alias("given"))
    wrong = ~F.coalesce((rebuilt == F.col("whole")) & F.forall("p", lambda x: F.length(x["text"]) <= 1000) & overlaps & (images == F.greatest("given", F.lit(0))), F.lit(False))
    return t.join(p, "row_id", "left").filter(wrong).select("row_id")


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents used more often than their source allows, and slots with two documents in one place or more than their block."""
    m = cut_lineage(p6_mix(spark, sf_dir))
    caps = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    often = m.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(caps, "source").filter("n > max_repeats").select(F.lit("repeats").alias("what"), F.col("doc_id").alias("key"))
    slots = m.groupBy("slot", "place").count().filter((F.col("count") > 1) | (F.col("place") >= mixing.BLOCK_TOKENS)).select(F.lit("place").alias("what"), F.col("slot").alias("key"))
    return often.unionByName(slots)


QUERIES = {f.__name__: f for f in (p1_found, p1_assignment, p1_report, p1_violations, p3_found, p4_found, p4_pieces, p4_violations, p5_ids, p6_mix, p6_report, p6_violations, p7_found, p7_restored)}

_TRIM = "regexp_replace(lower({c}), '^[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+|[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+$', '', 'g')".format(c="split")
_BENCHMARK = "CASE " + " ".join(f"WHEN starts_with(s, '{b}') THEN '{b}'" for b in splits.BENCHMARKS) + " ELSE s END"
ORACLES = {
    "p1_found": f"""WITH q AS (SELECT row_id, regexp_replace(lower(dataset_source), '[^a-z0-9]', '', 'g') AS s, regexp_replace(lower(conversation_id), '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}_-]+', '', 'g') AS c, {_TRIM} AS l FROM questions),
        k AS (SELECT row_id, CASE WHEN s <> '' AND c <> '' THEN {_BENCHMARK} || '/' || c END AS k, CASE WHEN l IN ('train', 'training') THEN 1 WHEN l IN ('val', 'valid', 'validation', 'dev') THEN 2 WHEN l = 'test' THEN 3 END AS l FROM q)
        SELECT row_id FROM k WHERE k IN (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT l) > 1)""",
    "p4_found": """SELECT row_id, CAST(list_max(list_transform(regexp_split_to_array(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}.!?;:,。！？；：，、]+'), lambda x: length(x))) > 1000 AS INT) AS forced FROM turns WHERE length(text) > 1000""",
    # Of rules that results must keep, SQL can say that nothing breaks them.
    "p1_violations": "SELECT '' AS what, conversation_id AS key FROM questions WHERE false",
    "p4_violations": "SELECT row_id FROM turns WHERE false",
    "p6_violations": "SELECT '' AS what, doc_id AS key FROM documents WHERE false",
}
