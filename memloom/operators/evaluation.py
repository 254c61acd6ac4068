"""Evaluation rows and their aggregation at overall, dataset and question-type grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memloom.functions.text import identifier, strip, text


# Subsets that report as one.
MERGED = {"h2hmem": "h2hmem", "h2hmem_dyadic": "h2hmem", "h2hmem_multiparty": "h2hmem"}


def reporting_source(source: Column) -> Column:
    """Subsets of one benchmark under one name; others as they are, trimmed; blank is ``unknown``."""
    s = strip(text(source))
    merged = F.create_map(*[F.lit(x) for kv in MERGED.items() for x in kv])[identifier(source)]
    return F.coalesce(merged, F.nullif(s, F.lit("")), F.lit("unknown"))


def type_key(source: Column, kind: Column, subtype: Column) -> Column:
    """``source/type[/subtype]``; one text, so that equal spellings share a group."""
    k = F.coalesce(F.nullif(text(kind), F.lit("")), F.lit("unknown"))
    s = strip(text(subtype))
    return F.concat(source, F.lit("/"), k, F.when(s != "", F.concat(F.lit("/"), s)).otherwise(""))


def last_record(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key by ``order``, which ends in a unique column. Partial aggregation only."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__m"))
    return best.select(key, *[F.col(f"__m.{c}").alias(c) for c in rest])


def report(rows: DataFrame) -> DataFrame:
    """Metrics at three grains in one pass (grouping sets): rows with dataset_source, conversation_id, question_type, question_subtype,
    f1, cost_usd, latency, judge_status, judge_score. Quality and latency are means over queries; cost is summed and
    divided by distinct (unmerged source, conversation); means skip nulls."""
    r = rows.select(
        reporting_source(F.col("dataset_source")).alias("dataset"),
        F.struct(F.col("dataset_source"), F.col("conversation_id")).alias("sample"),
        F.col("question_type"), F.col("question_subtype"), "f1", "cost_usd", "latency", "judge_status", "judge_score",
    )
    r = r.withColumn("type_key", type_key(F.col("dataset"), F.col("question_type"), F.col("question_subtype")))
    g = r.groupingSets([[], [F.col("dataset")], [F.col("type_key")]], F.col("dataset"), F.col("type_key")).agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("num_queries"),
        F.countDistinct("sample").alias("num_samples"),
        F.avg("f1").alias("f1"),
        F.sum("cost_usd").alias("cost_sum"),
        F.avg("latency").alias("latency"),
        F.count_if(F.col("judge_status") == "complete").alias("judge_complete"),
        F.count_if(F.col("judge_status") == "pending").alias("judge_pending"),
        F.count_if(F.col("judge_status") == "error").alias("judge_error"),
        F.avg("judge_score").alias("judge_score"),
    )
    grain = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "dataset").otherwise("type")
    name = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, F.col("dataset")).otherwise(F.col("type_key"))
    return g.select(
        grain.alias("grain"), name.alias("name"), "num_queries", "num_samples", "f1",
        (F.col("cost_sum") / F.col("num_samples")).alias("cost_per_sample"), "latency",
        "judge_complete", "judge_pending", "judge_error", "judge_score",
    )


def report_lines(metrics: DataFrame) -> DataFrame:
    """One block of text per row of ``report``."""
    from memloom.functions.text import fixed

    block = F.concat_ws(
        "\n",
        F.format_string("=== %s ===", F.col("name")),
        F.format_string("Queries: %d", F.col("num_queries")),
        F.format_string("Samples: %d", F.col("num_samples")),
        F.concat(F.lit("F1: "), fixed(F.col("f1"), 4)),
        F.concat(F.lit("Judge: "), fixed(F.col("judge_score"), 4), F.format_string(" (%d/%d successful)", F.col("judge_complete"), F.col("num_queries"))),
        F.concat(F.lit("Cost: "), fixed(F.col("cost_per_sample"), 8), F.lit(" USD/sample")),
        F.concat(F.lit("Latency: "), fixed(F.col("latency"), 4), F.lit(" s/query")),
    )
    return metrics.select("grain", "name", block.alias("report"))


def sample_mean(rows: DataFrame, value: Column, sample: list[str], by: list[str]) -> DataFrame:
    """Sum over rows divided by distinct samples."""
    return rows.groupBy(*by).agg(F.sum(value).alias("total"), F.count_distinct(*[F.col(c) for c in sample]).alias("samples")).withColumn("mean_per_sample", F.col("total") / F.col("samples"))


def metric_summary(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean, largest, least and number of the finite values."""
    from memloom.functions.coerce import finite

    v = F.when(finite(value), value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n"))


def published_metrics(metrics: DataFrame, name: str, kept: tuple[str, ...]) -> DataFrame:
    """All but auxiliary validation metrics; of those the mean number of turns and the ``mean@`` of the kept keys, the
    name split from the right."""
    n = F.col(name)
    key = F.regexp_extract(n, r"([^/]+)/(mean@[^/]*)$", 1)
    return metrics.filter(~n.startswith("val-aux/") | (n == "val-aux/num_turns/mean") | key.isin(*kept))


def reference_rows(questions: DataFrame) -> DataFrame:
    """The last sent row of each question: question_id and what scoring needs."""
    cols = ["question_id", "ingested_at", "row_id", "question_type", "question_subtype", "reference_answers"]
    return last_record(questions.select(*cols), "question_id", ["ingested_at", "row_id"])
