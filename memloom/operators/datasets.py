"""From raw questions and dialogues to prepared rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memloom.functions.text import strip, text

# The order in which a source name is looked for.
ROUTES = ("worldmemarena", "h2hmem", "mem_gallery", "memeye", "memlens")


def route_of(source: Column) -> Column:
    """The first known name within the normalised source; null for an unknown one."""
    s = F.replace(F.lower(strip(text(source))), F.lit("-"), F.lit("_"))
    return F.coalesce(*[F.when(s.contains(r), r) for r in ROUTES])


def rotations(df: DataFrame, key: str, correct: Column, others: Column) -> DataFrame:
    """One question as one row per position of its correct choice: choices A, B, ... and the answer letter. ``others``: the wrong
    choices. A rotation moves the correct choice; the others keep their order."""
    n = F.size(others) + 1
    rows = df.select(key, correct.alias("__c"), others.alias("__o"), F.explode(F.sequence(F.lit(0), n - 1)).alias("rotation_index"))
    r = F.col("rotation_index")
    listed = F.concat(F.slice("__o", F.lit(1), r), F.array("__c"), F.slice("__o", r + 1, F.greatest(F.size("__o") - r, F.lit(0))))
    letters = F.transform(F.sequence(F.lit(0), F.size("__o")), lambda i: F.char(65 + i))
    return rows.select(key, "rotation_index", F.map_from_arrays(letters, listed).alias("choices"), F.char(65 + r).alias("answer"))


def turn_text(turn_id: Column, role: Column, name: Column, body: Column) -> Column:
    """``[Round id]`` line and speaker line; empty for a blank body."""
    who = F.when(text(name) != "", F.concat(F.initcap(role), F.lit(" ("), name, F.lit(")"))).otherwise(F.initcap(role))
    return F.when(strip(text(body)) == "", "").otherwise(F.concat(F.lit("[Round "), turn_id, F.lit("]\n"), who, F.lit(": "), strip(body)))


def aligned_images(images: Column, captions: Column, ids: Column) -> Column:
    """Parallel lists as image records by index; shorter lists give nulls."""
    return F.transform(images, lambda p, i: F.struct(F.get(ids, i).alias("id"), F.get(captions, i).alias("caption"), p.alias("path")))


def paired(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur on one side only, and on which."""
    a = left.select(*key).distinct().withColumn("__l", F.lit(True))
    b = right.select(*key).distinct().withColumn("__r", F.lit(True))
    out = a.join(b, key, "full_outer").filter("__l is null or __r is null")
    return out.select(*key, F.when(F.col("__l").isNull(), "right").otherwise("left").alias("only_in"))


def prepared_rows(questions: DataFrame, banks: DataFrame, scope: list[str]) -> DataFrame:
    """Nested training rows: one per question with its scope's bank; questions without one are left out by the inner
    join, scopes without questions never appear."""
    q = questions.select(*scope, "question_id", "question", "question_type", "split", "ground_truth")
    return q.join(banks, scope).select(
        "question_id",
        F.struct(F.lit("rule").alias("style"), F.col("ground_truth")).alias("reward_model"),
        F.struct(*scope, "split", "question_type").alias("extra_info"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("prompt"),
        F.col("bank"),
    )


def metadata_json(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys, nulls left out."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))
