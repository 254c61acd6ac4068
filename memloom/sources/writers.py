"""Writers: Parquet by split, JSON lines with sorted keys, call-count tables, manifests, progress.

Spark's commit protocol gives what temporary files and renames give a single process: a reader sees a whole result or none.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from memloom.functions.coerce import nonnegative_int


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One directory per split; the explicit schema holds for empty splits too."""
    df.repartition(F.col(split), F.pmod(F.xxhash64(*[c for c in df.columns if c != split][:1]), F.lit(64))).write.mode("overwrite").partitionBy(split).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def write_call_counts(counts: DataFrame, path: str) -> None:
    """route, model, calls as tab-separated lines, routes in order."""
    counts.select("route", "model", nonnegative_int(F.col("calls")).alias("calls")).orderBy("route").coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "\0").csv(path)


def short_name(name: str, limit: int = 200) -> str:
    """A file name of at most ``limit`` bytes: a long one is cut and ends in a hash of the whole."""
    raw = name.encode("utf-8")
    if len(raw) <= limit:
        return name
    stem, dot, suffix = name.rpartition(".")
    tail = "-" + hashlib.sha256(raw).hexdigest()[:16] + (dot + suffix if stem else "")
    kept = (stem or name).encode("utf-8")[: limit - len(tail.encode("utf-8"))].decode("utf-8", "ignore")
    return kept + tail


def manifest(df: DataFrame, by: list[str], meta: dict) -> DataFrame:
    """One row of JSON: the run's metadata and the row counts by the given columns."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    entries = F.array_sort(F.collect_list(F.struct(*by, "rows")))
    return counts.agg(F.to_json(F.struct(F.lit(json.dumps(meta, sort_keys=True)).alias("meta"), entries.alias("counts"))).alias("manifest"))


def append_progress(df: DataFrame, path: str) -> None:
    """Finished rows as JSON lines beside earlier ones."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("append").text(path)


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text blocks in order, parted by blank lines; a report is a small aggregate."""
    lines.orderBy(*order).select(F.concat("report", F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
