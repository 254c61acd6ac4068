"""Readers: JSON lines, whole JSON files with provenance, prepared splits, banks, profiles, progress logs, images.

Listings and small configuration files are read on the driver; everything else stays a distributed scan with an explicit
schema, so filters and column selection reach the files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from memloom.functions.text import strip, text


def _paths(spark: SparkSession, pattern: str) -> list:
    """Hadoop file states that match a glob."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(conf).globStatus(path) or [])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Objects of a JSON-lines file; blank lines are skipped. Lines that are no object fail the job, or with ``strict`` off
    come back with nulls and the line in ``bad_line``."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    good = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").isNotNull()
    row = F.from_json("value", kind)
    if strict:
        row = F.when(good, row).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))).cast(kind))
        return lines.select(row.alias("r")).select("r.*")
    return lines.select(row.alias("r"), F.when(~good, F.col("value")).alias("bad_line")).select("r.*", "bad_line")


def read_records(spark: SparkSession, path: str, suffix: str = "json", recursive: bool = True) -> DataFrame:
    """One row per file: path, stem, directories, revision (the part after ``snapshots``) and the whole text."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{suffix}").text(path)
    p = F.col("_metadata.file_path")
    return df.select(
        p.alias("path"),
        F.regexp_extract(p, r"([^/]+)\.[^./]+$", 1).alias("stem"),
        F.slice(F.split(F.regexp_replace(p, r"/[^/]*$", ""), "/"), -2, 2).alias("directories"),
        F.nullif(F.regexp_extract(p, r"/snapshots/([^/]+)/", 1), F.lit("")).alias("revision"),
        F.col("value").alias("record"),
    )


def items_of(records: DataFrame, record: str = "record") -> DataFrame:
    """The objects of files that hold a JSON list, or an object with the list under ``data``."""
    v = F.try_parse_json(record)
    items = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return records.select("stem", F.posexplode(items).alias("position", "item"))


def latest_dump(spark: SparkSession, directory: str) -> str:
    """The dump of a directory: the .jsonl file with the greatest (number in the name or -1, modification time, name)."""
    found = []
    for s in _paths(spark, f"{directory}/*.jsonl"):
        name = s.getPath().getName()
        stem = name.rsplit(".", 1)[0]
        found.append((int(stem) if stem.isdigit() else -1, s.getModificationTime(), name, s.getPath().toString()))
    if not found:
        raise FileNotFoundError(f"no .jsonl file in {directory}")
    return max(found)[3]


def prepared_splits(spark: SparkSession, directory: str, schema: T.StructType | None = None) -> dict[str, DataFrame]:
    """Whichever of train, val and test exist as Parquet; an error if none does."""
    out = {}
    for split in ("train", "val", "test"):
        if _paths(spark, f"{directory}/{split}.parquet"):
            r = spark.read.schema(schema) if schema else spark.read
            out[split] = r.parquet(f"{directory}/{split}.parquet")
    if not out:
        raise FileNotFoundError(f"no prepared split in {directory}")
    return out


def read_banks(spark: SparkSession, path: str, items: str = "memories") -> DataFrame:
    """External banks (a JSON array, or JSON lines): data_source, conversation_id, checkpoint_id and items as JSON texts. A scope
    that occurs twice is an error."""
    v = F.try_parse_json("value")
    raw = spark.read.text(path) if path.endswith(".jsonl") else spark.read.option("wholetext", True).text(path)
    each = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))
    b = raw.select(F.explode(each).alias("b"))
    get = lambda k: F.try_variant_get("b", f"$.{k}", "string")
    entries = F.transform(F.try_variant_get("b", f"$.{items}", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    out = b.select(get("data_source").alias("data_source"), get("conversation_id").alias("conversation_id"), get("checkpoint_id").alias("checkpoint_id"), entries.alias("items"))
    twice = out.groupBy("data_source", "conversation_id", "checkpoint_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"scope occurs twice: {twice[0].asDict()}")
    return out


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A resource catalogue (JSON, or YAML if PyYAML is installed) as one row per identifier: model names and aliases, trimmed and in lower
    case. An identifier of two models is an error."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML catalogues need PyYAML; give the catalogue as JSON") from e
        data = yaml.safe_load(body)
    else:
        data = json.loads(body)
    terms = ("input_price_per_million_usd", "output_price_per_million_usd", "latency_base_seconds", "latency_input_seconds_per_token", "latency_output_seconds_per_token", "latency_image_seconds")
    seen: dict[str, tuple] = {}
    for p in data["profiles"]:
        values = tuple(float(p[t]) for t in terms)
        if any(not 0 <= x < float("inf") for x in values):
            raise ValueError(f"{p['model']}: terms must be finite and not negative")
        for name in {p["model"], p.get("route_name") or p["model"], *p.get("aliases", [])}:
            key = name.strip().casefold()
            row = (key, p["model"], *values)
            if seen.setdefault(key, row) != row:
                raise ValueError(f"{name!r} names two models")
    if "default" in data and data["default"].strip().casefold() not in seen:
        raise ValueError("the default model has no profile")
    return spark.createDataFrame(sorted(seen.values()), "identifier string, canonical string, " + ", ".join(f"{t} double" for t in terms))


def last_progress(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last line of each key in a progress log."""
    kind = T.StructType.fromDDL(schema)
    rows = spark.read.text(path).filter(strip(F.col("value")) != "").select(F.from_json("value", kind).alias("r"), F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_name").alias("file"))
    best = rows.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max(F.struct("file", "line", "r")).alias("m"))
    return best.select("m.r.*")


def image_type(content: Column) -> Column:
    """MIME type by the first bytes; null for others."""
    # Signatures of image formats.
    starts = lambda h: F.startswith(content, F.unhex(F.lit(h)))
    return (
        F.when(starts("FFD8FF"), "image/jpeg")
        .when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("474946383761") | starts("474946383961"), "image/gif")
        .when(starts("52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250"))), "image/webp")
        .when(starts("424D"), "image/bmp")
        .when(starts("49492A00") | starts("4D4D002A"), "image/tiff")
    )


def caption_of(sidecar: Column) -> Column:
    """The caption of a sidecar JSON: ``description.final_text``, else ``caption``, else ``final_text``, else empty."""
    get = lambda p: F.nullif(strip(text(F.get_json_object(sidecar, p))), F.lit(""))
    return F.coalesce(get("$.description.final_text"), get("$.caption"), get("$.final_text"), F.lit(""))
