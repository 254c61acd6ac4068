"""Memory banks: normalising items, attaching them to scopes, and image records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memloom.functions.text import strip, text
from memloom.session import ship


def attach_bank(rows: DataFrame, banks: DataFrame, keys: list[str], checkpoint: str) -> DataFrame:
    """Rows with their scope's bank: equal keys, and a missing checkpoint only matches a missing one."""
    b = banks.select(*[F.col(k).alias(f"__{k}") for k in [*keys, checkpoint]], *[c for c in banks.columns if c not in (*keys, checkpoint)])
    on = F.col(checkpoint).eqNullSafe(F.col(f"__{checkpoint}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(b, on, "left").drop(*[f"__{k}" for k in [*keys, checkpoint]])


def missing_scopes(required: DataFrame, provided: DataFrame, keys: list[str]) -> DataFrame:
    """Required scopes without a bank, null-safe."""
    p = provided.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return required.select(*keys).distinct().join(p, on, "left_anti")


def normalized_item(item: Column, position: Column, prefix: str = "external") -> Column:
    """A JSON or plain text as STRUCT(id, text): an object's ``id`` and ``text``, else the plain text; a missing id
    is the prefix and the position."""
    v = F.try_parse_json(item)
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    ident = F.when(is_object, F.nullif(strip(text(F.try_variant_get(v, "$.id", "string"))), F.lit("")))
    body = F.when(is_object, strip(text(F.try_variant_get(v, "$.text", "string")))).otherwise(strip(text(item)))
    return F.struct(F.coalesce(ident, F.format_string(prefix + "_%04d", position)).alias("id"), body.alias("text"))


def normalized_items(items: Column, prefix: str = "external") -> Column:
    """``normalized_item`` of each entry of an array, blank texts left out."""
    return F.filter(F.transform(items, lambda x, i: normalized_item(x, i, prefix)), lambda s: s["text"] != "")


# Where a nested memory item may hold turns, text and a time.
NESTED_KEYS = ("turns", "messages", "conversation")
TEXT_KEYS = ("text", "content", "summary", "user", "assistant", "caption")
TIME_KEYS = ("time", "date", "timestamp")


def flatten_items(df: DataFrame, id_col: str, item: str) -> DataFrame:
    """(id, position, item_text, item_time) of memory items nested to any depth: nested lists inherit the time, the texts of
    an item's text keys are joined by newlines, items without text are dropped. JSON of unknown depth is walked in
    Python, in Arrow batches."""
    import json

    def walk(node, time: str) -> Iterator[tuple[str, str]]:
        if isinstance(node, str):
            if node.strip():
                yield node.strip(), time
        elif isinstance(node, list):
            for x in node:
                yield from walk(x, time)
        elif isinstance(node, dict):
            time = next((str(node[k]) for k in TIME_KEYS if node.get(k)), time)
            own = "\n".join(str(node[k]).strip() for k in TEXT_KEYS if isinstance(node.get(k), str) and node[k].strip())
            if own:
                yield own, time
            for k in NESTED_KEYS:
                yield from walk(node.get(k), time)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f.iloc[:, 0], f.iloc[:, 1]):
                try:
                    node = json.loads(t) if t else None
                except ValueError:
                    node = t
                out += [(i, k, x, y) for k, (x, y) in enumerate(walk(node, ""))]
            yield pd.DataFrame(out, columns=["id", "position", "item_text", "item_time"])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, item).mapInPandas(work, f"id {kind}, position int, item_text string, item_time string")


def location_keys(image: Column) -> Column:
    """The locations an image is known by: its path (slashes forward, no leading ``./``) and its hub coordinates."""
    path = F.regexp_replace(F.replace(strip(text(image["path"])), F.lit("\\"), F.lit("/")), r"^\./", "")
    hub = F.concat_ws("|", text(image["hf_repo_type"]), text(image["hf_repo_id"]), text(image["hf_filename"]), text(image["hf_revision"]))
    return F.filter(
        F.array(F.when(path != "", F.concat(F.lit("path:"), path)), F.when(text(image["hf_filename"]) != "", F.concat(F.lit("hub:"), hub))),
        lambda x: x.isNotNull(),
    )


def dedupe_images(images: Column) -> Column:
    """Images without those that share an id, or a location, with one kept before; the first wins, and a skipped
    image's own locations are not added. A fold over one row's (short) array."""
    start = F.struct(
        F.array().cast("array<string>").alias("ids"),
        F.array().cast("array<string>").alias("keys"),
        F.array().cast("array<int>").alias("kept"),
    )

    def step(a: Column, x: Column) -> Column:
        i, ident, keys = x["i"], x["ident"], x["keys"]
        seen = ((ident != "") & F.array_contains(a["ids"], ident)) | F.arrays_overlap(a["keys"], keys)
        seen = F.coalesce(seen, F.lit(False))
        return F.struct(
            F.when(seen, a["ids"]).otherwise(F.concat(a["ids"], F.array(ident))).alias("ids"),
            F.when(seen, a["keys"]).otherwise(F.concat(a["keys"], keys)).alias("keys"),
            F.when(seen, a["kept"]).otherwise(F.concat(a["kept"], F.array(i))).alias("kept"),
        )

    entries = F.transform(images, lambda im, i: F.struct(i.alias("i"), strip(text(im["id"])).alias("ident"), location_keys(im).alias("keys")))
    kept = F.aggregate(entries, start, step, lambda a: a["kept"])
    return F.transform(kept, lambda i: F.get(images, i))
