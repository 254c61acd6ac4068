"""Packing turns into memory chunks and banks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.functions.text import strip, text
from memloom.operators.skew import positions
from memloom.session import ship


def word_count(c: Column) -> Column:
    """Words by white space, 0 for blank; the default token count."""
    t = strip(text(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\t-\r\x1c-\x20\x85\p{Z}]+")))


def pack(df: DataFrame, session: list[str], order: list[str], size: Column, target: int) -> DataFrame:
    """Greedy packing of a session's turns: a chunk is closed before a turn that would overflow ``target`` and once it
    has reached it; an oversized turn stands alone; blank turns (size 0) are left out. (session, order, size, chunk), chunks from 0.

    Each chunk depends on the one before, so a session is one sequence; it is streamed through its task in Arrow batches,
    sorted, with three numbers of state, and never held as a whole."""
    rows = df.select(*session, *order, size.cast("bigint").alias("size")).filter("size > 0")
    rows = rows.repartition(*session).sortWithinPartitions(*session, *order)
    n = len(session)
    ship(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, 0, 0
        for b in batches:
            out = []
            keys = zip(*[b.column(k).to_pylist() for k in range(n)])
            for key, s in zip(keys, b.column(b.num_columns - 1).to_pylist()):
                if key != now:
                    now, held, chunk = key, 0, 0
                elif held + s > target or held >= target:
                    held, chunk = 0, chunk + 1
                held += s
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "chunk"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, fields + ", chunk int")


def assemble(df: DataFrame, keys: list[str], order: list[str], texts: str, ids: str) -> DataFrame:
    """Chunks with their texts joined by blank lines and their turn ids, in order."""
    s = F.array_sort(F.collect_list(F.struct(*order, F.col(texts).alias("__t"), F.col(ids).alias("__i"))))
    out = df.groupBy(*keys).agg(s.alias("__s"))
    return out.select(*keys, F.array_join(F.transform("__s", lambda x: text(x["__t"])), "\n\n").alias("text"), F.transform("__s", lambda x: x["__i"]).alias("turn_ids"))


def bank_ids(chunks: DataFrame, conversation: list[str], order: list[str]) -> DataFrame:
    """Chunk ids ``m0000`` ... numbered across a conversation's sessions."""
    return positions(chunks, conversation, order, "__p").withColumn("memory_id", F.format_string("m%04d", "__p")).drop("__p")


def occurrence_suffix(df: DataFrame, key: list[str], order: list[str], base: str, turn: str) -> DataFrame:
    """The first use of an id keeps it; later ones get ``@turn`` and the turn's number."""
    w = W.partitionBy(*key).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("unique_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("@turn"), F.col(turn).cast("string"))))


def last_visible(sessions: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, checkpoint, last: the greatest index of the sessions a checkpoint covers. ``sessions``: keys, session_id, session_index;
    ``checkpoints``: keys, checkpoint, covered (session ids)."""
    covered = checkpoints.select(*keys, "checkpoint", F.explode("covered").alias("session_id"))
    return covered.join(sessions, [*keys, "session_id"]).groupBy(*keys, "checkpoint").agg(F.max("session_index").alias("last"))


def visible_prefix(sessions: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """The sessions each checkpoint sees: all up to the last one it covers, covered or not."""
    return sessions.join(last_visible(sessions, checkpoints, keys), keys).filter("session_index <= last").drop("last")


def visible_counts(sessions: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """How many sessions each checkpoint sees, from running counts of the sessions: no pair of session and checkpoint is formed."""
    at = sessions.groupBy(*keys, "session_index").agg(F.count(F.lit(1)).alias("__n"))
    running = at.withColumn("sessions", F.sum("__n").over(W.partitionBy(*keys).orderBy("session_index"))).select(*keys, F.col("session_index").alias("last"), "sessions")
    return last_visible(sessions, checkpoints, keys).join(running, [*keys, "last"])


def compression_totals(df: DataFrame, original: Column, compressed: Column) -> DataFrame:
    """Token sums and ratio; 0 where there is nothing to compress."""
    o, c = F.sum(original), F.sum(compressed)
    return df.agg(o.alias("original_tokens"), c.alias("compressed_tokens"), F.when(o == 0, 0.0).otherwise(c / o).alias("rate"))
