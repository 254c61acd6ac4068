"""Exact vector search and the float16 interchange form."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from memloom.session import ship


#: Queries matched in one pass over the documents; a pass broadcasts no more than these.
BLOCK_QUERIES = 20_000
#: Scores held at a time by a task.
TILE = 4_000_000


def top_k(queries: DataFrame, documents: DataFrame, k: int, scope: str | None = None, digits: int = 6, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query by inner product, exact; ties, after rounding to
    ``digits``, by document id. With ``scope``, only documents of the query's own scope. ``queries``: query_id, vector and
    scope; ``documents``: doc_id, vector and scope. Null vectors match nothing; k <= 0 gives no rows.

    Queries go in hashed blocks of about ``block_queries``: a block is broadcast (so its size is bounded whatever the
    number of queries) and met by every document partition in tiles of a matrix product. A partition keeps k rows a
    query, so the final ranking shuffles k rows per query and partition, never a row per pair."""
    spark = documents.sparkSession
    ship(spark)
    q = queries.select("query_id", (F.col(scope) if scope else F.lit(0)).alias("s"), "vector").filter("vector is not null")
    d = documents.select("doc_id", (F.col(scope) if scope else F.lit(0)).alias("s"), "vector").filter("vector is not null")
    blocks = max(1, -(-q.count() // block_queries))
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *d.schema.fields]}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    out = None
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if k > 0 else []
        shared = spark.sparkContext.broadcast([(r.query_id, r.s, r.vector) for r in part])
        found = d.mapInPandas(_best_of_block(shared, k, digits), schema)
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 0))


def _best_of_block(shared, k: int, digits: int):
    def best(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True])
        return ordered.groupby("query_id", sort=False).head(k)

    def work(frames):
        by_scope: dict = {}
        for ident, scope, vector in shared.value:
            by_scope.setdefault(scope, ([], []))[0].append(ident)
            by_scope[scope][1].append(vector)
        sides = {s: (np.array(i, dtype=object), np.array(v, dtype="float64")) for s, (i, v) in by_scope.items()}
        pool, held = [], 0
        for frame in frames:
            for scope, docs in frame.groupby("s"):
                if scope not in sides:
                    continue
                ids, m = sides[scope]
                step = max(1, TILE // len(ids))
                for a in range(0, len(docs), step):
                    tile = docs.iloc[a : a + step]
                    names = tile["doc_id"].to_numpy()
                    scores = np.round(m @ np.stack(tile["vector"].to_numpy()).astype("float64").T, digits)
                    if scores.shape[1] > k:
                        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
                        r, c = np.nonzero(scores >= least)
                    else:
                        r, c = np.indices(scores.shape).reshape(2, -1)
                    pool.append(pd.DataFrame({"query_id": ids[r], "doc_id": names[c], "score": scores[r, c]}))
                    held += len(r)
                    if held > TILE:
                        pool = [best(pd.concat(pool))]
                        held = len(pool[0])
        if pool:
            yield best(pd.concat(pool))

    return work


def eligible_documents(documents: DataFrame, position: str, excluded: DataFrame) -> DataFrame:
    """Without blank ids, excluded ids, and later repeats of an id."""
    w = W.partitionBy("doc_id").orderBy(position)
    kept = documents.filter(F.trim(F.col("doc_id").cast("string")) != "").join(excluded.select("doc_id"), "doc_id", "left_anti")
    return kept.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


@F.pandas_udf(T.StringType())
def encode_vectors(vectors: pd.Series) -> pd.Series:
    """A vector as base64 of little-endian float16 within JSON (dimensions, encoding, data)."""
    def one(v):
        if v is None:
            return None
        raw = np.asarray(v, dtype="<f2")
        return json.dumps({"dimensions": int(raw.size), "encoding": "float16-le-base64", "data": base64.b64encode(raw.tobytes()).decode("ascii")}, sort_keys=True)

    return vectors.map(one)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vectors(texts: pd.Series) -> pd.Series:
    """The inverse of ``encode_vectors``; null and empty texts are null; a wrong shape is an error."""
    def one(t):
        if not t:
            return None
        m = json.loads(t)
        if m["encoding"] != "float16-le-base64":
            raise ValueError(f"unknown encoding {m['encoding']!r}")
        raw = np.frombuffer(base64.b64decode(m["data"]), dtype="<f2")
        if raw.size != m["dimensions"]:
            raise ValueError("dimensions disagree with the data")
        return raw.astype("float32")

    return texts.map(one)
