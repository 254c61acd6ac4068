"""Chunks, banks, scopes, images and vector search over ``turns``, ``questions`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions.text import fingerprint, image_caption_block, text
from memloom.operators import banks, chunking, retrieval
from memloom.plans.calls import LAST_TURNS_SQL, WORDS_SQL
from memloom.operators.evaluation import last_record
from memloom.operators.skew import positions
from memloom.session import table

SESSION = ["data_source", "conversation_id", "session_id"]
TARGET = 64


def last_turns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The last sent row of each turn."""
    t = table(spark, sf_dir, "turns").select(*SESSION, "session_index", "turn_index", "turn_id", "ingested_at", "row_id", *columns)
    return last_record(t.withColumn("key", F.to_json(F.struct(*SESSION, "turn_index"))), "key", ["ingested_at", "row_id"]).drop("key")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = last_turns(spark, sf_dir, "preview_text")
    return chunking.pack(t, SESSION, ["turn_index"], chunking.word_count(F.col("preview_text")), TARGET)


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select(*SESSION, "turn_index", "size", "chunk")


def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = last_turns(spark, sf_dir, "preview_text").select(*SESSION, "turn_index", "turn_id", "preview_text")
    placed = _packed(spark, sf_dir).select(*SESSION, "turn_index", "chunk").join(t, [*SESSION, "turn_index"])
    out = chunking.assemble(placed, [*SESSION, "chunk"], ["turn_index"], "preview_text", "turn_id")
    return out.select(*SESSION, "chunk", "text", F.array_join("turn_ids", ",").alias("turn_ids"))


def memory_bank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = last_turns(spark, sf_dir).groupBy(*SESSION).agg(F.min("session_index").alias("session_index"))
    chunks = _packed(spark, sf_dir).select(*SESSION, "chunk").distinct().join(first, SESSION)
    out = chunking.bank_ids(chunks, SESSION[:2], ["session_index", "session_id", "chunk"])
    return out.select(*SESSION, "chunk", "memory_id")


def occurrence_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = last_turns(spark, sf_dir, "images").select(*SESSION, "session_index", "turn_index", F.posexplode("images").alias("pos", "im"))
    t = t.select(*SESSION, "session_index", "turn_index", "pos", F.col("im.id").alias("image_id"))
    out = chunking.occurrence_suffix(t, ["data_source", "conversation_id", "image_id"], ["session_index", "session_id", "turn_index", "pos"], "image_id", "turn_index")
    return out.select(*SESSION, "turn_index", "pos", "unique_id")


def image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").filter(F.size("images") > 0)
    return t.select("row_id", image_caption_block(F.col("images")).alias("block"))


def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's images followed by its first one again, deduplicated by id and location."""
    t = table(spark, sf_dir, "turns").filter(F.size("images") > 0).select("row_id", F.concat("images", F.slice("images", 1, 1)).alias("images"))
    kept = banks.dedupe_images(F.col("images"))
    return t.select("row_id", F.size("images").alias("n_before"), F.size(kept).alias("n_kept"), F.array_join(F.transform(kept, lambda i: i["id"]), ",").alias("ids"))


def image_alias_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations known under more than one image id, within a conversation."""
    t = last_turns(spark, sf_dir, "images").select("data_source", "conversation_id", F.explode("images").alias("im"))
    k = t.select("data_source", "conversation_id", F.col("im.id").alias("id"), F.explode(banks.location_keys(F.col("im"))).alias("location"))
    out = k.groupBy("data_source", "conversation_id", "location").agg(F.countDistinct("id").alias("ids"), F.count(F.lit(1)).alias("n"))
    return out.filter("n > 1")


def caption_in_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption of a turn replaced once within its caption block."""
    from memloom.functions.text import first_replaced

    t = table(spark, sf_dir, "turns").filter(F.size("images") > 0)
    c = text(F.col("images")[0]["caption"])
    return t.select("row_id", first_replaced(F.col("protected_preview_text"), c, F.lit("[image]")).alias("block"))


def visible_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions a question may see, all up to the last of its visible sessions, and the last one's index."""
    q = table(spark, sf_dir, "questions").filter("visible_session_ids is not null")
    cp = q.select(F.lower(F.trim("conversation_id")).alias("conversation"), F.col("row_id").alias("checkpoint"), F.col("visible_session_ids").alias("covered"))
    s = table(spark, sf_dir, "turns").groupBy(F.lower(F.trim("conversation_id")).alias("conversation"), "session_id").agg(F.min("session_index").alias("session_index"))
    return chunking.visible_counts(s, cp, ["conversation"]).select("checkpoint", "sessions", F.col("last").alias("last_index"))


def compression_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = chunking.word_count
    t = table(spark, sf_dir, "turns").groupBy("data_source").agg(F.sum(n(F.col("text"))).alias("original_tokens"), F.sum(n(F.col("preview_text"))).alias("compressed_tokens"))
    rate = F.when(F.col("original_tokens") == 0, 0.0).otherwise(F.col("compressed_tokens") / F.col("original_tokens"))
    return t.withColumn("rate", F.round(rate, 6))


def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").groupBy("data_source", "conversation_id").agg(F.sum(chunking.word_count(F.col("text"))).alias("words"))
    return t.groupBy("data_source").agg(F.round(F.avg("words"), 4).alias("mean_words"), F.min("words").alias("least"), F.max("words").alias("most"), F.count(F.lit(1)).alias("conversations"))


def _banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").groupBy("data_source", "conversation_id").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("items"))
    return t.withColumn("checkpoint_id", F.when(F.col("sessions") > 3, F.lit("k1")))


def bank_attach_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").select("row_id", F.col("dataset_source").alias("data_source"), "conversation_id", F.when(F.col("checkpoint_id").isNotNull(), F.lit("k1")).alias("checkpoint_id"))
    return banks.attach_bank(q, _banks(spark, sf_dir), ["data_source", "conversation_id"], "checkpoint_id").select("row_id", "sessions", "items")


def scope_coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").select(F.col("dataset_source").alias("data_source"), "conversation_id")
    return banks.missing_scopes(q, table(spark, sf_dir, "turns").select("data_source", "conversation_id"), ["data_source", "conversation_id"])


def fingerprint_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = last_turns(spark, sf_dir, "preview_text").groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "preview_text"))).alias("s"))
    return t.select(*SESSION, fingerprint(F.transform("s", lambda x: x["turn_id"]), F.transform("s", lambda x: x["preview_text"])).alias("fingerprint"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    d = e.select(F.col("label").alias("bank"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return d.filter(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id"), d


def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of the whole table for every query (ids divisible by 100)."""
    q, d = _vectors(spark, sf_dir)
    out = retrieval.top_k(q, d, 10)
    return out.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def topk_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best within the query's own bank, the query itself left out."""
    q, d = _vectors(spark, sf_dir)
    kept = retrieval.eligible_documents(d.withColumn("pos", F.col("doc_id")), "pos", q.select(F.col("query_id").alias("doc_id")))
    out = retrieval.top_k(q, kept.drop("pos"), 5, scope="bank")
    return out.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def embedding_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of the float16 form per vector."""
    e = table(spark, sf_dir, "embeddings").withColumn("back", retrieval.decode_vectors(retrieval.encode_vectors(F.col("embedding"))))
    worst = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return e.select("vec_id", (worst < 1e-3).alias("close"), F.size("back").alias("n"))


def flatten_memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.flatten_items(table(spark, sf_dir, "memeye_records").select("record_id", F.get_json_object("record", "$.multi_session_dialogues").alias("item")).withColumn("item", F.regexp_replace("item", '"dialogues"', '"turns"')), "record_id", "item")


def normalise_bank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a conversation as bank items, objects and plain texts alternating."""
    d = table(spark, sf_dir, "documents").filter("conversation_id is not null and text is not null")
    item = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))).otherwise(F.concat(F.lit("note: "), "text"))
    d = positions(d.select("conversation_id", "doc_id", item.alias("item")), ["conversation_id"], ["doc_id"])
    out = d.select("conversation_id", banks.normalized_item(F.col("item"), F.col("position")).alias("x")).filter("x.text <> ''")
    return out.select("conversation_id", F.col("x.id").alias("id"), F.sha2("x.text", 256).alias("text_sha"))


QUERIES = {
    f.__name__: f
    for f in (
        greedy_chunks, chunk_assembly, memory_bank_ids, occurrence_suffix, image_blocks, image_dedupe, image_alias_overlap, caption_in_template,
        visible_prefix_join, compression_totals, context_statistics, bank_attach_null_safe, scope_coverage_anti, fingerprint_bank,
        topk_retrieval, topk_with_exclusions, embedding_roundtrip, flatten_memory_items, normalise_bank_items,
    )
}

_S = "data_source, conversation_id, session_id"
# Greedy packing as a recursion over a session's turns.
_PACK_SQL = f"""RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY turn_index, row_id) AS n FROM (SELECT {_S}, turn_index, row_id, turn_id, preview_text, {WORDS_SQL.format(c="coalesce(preview_text, '')")} AS size FROM {LAST_TURNS_SQL}) WHERE size > 0),
  p AS (SELECT {_S}, turn_index, size, n, 0 AS chunk, size AS held FROM t WHERE n = 1
    UNION ALL SELECT t.data_source, t.conversation_id, t.session_id, t.turn_index, t.size, t.n, CASE WHEN p.held + t.size > {TARGET} OR p.held >= {TARGET} THEN p.chunk + 1 ELSE p.chunk END,
      CASE WHEN p.held + t.size > {TARGET} OR p.held >= {TARGET} THEN t.size ELSE p.held + t.size END
    FROM p JOIN t ON t.data_source = p.data_source AND t.conversation_id = p.conversation_id AND t.session_id = p.session_id AND t.n = p.n + 1)"""
_KEYS_SQL = """list_filter([CASE WHEN coalesce(trim({i}.path), '') <> '' THEN 'path:' || regexp_replace(replace(trim({i}.path), '\\', '/'), '^\\./', '') END,
  CASE WHEN coalesce({i}.hf_filename, '') <> '' THEN 'hub:' || concat_ws('|', coalesce({i}.hf_repo_type, ''), coalesce({i}.hf_repo_id, ''), {i}.hf_filename, coalesce({i}.hf_revision, '')) END], lambda x: x IS NOT NULL)"""

ORACLES = {
    "greedy_chunks": f"WITH {_PACK_SQL} SELECT {_S}, turn_index, CAST(size AS BIGINT) AS size, chunk FROM p",
    "chunk_assembly": f"""WITH {_PACK_SQL} SELECT p.data_source, p.conversation_id, p.session_id, p.chunk, string_agg(t.preview_text, chr(10) || chr(10) ORDER BY p.n) AS text, string_agg(t.turn_id, ',' ORDER BY p.n) AS turn_ids
        FROM p JOIN t ON t.data_source = p.data_source AND t.conversation_id = p.conversation_id AND t.session_id = p.session_id AND t.n = p.n GROUP BY 1, 2, 3, 4""",
    "memory_bank_ids": f"""WITH {_PACK_SQL}, s AS (SELECT {_S}, min(session_index) AS si FROM {LAST_TURNS_SQL} GROUP BY 1, 2, 3), c AS (SELECT DISTINCT {_S}, chunk FROM p)
        SELECT {_S}, chunk, printf('m%04d', row_number() OVER (PARTITION BY data_source, conversation_id ORDER BY si, session_id, chunk) - 1) AS memory_id FROM c JOIN s USING ({_S})""",
    "occurrence_suffix": f"""WITH t AS (SELECT {_S}, session_index, turn_index, unnest(images) AS im, generate_subscripts(images, 1) - 1 AS pos FROM {LAST_TURNS_SQL} WHERE len(images) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY data_source, conversation_id, im.id ORDER BY session_index, session_id, turn_index, pos) AS n FROM t)
        SELECT {_S}, turn_index, CAST(pos AS INT) AS pos, CASE WHEN n = 1 THEN im.id ELSE im.id || '@turn' || turn_index END AS unique_id FROM r""",
    "image_blocks": """SELECT row_id, array_to_string(list_transform(list_filter(images, lambda i: coalesce(trim(i.id), '') <> ''), lambda i: '- ' || trim(i.id) || ': ' || trim(coalesce(i.caption, ''))), chr(10)) AS block FROM turns WHERE len(images) > 0""",
    "image_alias_overlap": f"""WITH k AS (SELECT data_source, conversation_id, im.id AS id, unnest({_KEYS_SQL.format(i='im')}) AS location FROM (SELECT data_source, conversation_id, unnest(images) AS im FROM {LAST_TURNS_SQL}))
        SELECT data_source, conversation_id, location, count(DISTINCT id) AS ids, count(*) AS n FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "caption_in_template": """WITH t AS (SELECT row_id, protected_preview_text AS p, coalesce(images[1].caption, '') AS c FROM turns WHERE len(images) > 0)
        SELECT row_id, CASE WHEN instr(p, c) > 0 THEN substr(p, 1, instr(p, c) - 1) || '[image]' || substr(p, instr(p, c) + length(c)) ELSE p END AS block FROM t""",
    "visible_prefix_join": """WITH s AS (SELECT lower(trim(conversation_id)) AS c, session_id, min(session_index) AS si FROM turns GROUP BY 1, 2),
        q AS (SELECT row_id, lower(trim(conversation_id)) AS c, unnest(visible_session_ids) AS session_id FROM questions WHERE visible_session_ids IS NOT NULL),
        l AS (SELECT q.row_id, q.c, max(si) AS last FROM q JOIN s USING (c, session_id) GROUP BY 1, 2)
        SELECT row_id AS checkpoint, count(*) AS sessions, max(si) AS last_index FROM l JOIN s ON s.c = l.c AND si <= last GROUP BY 1""",
    "compression_totals": f"""SELECT data_source, CAST(sum(a) AS BIGINT) AS original_tokens, CAST(sum(b) AS BIGINT) AS compressed_tokens, round(CASE WHEN sum(a) = 0 THEN 0 ELSE sum(b) / sum(a) END, 6) AS rate
        FROM (SELECT data_source, {WORDS_SQL.format(c="coalesce(text, '')")} AS a, {WORDS_SQL.format(c="coalesce(preview_text, '')")} AS b FROM turns) GROUP BY 1""",
    "context_statistics": f"""SELECT data_source, round(avg(w), 4) AS mean_words, CAST(min(w) AS BIGINT) AS least, CAST(max(w) AS BIGINT) AS most, count(*) AS conversations
        FROM (SELECT data_source, conversation_id, sum({WORDS_SQL.format(c="coalesce(text, '')")}) AS w FROM turns GROUP BY 1, 2) GROUP BY 1""",
    "bank_attach_null_safe": """WITH b AS (SELECT data_source, conversation_id, count(DISTINCT session_id) AS sessions, count(*) AS items, CASE WHEN count(DISTINCT session_id) > 3 THEN 'k1' END AS k FROM turns GROUP BY 1, 2)
        SELECT row_id, sessions, items FROM questions q LEFT JOIN b ON b.data_source = q.dataset_source AND b.conversation_id = q.conversation_id AND b.k IS NOT DISTINCT FROM CASE WHEN q.checkpoint_id IS NOT NULL THEN 'k1' END""",
    "scope_coverage_anti": "SELECT dataset_source AS data_source, conversation_id FROM questions EXCEPT SELECT data_source, conversation_id FROM turns",
    "fingerprint_bank": f"""SELECT {_S}, sha256(string_agg(coalesce(turn_id, '') || chr(0) || coalesce(preview_text, '') || chr(30), '' ORDER BY turn_index)) AS fingerprint FROM {LAST_TURNS_SQL} GROUP BY 1, 2, 3""",
    "topk_retrieval": """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)
        SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "topk_with_exclusions": """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 100 = 0 AND d.vec_id % 100 <> 0)
        SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "embedding_roundtrip": "SELECT vec_id, true AS close, CAST(len(embedding) AS INT) AS n FROM embeddings",
    "normalise_bank_items": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY doc_id) - 1 AS i FROM documents WHERE conversation_id IS NOT NULL AND text IS NOT NULL),
        x AS (SELECT conversation_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE printf('external_%04d', i) END AS id, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'note: ' || text END, '^[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ''), '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+$', '') AS t FROM d)
        SELECT conversation_id, id, sha256(t) AS text_sha FROM x WHERE t <> ''""",
}
