"""Mixing sources to target weights.

Method: a low-discrepancy schedule. Slot k of the mix is the point frac(k * golden ratio) on the unit interval,
which falls into the interval of one source (cumulative weights); the slots of a source are numbered in order.
The documents of a source, shuffled by a hash and laid end to end (as often as it may be repeated), are cut into
blocks of equally many tokens, and block r joins the source's slot r. So at every prefix of the mix each source
has its share, up to a block or two.

Plan. A document's place in its shuffled source is a prefix sum in two steps: token sums of hash buckets (few
rows, one window per source over at most ``BUCKETS`` rows), then a window within each bucket. No window or join key
holds more than about 1 / ``BUCKETS`` of a source, however large the source. Slots are generated by ``range`` and
numbered the same way. Slots and documents meet in a shuffled join on (source, block), which no source can skew.

Defined results: targets are normalised to their sum; documents of sources without a target are not used; texts
without tokens (null, empty) hold no share and are left out; a source with too few documents is used up to its
``max_repeats`` and falls short, which the report shows; other sources keep their tokens, so the actual shares are
reported both of the total asked for and of the mix; a source's last document may go over its quota by less than
its length. Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.session import cut_lineage

#: Hash buckets a source is shuffled in, and slots to a numbering bucket.
BUCKETS, SLOTS = 2048, 65_536
#: Tokens of a slot, whatever the size of the mix: each source has its share at every prefix, up to a few blocks.
BLOCK_TOKENS = 1024
GOLDEN = 0.6180339887498949


def _shuffled_offsets(sized: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``sized`` (id, source, n_tokens) with ``start``: tokens before the document in its shuffled source; and the
    tokens of each source."""
    h = F.xxhash64(F.col("id"), F.lit(seed))
    placed = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 53).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    w = W.partitionBy("source").orderBy("bucket")
    base = sums.withColumn("base", F.sum("t").over(w) - F.col("t"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    # At most sources x BUCKETS rows.
    out = placed.join(F.broadcast(base.select("source", "bucket", "base")), ["source", "bucket"])
    out = out.withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return out.select("id", "source", "n_tokens", "start", "h"), sums.groupBy("source").agg(F.sum("t").alias("source_tokens"))


def schedule(spark, weights: list[tuple[str, float]], slots: int) -> DataFrame:
    """(slot, source, rank): the source of each slot and the slot's number within the source, both from 0."""
    total, edges, at = sum(w for _, w in weights), [], 0.0
    for name, w in weights:
        at += w / total
        edges.append((name, at))
    # The product is taken modulo 1 in whole steps, so that large slot numbers lose no precision.
    step = int(GOLDEN * 2**40)
    point = F.pmod(F.col("slot") * F.lit(step), F.lit(2**40)) / F.lit(float(2**40))
    source: Column = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        source = F.when(point < edge, F.lit(name)).otherwise(source)
    s = spark.range(slots).select(F.col("id").alias("slot")).withColumn("source", source)
    s = s.withColumn("chunk", F.floor(F.col("slot") / SLOTS))
    per = s.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n"))
    number = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot"))
    s = s.withColumn("number", number).join(before.select("source", "chunk", "before"), ["source", "chunk"])
    return s.select("slot", "source", (F.col("before") + F.col("number") - 1).alias("rank"))


def available_tokens(sized: DataFrame, targets: DataFrame) -> int:
    """Tokens of all documents of the targets' sources."""
    return int(sized.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0)


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(slot, place, source, id, pass, n_tokens): every use of a document, in the order of slot and place, the token at which it begins in the slot's
    block. ``sized``: (id, source, n_tokens).
    ``targets``: (source, target_share, max_repeats), a few rows. ``total_tokens``: size of the mix, by default the
    tokens of all documents of the targets' sources."""
    spark = sized.sparkSession
    goal = targets.select("source", "target_share", "max_repeats").orderBy("source").collect()
    weights = [(r.source, float(r.target_share)) for r in goal if r.target_share and r.target_share > 0]
    if not weights:
        return spark.createDataFrame([], "slot bigint, place bigint, source string, id bigint, pass int, n_tokens bigint")
    share_sum = sum(w for _, w in weights)

    named = sized.select("id", "source", "n_tokens").filter(F.col("source").isin([n for n, _ in weights]) & (F.col("n_tokens") > 0))
    # Rows with one id are told apart, so that a repeated row has a place of its own.
    named = named.withColumn("copy", F.monotonically_increasing_id())
    named = cut_lineage(named)
    placed, sums = _shuffled_offsets(named, seed)
    have = {r.source: int(r.source_tokens) for r in sums.collect()}
    total = int(total_tokens if total_tokens is not None else sum(have.values()))
    block = int(block_tokens or BLOCK_TOKENS)
    plan = []
    for r in goal:
        size = have.get(r.source, 0)
        quota = round(total * float(r.target_share or 0) / share_sum)
        if size and quota > 0:
            usable = min(quota, size * max(0, int(r.max_repeats or 0)))
            plan.append((r.source, size, usable, -(-usable // size)))
    if not plan:
        return spark.createDataFrame([], "slot bigint, place bigint, source string, id bigint, pass int, n_tokens bigint")
    of = F.broadcast(spark.createDataFrame(plan, "source string, size bigint, usable bigint, passes bigint"))

    uses = placed.join(of, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    # A later pass is the same shuffled stream again.
    uses = uses.withColumn("at", F.col("pass") * F.col("size") + F.col("start")).filter(F.col("at") < F.col("usable"))
    uses = uses.withColumn("rank", F.floor(F.col("at") / block))
    # A few slots more than the mix has, so that every source finds its last block's slot.
    n = total // block + 64 + total // block // 50 + 40 * len(weights)
    out = uses.join(schedule(spark, weights, n), ["source", "rank"], "left")
    place = F.col("at") - F.col("rank") * block
    return out.select(F.coalesce("slot", F.lit(n)).alias("slot"), place.cast("bigint").alias("place"), "source", "id", "pass", "n_tokens")


def mix_report(mix: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: target_share, share_of_mix, share_of_total (of the size asked for, by default the mix's), tokens, documents,
    uses, most uses of one document, and max_repeats."""
    used = mix.groupBy("source", "id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.countDistinct("pass").alias("repeats"))
    per = used.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("uses"), F.max("repeats").alias("most_repeats"))
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # one row per target
    asked = F.lit(total_tokens) if total_tokens is not None else total
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce(z("tokens") / total, F.lit(0.0)).alias("share_of_mix"),
        F.coalesce(z("tokens") / asked, F.lit(0.0)).alias("share_of_total"),
        z("tokens").alias("tokens"),
        z("documents").alias("documents"),
        z("uses").alias("uses"),
        z("most_repeats").alias("most_repeats"),
    )
