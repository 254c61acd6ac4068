import collections

from memloom.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)]


def sized(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def corpus():
    rows = [(k, "a", 50 + k % 37) for k in range(2000)] + [(10_000 + k, "b", 80 + k % 11) for k in range(200)]
    return rows + [(20_000, "c", 90), (30_000, None, 10), (30_001, "other", 10), (30_002, "a", 0), (1, "a", 51)]


def test_shares_caps_and_order(spark):
    total = 60_000
    mix = mixing.mix_sources(sized(spark, corpus()), targets(spark), total, block_tokens=64).collect()
    got, uses = collections.Counter(), collections.Counter()
    for r in mix:
        got[r.source] += r.n_tokens
        uses[r.source, r.id, r["pass"]] += 1
    assert set(got) == {"a", "b", "c"}
    assert abs(got["a"] - 0.5 * total) < 100 and abs(got["b"] - 0.3 * total) < 100
    assert got["c"] == 180  # one document, twice
    passes = collections.defaultdict(set)
    for s, i, p in uses:
        passes[s, i].add(p)
    assert all(len(p) <= {"a": 1, "b": 3, "c": 2}[s] for (s, _), p in passes.items())
    # Documents of a slot have an order.
    assert len({(r.slot, r.place) for r in mix}) == len(mix) and all(0 <= r.place < 64 for r in mix)
    # Every prefix has the shares.
    last = max(r.slot for r in mix)
    half = collections.Counter()
    for r in mix:
        if r.slot <= last // 2:
            half[r.source] += r.n_tokens
    assert abs(half["a"] / (half["a"] + half["b"]) - 0.5 / 0.8) < 0.03


def test_report_and_repeatability(spark):
    df, t = sized(spark, corpus()), targets(spark)
    one, two = (sorted(map(tuple, mixing.mix_sources(df, t, 30_000, seed=7).collect())) for _ in range(2))
    assert one == two
    report = {r.source: r for r in mixing.mix_report(mixing.mix_sources(df, t, 30_000), t, 30_000).collect()}
    assert report["gone"].tokens == 0 and report["gone"].share_of_mix == 0
    assert abs(report["a"].share_of_total - 0.5) < 0.01
    assert report["c"].most_repeats == 2


def test_empty(spark):
    t = targets(spark)
    assert mixing.mix_sources(sized(spark, []), t).count() == 0
    assert mixing.mix_sources(sized(spark, [(1, "x", 5), (2, None, None)]), t).count() == 0
    assert mixing.mix_sources(sized(spark, corpus()), t.limit(0)).count() == 0
    assert {r.tokens for r in mixing.mix_report(mixing.mix_sources(sized(spark, []), t), t).collect()} == {0}


def test_schedule_is_even(spark):
    rows = mixing.schedule(spark, [("a", 0.6), ("b", 0.3), ("c", 0.1)], 5000).orderBy("slot").collect()
    seen = collections.Counter()
    for r in rows:
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        n = r.slot + 1
        assert abs(seen["a"] - 0.6 * n) < 6 and abs(seen["c"] - 0.1 * n) < 6
