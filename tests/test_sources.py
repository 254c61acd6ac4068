import json

import pytest
from pyspark.sql import functions as F

from memloom.sources import readers, writers


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü", None), (1, "x", 0.5)], "b int, a string, c double")
    writers.write_jsonl(df, str(tmp_path / "out"))
    back = readers.read_jsonl(spark, str(tmp_path / "out"), "a string, b int, c double")
    assert sorted(map(tuple, back.collect())) == [("x", 1, 0.5), ("ü", 2, None)]
    line = next(p for p in (tmp_path / "out").glob("part-*.txt") if p.stat().st_size).read_text().splitlines()[0]
    assert list(json.loads(line)) == sorted(json.loads(line))


def test_jsonl_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n[1]\n{"a": \n')
    loose = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()
    assert sorted((r.a is None, r.bad_line) for r in loose if r.bad_line) == [(True, "[1]"), (True, '{"a": ')]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_records_and_items(spark, tmp_path):
    d = tmp_path / "snapshots" / "abc" / "travel" / "rome"
    d.mkdir(parents=True)
    (d / "one.json").write_text('{"data": [{"q": 1}, {"q": 2}]}')
    (d / "two.json").write_text('[{"q": 3}]')
    r = readers.read_records(spark, str(tmp_path))
    assert sorted((x.stem, x.revision, tuple(x.directories)) for x in r.collect()) == [("one", "abc", ("travel", "rome")), ("two", "abc", ("travel", "rome"))]
    items = readers.items_of(r).select("stem", "position", F.col("item").cast("string").alias("i")).collect()
    assert sorted(map(tuple, items)) == [("one", 0, '{"q":1}'), ("one", 1, '{"q":2}'), ("two", 0, '{"q":3}')]


def test_latest_dump_and_splits(spark, tmp_path):
    for name in ("9.jsonl", "10.jsonl", "last.jsonl", "11.txt"):
        (tmp_path / name).write_text("{}")
    assert readers.latest_dump(spark, str(tmp_path)).endswith("/10.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.prepared_splits(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "val.parquet"))
    assert list(readers.prepared_splits(spark, str(tmp_path))) == ["val"]


def test_banks(spark, tmp_path):
    rows = [{"data_source": "s", "conversation_id": "c", "memories": ["plain", {"id": "m1", "text": "t"}]}, {"data_source": "s", "conversation_id": "c", "checkpoint_id": "k", "memories": []}]
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("b.json", "b.jsonl"):
        got = {r.checkpoint_id: r["items"] for r in readers.read_banks(spark, str(tmp_path / name)).collect()}
        assert got == {None: ["plain", '{"id":"m1","text":"t"}'], "k": []}
    (tmp_path / "twice.json").write_text(json.dumps([rows[0], rows[0]]))
    with pytest.raises(ValueError, match="twice"):
        readers.read_banks(spark, str(tmp_path / "twice.json"))


def test_profiles(spark, tmp_path):
    p = {"model": "Big", "aliases": ["B1"], "input_price_per_million_usd": 1, "output_price_per_million_usd": 2, "latency_base_seconds": 0, "latency_input_seconds_per_token": 0, "latency_output_seconds_per_token": 0, "latency_image_seconds": 0}
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"profiles": [p], "default": "b1"}))
    assert {(r.identifier, r.canonical) for r in readers.read_profiles(spark, str(path)).collect()} == {("big", "Big"), ("b1", "Big")}
    path.write_text(json.dumps({"profiles": [p, {**p, "model": "Other", "aliases": ["big"]}]}))
    with pytest.raises(ValueError, match="two models"):
        readers.read_profiles(spark, str(path))
    path.write_text(json.dumps({"profiles": [{**p, "latency_base_seconds": -1}]}))
    with pytest.raises(ValueError, match="not negative"):
        readers.read_profiles(spark, str(path))


def test_progress(spark, tmp_path):
    out = str(tmp_path / "log")
    writers.append_progress(spark.createDataFrame([("a", "pending"), ("b", "complete")], "row_key string, status string").coalesce(1), out)
    assert {r.row_key: r.status for r in readers.last_progress(spark, out, "row_key", "row_key string, status string").collect()} == {"a": "pending", "b": "complete"}


def test_images_and_captions(spark):
    rows = [("ffd8ff00", "image/jpeg"), ("89504e470d0a1a0a", "image/png"), ("524946460000000057454250", "image/webp"), ("00", None)]
    df = spark.createDataFrame(rows, "hex string, want string").withColumn("got", readers.image_type(F.unhex("hex")))
    assert all(r.got == r.want for r in df.collect())
    rows = [('{"description": {"final_text": "a"}, "caption": "b"}', "a"), ('{"caption": " b "}', "b"), ('{"final_text": "c"}', "c"), ("{}", ""), (None, "")]
    df = spark.createDataFrame(rows, "j string, want string").withColumn("got", readers.caption_of(F.col("j")))
    assert all(r.got == r.want for r in df.collect())


def test_other_writers(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("val", 2), ("train", 3)], "split string, x int")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'train'").count() == 2
    m = json.loads(writers.manifest(df, ["split"], {"run": 1}).first()[0])
    assert m["counts"] == [{"split": "train", "rows": 2}, {"split": "val", "rows": 1}]
    writers.write_call_counts(spark.createDataFrame([("b", "m", 2), ("a", "unknown", 0)], "route string, model string, calls int"), str(tmp_path / "c"))
    body = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert body == "a\tunknown\t0\nb\tm\t2\n"
    assert len(writers.short_name("ü" * 300 + ".tsv").encode()) <= 200 and writers.short_name("x.tsv") == "x.tsv"
