import datetime
import os

from pyspark.sql import functions as F

from memloom.streaming import pipelines


def start(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def feed(spark, path, batches, schema):
    """Each batch as a file, older ones first."""
    for k, rows in enumerate(batches):
        known = set(path.glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for p in set(path.glob("*.parquet")) - known:
            os.utime(p, (1_700_000_000 + 60 * k,) * 2)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_route_counts_accumulate(spark, tmp_path):
    feed(spark, tmp_path / "in", ([("a",), (" ",)], [("a",), (None,)]), "route string")
    start(pipelines.route_counts(stream(spark, tmp_path / "in", "route string")), "routes", "complete")
    assert {r.route: r.calls for r in spark.table("routes").collect()} == {"a": 2, "unknown": 2}


def test_windows_drop_late_rows(spark, tmp_path):
    t = lambda h, m: datetime.datetime(2025, 1, 1, h, m)
    batches = ([(t(1, 0), "x", 1.0), (t(1, 5), "x", 2.0)], [(t(9, 0), "x", 1.0)], [(t(10, 0), "x", 1.0)], [(t(1, 1), "x", 5.0), (t(20, 0), "x", 1.0)])
    feed(spark, tmp_path / "in", batches, "ts timestamp_ntz, kind string, value double")
    s = stream(spark, tmp_path / "in", "ts timestamp_ntz, kind string, value double")
    start(pipelines.windowed(s, "ts", "1 hour", "30 minutes", ["kind"]), "windows", "append")
    got = {r.start.hour: (r.n, r.total) for r in spark.table("windows").collect()}
    assert got[1] == (2, 3.0) and got[9] == (1, 1.0)


def test_each_key_once(spark, tmp_path):
    schema = "row_key string"
    spark.createDataFrame([("a",), ("b",), ("a",)], schema).write.parquet(str(tmp_path / "in"))
    work = lambda df: df.withColumn("answer", F.upper("row_key"))
    done, mark = str(tmp_path / "done"), str(tmp_path / "mark")
    pipelines.process_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "row_key", done, mark, work).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    # Without its checkpoint the stream sees everything again, as after a loss; results stay single.
    for m in (mark, mark + "2"):
        pipelines.process_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "row_key", done, m, work).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(done).select("row_key", "answer").collect())) == [("a", "A"), ("b", "B"), ("c", "C")]


def test_trajectories(spark, tmp_path):
    schema = "trajectory bigint, seq int, kind string"
    feed(spark, tmp_path / "in", ([(1, 1, "generate"), (1, 2, "call"), (2, 1, "generate")], [(1, 3, "result"), (1, 4, "generate"), (1, 5, "final"), (1, 6, "generate")]), schema)
    start(pipelines.trajectory_states(stream(spark, tmp_path / "in", schema)), "trajectories", "update")
    rows = [tuple(r) for r in spark.table("trajectories").collect()]
    assert (1, "done", 2, 1) in rows and (2, "generating", 1, 0) in rows
