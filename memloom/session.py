"""Session factory and the few cluster services the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "memloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; pick one only on a local master (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "memloom-checkpoints"))


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of all executors, once per application. The archive is
    written on the driver and handed out by Spark; workers that have the package already are not harmed."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_memloom_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="memloom-")) / "memloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._memloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that is far dearer than moving its rows. A large table has more
    partitions than that and stays as it is. Meant for scans with narrow steps: their partitions are known without running them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory of tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
