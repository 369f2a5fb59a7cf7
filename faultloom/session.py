"""Session settings, table access and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, *, app: str = "faultloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; sizes stay Spark's own unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="faultloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder: what follows reads these rows, also if an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled_by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt and sorted by the keys, and settled: joins by them take its rows as they lie, and only the other side is exchanged.

    A plan that adapts doesn't tell how its rows lie, so this one doesn't.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(dealt)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
