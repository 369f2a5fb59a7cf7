"""Helpers shared by the text operators: tables, shared scratch folders, deterministic folds."""

from __future__ import annotations

import uuid
import zlib
from contextlib import contextmanager
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: What ``[\x20\x09-\x0D]`` stands for, as the argument of a trim.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task exchanges with Python at once.
ROWS_AT_ONCE = 2000


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for the jobs that run inside: rows of texts take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder to cut lineage or to be read more than once.

    A written table survives the loss of any executor. What a result still reads stays until the
    session's JVM ends, or until ``drop_scratch`` is called; ``drop`` removes a table that is no longer needed.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._delete_on_exit()
        Scratch.made.append(self)

    def _fs(self, path: str):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _delete_on_exit(self) -> None:
        fs, p = self._fs(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with batches_of(self.spark, ROWS_AT_ONCE):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, schema: str, names: list[str]) -> DataFrame:
        """Saved tables of one schema as one: a plan of one scan, however many there are."""
        return self.spark.read.schema(schema).parquet(*map(self.path, names))

    def drop(self, name: str) -> None:
        fs, p = self._fs(self.path(name))
        fs.delete(p, True)


def drop_scratch() -> None:
    """Delete all scratch tables of this process, for long sessions; results not yet written can't be read any more."""
    while Scratch.made:
        fs, p = (scratch := Scratch.made.pop())._fs(scratch.root)
        fs.delete(p, True)


def crc_fold(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_fold_py(value: object, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_rows(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in order, without n rows of every partition in one place: the first n of each of 64 groups,
    then of those."""
    groups = Window.partitionBy(F.pmod(F.xxhash64(*rows.columns), F.lit(64))).orderBy(*order)
    some = rows.withColumn("__rank", F.row_number().over(groups)).where(F.col("__rank") <= n)
    every = Window.partitionBy(F.lit(0)).orderBy(*order)
    return some.withColumn("__rank", F.row_number().over(every)).where(F.col("__rank") <= n).drop("__rank")


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, *, by: list[str], counts: DataFrame | None = None) -> DataFrame:
    """rows left-joined with lookup, which has each key once, without a task that gets all rows of a hot key.

    Keys of over a quarter of a partition's share of rows are split by a hash of ``by``, with as many copies of
    their lookup row. There are fewer of them than four times the partitions, so they are broadcast.
    counts: (key, n), if the caller has it. Keys aren't null; a row whose key lookup lacks gets nulls.
    """
    spark = rows.sparkSession
    counts = counts if counts is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(1, -(-total // (4 * shuffle_partitions(spark))))
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("__copies")))
    copies = F.coalesce("__copies", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__copy", F.pmod(F.xxhash64(*by), copies)).drop("__copies")
    copied = lookup.join(hot, key, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("__copies")
    return dealt.join(copied, [key, "__copy"], "left").drop("__copy")
