"""Sinks: JSON documents, JSON lines, CSV tables, and results that a later run replaces as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str, *, key: str) -> None:
    """SK1: one JSON document for each row, below a folder named by its key (``key=value``)."""
    documents.withColumn("__key", F.col(key)).withColumnRenamed("__key", f"__{key}").write.mode("overwrite").partitionBy(f"__{key}").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """SK2: rows as JSON lines behind those that are there; fields without a value are written as null."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


#: What marks a file as UTF-8 for spreadsheets.
BOM = "\ufeff"


def write_csv(rows: DataFrame, path: str, *, order: list[str | Column] | None = None, bom: bool = False) -> None:
    """SK3: a CSV table with a header, sorted if an order is given. With ``bom`` it is one file that begins with BOM: its
    header is a row of its own, so that nothing but Spark writes; rows then pass through one task."""
    rows = rows.orderBy(*order) if order else rows
    if not bom:
        rows.write.mode("overwrite").option("header", "true").csv(path)
        return
    spark = rows.sparkSession
    quoted = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in quoted]
    body = rows.select(F.concat_ws(",", *quoted).alias("value"))
    head = spark.createDataFrame([(BOM + ",".join(rows.columns),)], "value string")
    head.coalesce(1).union(body.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


class Snapshots:
    """SK4: a table that every flush replaces as a whole; readers see the last whole one.

    A flush writes a new folder and then moves the name of the current one in a small file, so one that fails leaves
    the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def flush(self, rows: DataFrame) -> None:
        before = self._current()
        name = f"{self._number(before) + 1:010d}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").json(f"{self.root}/{name}")
        self._fs.create(self._path(f"{self.root}/_current.{name}"), True).close()
        for old in filter(None, [before]):
            self._fs.delete(self._path(f"{self.root}/_current.{old}"), False)
            self._fs.delete(self._path(f"{self.root}/{old}"), True)

    @staticmethod
    def _number(name: str | None) -> int:
        return int(name.split("-")[0]) if name else 0

    def _current(self) -> str | None:
        if not self._fs.exists(self._path(self.root)):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        marks = sorted(n.removeprefix("_current.") for n in names if n.startswith("_current."))
        return marks[-1] if marks else None

    def read(self, schema: str) -> DataFrame:
        name = self._current()
        return self.spark.read.schema(schema).json(f"{self.root}/{name}") if name else self.spark.createDataFrame([], schema)
