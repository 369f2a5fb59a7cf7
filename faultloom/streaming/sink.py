"""A table that a stream fills batch by batch: each batch counts once, whatever fails in between."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Buckets of keys; a batch reads those that its own keys fall in.
BUCKETS = 64


class KeyedSink:
    """Rows by key, in folders ``rows/__bucket=b/__run=r/__batch=i``; a batch is committed by an empty file ``commits/r/i``.

    ``keep="first"``: a batch adds the rows whose keys no committed batch has; of equal keys in a batch the first by ``order``. ``keep="last"``: it adds all, and readers take
    each key's row of the latest batch, of equal keys in it the last by ``order``. A batch that is run again first removes what its failed attempt left, and one that is committed does nothing. ``run`` tells the
    batches of several streams apart; later runs come after earlier ones by name.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], *, keep: str = "first", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.keep, self.buckets = spark, path.rstrip("/"), schema, keys, order, keep, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _mark(self, run: str, batch: int):
        return self._hadoop(f"{self.path}/commits/{run}/{batch}")

    def _last(self) -> dict[str, int]:
        """The last committed batch of each run; a run's batches are committed in order."""
        root = self._hadoop(f"{self.path}/commits")
        if not self._fs.exists(root):
            return {}
        runs = [s.getPath() for s in self._fs.listStatus(root)]
        return {r.getName(): max((int(s.getPath().getName()) for s in self._fs.listStatus(r)), default=-1) for r in runs}

    def _stored(self) -> DataFrame:
        """All committed rows with their bucket, run and batch."""
        schema = StructType([*self.schema.fields]).add("__bucket", "integer").add("__run", "string").add("__batch", "long")
        last = self._last()
        if not self._fs.exists(self._hadoop(f"{self.path}/rows")) or not last:
            return self.spark.createDataFrame([], schema)
        whole = F.lit(False)
        for run, batch in last.items():
            whole = whole | ((F.col("__run") == run) & (F.col("__batch") <= batch))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(whole)

    def write(self, batch: DataFrame, number: int, *, run: str = "run") -> None:
        """For ``foreachBatch``: add a batch."""
        if number <= self._last().get(run, -1):
            return
        left = self._fs.globStatus(self._hadoop(f"{self.path}/rows/__bucket=*/__run={run}/__batch={number}"))
        for status in left or []:
            self._fs.delete(status.getPath(), True)
        rows = batch.select(*self.schema.fieldNames())
        pick = F.min_by if self.keep == "first" else F.max_by
        one = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in self.keys]).agg(pick(F.struct(*rows.columns), F.struct(*self.order, *rows.columns)).alias("__row")).select("__row.*")
        dealt = one.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        if self.keep == "first":
            touched = [r[0] for r in dealt.select("__bucket").distinct().collect()]  # no more than there are buckets
            known = self._stored().where(F.col("__bucket").isin(touched)).select(*[F.col(k).alias(f"__k_{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
            dealt = dealt.join(known, same, "left_anti")
        told = dealt.withColumn("__run", F.lit(run)).withColumn("__batch", F.lit(number).cast("long"))
        told.repartition("__bucket").write.mode("append").partitionBy("__bucket", "__run", "__batch").parquet(f"{self.path}/rows")
        self._commit(run, number)

    def _commit(self, run: str, number: int) -> None:
        self._fs.create(self._mark(run, number), True).close()

    def read(self) -> DataFrame:
        """One row for each key."""
        stored = self._stored()
        if self.keep == "last":
            latest = F.max_by(F.struct(*self.schema.fieldNames()), F.struct("__run", "__batch"))
            stored = stored.groupBy(*[F.col(k).alias(f"__k_{k}") for k in self.keys]).agg(latest.alias("__row")).select("__row.*")
        return stored.select(*self.schema.fieldNames())

    def start(self, results: DataFrame, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
        """Fill the table from a stream until its input is read. The run goes by the place of the checkpoint, whose batches it counts."""
        run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        writer = results.writeStream.outputMode(mode).foreachBatch(lambda batch, number: self.write(batch, number, run=run))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
