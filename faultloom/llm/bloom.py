"""Bloom filters of large key tables, built by Spark: rows that can't match a join needn't be exchanged for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Ids that are sent to every task as they are; more are checked by a filter first.
BROADCAST_IDS = 200_000
#: 8 MB at most, whatever the number of keys; with more than fit, more rows pass that needn't.
MAX_BITS = 1 << 26
PROBES, BITS_A_KEY = 4, 12


class Bloom:
    """``may_hold(hash)`` is true for all keys the filter was built on, and for a few others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, *, n: int | None = None, max_bits: int = MAX_BITS) -> Bloom:
        """hashes: a table of one column of 64-bit hashes. The bits are combined in Spark; the driver gets
        max_bits / 64 words at most."""
        (name,) = hashes.columns
        n = hashes.count() if n is None else n
        bits = min(max_bits, max(64, 1 << (BITS_A_KEY * n).bit_length()))
        low, high = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(name), 32)
        at = F.explode(F.array(*[(low + i * high.bitwiseOR(F.lit(1))).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]))
        one = F.expr("shiftleft(1L, cast(at & 63 as int))")
        found = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        out = np.ones(len(h), bool)
        for i in range(PROBES):
            at = (low + np.uint64(i) * high) & np.uint64(len(self.words) * 64 - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def may_hold(self, df: DataFrame, hashes: Column) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Bloom(shared.value)
            for part in parts:
                yield pd.Series(own.holds(part.to_numpy()))

        return run(hashes)


def without(docs: DataFrame, ids: DataFrame, column: Column) -> DataFrame:
    """The rows of docs whose ``column`` (a long; null equals null) is not in ids, a table of one column.

    Rows are exchanged only if there are many ids and the filter doesn't clear the row.
    """
    gone = Scratch(docs.sparkSession, "without").save(ids.toDF("__gone").distinct(), "ids")
    n, same = gone.count(), column.eqNullSafe(F.col("__gone"))
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), same, "left_anti")
    may = Bloom.of(gone.select(F.xxhash64("__gone").alias("h")), n=n).may_hold(docs, F.xxhash64(column))
    return docs.where(~may).union(docs.where(may).join(gone, same, "left_anti"))


def among(ids: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """``keep(rows, column)``: the rows whose ``column`` (a long) is in ids, a table of one column, and with many ids
    a few others. No row is exchanged."""
    kept = Scratch(ids.sparkSession, "among").save(ids.toDF("__id").distinct(), "ids")
    n = kept.count()
    if n <= BROADCAST_IDS:
        return lambda rows, column: rows.join(F.broadcast(kept), F.col(column) == F.col("__id"), "left_semi")
    bloom = Bloom.of(kept.select(F.xxhash64("__id").alias("h")), n=n)
    return lambda rows, column: rows.where(bloom.may_hold(rows, F.xxhash64(column)))
