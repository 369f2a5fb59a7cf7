"""The library's functions under SQL names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import code, text


class Hunks:
    """A table function: the hunks of one diff, as (line, old lines, new lines)."""

    def eval(self, diff: str):
        yield from ((at, len(old), len(new)) for at, old, new in text.changes_of(diff or ""))


FUNCTIONS: dict[str, Callable] = {
    "parse_diff": text.parse_diff, "ground_truth": text.ground_truth, "apply_diff": text.patched, "salvage_json": text.salvage_json,
    "balanced_json": text.balanced_json, "assemble_patch": code.assembled,
}


def register(spark: SparkSession, extra: dict[str, Callable] | None = None) -> list[str]:
    """Register FUNCTIONS, ``diff_hunks`` and the caller's own for SQL; returns their names."""
    named = FUNCTIONS | (extra or {})
    for name, f in named.items():
        spark.udf.register(name, f)
    spark.udtf.register("diff_hunks", udtf(Hunks, returnType="line int, old_lines int, new_lines int"))
    return sorted([*named, "diff_hunks"])
