"""Every registered query of the library against its SQL counterpart, run by DuckDB on the same tables."""

import datetime
import decimal
import difflib
import math
import os
import re

import duckdb
import pytest

from faultloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(norm, v))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for _, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple(norm(x) for _, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def truth_lines(duck):
    """c15_c19_truth_lines by difflib on whole texts."""
    out = []
    for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        a, b = t.splitlines(), re.sub(r"(?m)^The\b", "A", t).splitlines()
        lines = {j + 1 for op, _, _, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes() if op in ("replace", "insert") for j in range(j1, j2)}
        out.append((i, ",".join(str(x) for x in sorted(lines) if x > 4)))
    return ["doc_id", "lines"], out


def balance(duck):
    """sch1_balance by a loop over the nations."""
    load, out = [0.0] * 8, []
    for g, w in duck.execute("SELECT CAST(c_nationkey AS VARCHAR) AS g, sum(c_custkey) AS w FROM customer GROUP BY 1 ORDER BY w DESC, g").fetchall():
        k = load.index(min(load))
        load[k] += float(w)
        out.append((g, k))
    return ["group", "shard"], out


BRUTE_FORCE = {"c15_c19_truth_lines": truth_lines, "sch1_balance": balance}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_equals_brute_force(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns, rows = BRUTE_FORCE[name](duck)
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, rows)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
