"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from faultloom.llm import decontaminate, html, langid, licenses, linededup, lm, media, packing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog again and again"
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here but text", "en", "a", 5), (3, f"{LINE}\nown line", "en", "a", 3),
    (3, f"{LINE}\nown line", "en", "a", 3), (4, f" {LINE.upper()} \nx", "en", None, 3), (5, f"{LINE}\n\n{LINE}", None, "b", 3), (6, LINE, "en", "b", 3),
    (7, LINE, "de", "b", 3), (8, "123 456 !!!", "en", "b", 3), (9, LONG, "en", "b", 3), (10, "der die und das nicht ein schöner tag", "de", "c", 1),
    (11, "le chat est dans la maison avec une amie", "fr", "c", 1), (12, "el perro está en la casa con su amigo", "es", "c", 1), (13, "\n", "en", "c", 1),
    (14, "Licensed under the Apache License, Version 2.0.\n", "en", "c", 1),
]
#: Names that operators use for columns of their own.
EXTRA = ["id", "h", "fp", "length", "start", "piece", "value", "used", "shard", "copy", "n_lines", "n_dropped", "score", "lang_pred", "predicted", "term",
         "host", "key", "path", "toxic", "component_id", "rep", "sequence_id", "drops", "keeper", "held_out", "a", "b"]


def extended(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def docs(spark):
    return extended(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return extended(spark.createDataFrame([], SCHEMA))


def labels(spark, rows=((3, 0), (6, 1), (7, 1), (10, 0), (None, 1), (99, None))):
    return spark.createDataFrame([(i, 0, y) for i, y in rows], "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, LINE), (2, None), (3, ""), (4, LINE))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def operators(spark):
    return {
        "packing": packing.pack_documents,
        "toxicity": lambda d: toxicity.toxicity(d, labels(spark)),
        "langid": langid.identify,
        "licenses": licenses.scan_licences,
        "lm": lm.lm_scores,
        "leaks": lambda d: decontaminate.leaks(d, bench(spark)),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench(spark)),
        "line_dedup": linededup.line_dedup,
        "near_components": simhash.near_components,
        "near_dedup": simhash.near_dedup,
        "media": media.media_columns,
    }


NAMES = ["packing", "toxicity", "langid", "licenses", "lm", "leaks", "decontaminate", "line_dedup", "near_components", "near_dedup", "media"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    assert operators(spark)[name](none).count() == 0


#: Operators that return each row once.
WHOLE = {"toxicity", "langid", "lm", "line_dedup", "near_components", "media"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    out = operators(spark)[name](docs).toPandas()
    if name in WHOLE:
        assert len(out) == len(ROWS)
    if name == "line_dedup":
        by = out.set_index(out.doc_id.fillna(-1).astype(int))
        assert by.loc[6, "text"] == "" and by.loc[7, "text"] == LINE and by.loc[5, "n_dropped"] == 2
        assert by.loc[1, "text"] == "" and by.loc[1, "n_lines"] == 1 and by.loc[2, "n_lines"] == 1
        assert set(by.loc[3, "n_dropped"]) == {1} and by.loc[4, "text"] == "x"
    if name == "langid":
        by = out.set_index(out.doc_id.fillna(-1).astype(int)).lang_pred
        assert by[1] == by[2] == by[8] == "und" and by[9] != "und"
        assert by[10] == "de"
    if name == "near_components":
        by = out.set_index(out.doc_id.fillna(-1).astype(int))
        near = [i for i, t, *_ in ROWS if i and (simhash.fingerprint(t) ^ simhash.fingerprint(LINE)).bit_count() <= 3]
        assert near == [3, 3, 5, 6, 7] and set(by.loc[[3, 5, 6, 7], "component_id"]) == {3} and by.loc[1, "fp"] == 0 and by.loc[2, "component_id"] == 1
    if name == "near_dedup":
        assert not {5, 6, 7} & set(out.doc_id) and 3 in set(out.doc_id)
    if name == "leaks":
        assert set(out.item_id) == {1, 4} and {6, 7, 3}.issubset(set(out.doc_id)) and 9 not in set(out.doc_id)
    if name == "decontaminate":
        assert 6 not in set(out.doc_id) and out.doc_id.isna().sum() == 1
    if name == "packing":
        assert set(out.length.groupby(out.doc_id.fillna(-1)).sum().loc[[1, 2]]) == {1} and out.length.max() <= 4096
    if name == "licenses":
        assert out[["doc_id", "family", "confirmed"]].values.tolist() == [[14, "apache-2.0", True]]
    if name == "media":
        assert (out.loc[out.n_bytes == 0, "payload_bytes"] == 64).all() and (out.payload_bytes % 64 == 0).all()


def test_no_labels(spark, docs):
    out = toxicity.toxicity(docs, labels(spark, [])).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all()


def test_no_benchmark(spark, docs):
    assert decontaminate.leaks(docs, bench(spark, [])).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.org/x", None), (2, "http://a.org/y", ""), (3, None, "<p>text without host</p>"), (4, "http://a.org/z", "<div class=main><p>Hello &amp; more</p></div><nav>menu</nav>"),
            (4, "http://a.org/z", "<div class=main><p>Hello &amp; more</p></div><nav>menu</nav>"), (5, "not a url", "plain words only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", F.lit("clash").alias("text"), F.lit("clash").alias("path"), F.lit("clash").alias("host"))
    out = html.extract_pages(pages).toPandas()
    got = {i: t for i, t in zip(out.page_id, out.text, strict=True)}
    assert got == {1: "", 2: "", 3: "text without host", 4: "Hello & more", 5: "plain words only"} and len(out) == 6
    assert html.extract_pages(pages.limit(0)).count() == 0
