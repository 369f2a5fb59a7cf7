"""Every stage of the corpus pipeline on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultloom.llm import decontaminate, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "This line is the one that five documents or more share"
ITEM = "What is the longest river that flows through the northern plains of the country"


def near(n):
    words = [f"word{i}" for i in range(200)]
    words[n * 17 % 200] = f"other{n}"
    return " ".join(words)


ROWS = [
    *((i, f"{SHARED}\nthe own text of document number {i} with words of its own {i * 7919}", "en", "a", 1) for i in range(10, 18)),
    *((100 + i, near(i), "en", "b", 1) for i in range(5)), (120, near(0), "en", "b", 1), (121, near(0), "en", "b", 1), (121, near(0), "en", "b", 1),
    (200, f"Before it. {ITEM.replace('longest', 'longezt')}. After it.", "en", "c", 1), (201, "the clean text about some river in the country", "en", "c", 1),
    (300, None, None, None, None), (301, "", "en", "c", 0), (302, "½ 123 !!", "en", "c", 0), (303, "the long " * 30_000, "en", "c", 1), (None, "a text without an id of its own", "en", None, 1),
    (304, SHARED, "en", "c", 1), (305, "no", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["id", "h", "fp", "key", "score", "lang_pred", "n_dropped", "held_out", "component_id", "TEXT_", "item_id", "piece", "start", "length"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in extra])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


ALL = sorted(-1 if r[0] is None else r[0] for r in ROWS)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "sequences"]


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "benchmark", "sequences"])
def test_empty_table(spark, docs, name):
    out = stage(name)(spark, docs.limit(0), SF)
    assert out.count() == 0
    if name != "sequences":
        assert out.columns == corpus_pipeline.COLUMNS


def test_language_stage(spark, docs):
    out = stage("language")(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS and ids(out) == [i for i in ALL if i not in (300, 301, 302)]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(stage("language")(spark, unlabelled, SF)) == ids(out)


def test_lines_stage_by_brute_force(spark, docs):
    out = stage("lines")(spark, docs, SF)
    where: dict[str, set] = {}
    for i, t, *_ in ROWS:
        for line in (t or "").split("\n"):
            if len(line.strip().lower()) >= 40:
                where.setdefault(line.strip().lower(), []).append(i)
    want = []
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        hot = lambda x: len(where.get(x.strip().lower(), ())) >= 5
        last = lambda x: max(-1 if j is None else j for j in where[x.strip().lower()])
        kept = [x for x in lines if not hot(x) or last(x) == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            want.append((-1 if i is None else i, "\n".join(kept)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and out.columns == corpus_pipeline.COLUMNS
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_duplicates_stage(spark, docs):
    """One of the near copies, one of the empties; repeated rows of the kept id stay as one document."""
    kept = ids(stage("near_duplicates")(spark, docs, SF))
    assert kept == [i for i in ALL if i not in (101, 102, 103, 104, 120, 121, 301)]


def test_benchmark_stage_by_brute_force(spark, docs, tmp_path):
    items = [(1, ITEM), (2, None), (3, ""), (4, "know"), (5, "No!"), (6, ITEM)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert ids(stage("benchmark")(spark, docs, str(tmp_path))) == [i for i in ALL if i not in (200, 305)]
    assert not decontaminate.Matcher([(1, "no")], 0.1, 20).matches("I know")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert ids(stage("benchmark")(spark, docs, f"{tmp_path}/none")) == ALL


def test_sequences_stage_by_brute_force(spark, docs):
    out = stage("sequences")(spark, docs, SF).toPandas()
    words = tokens.word_ids(tokens.default_tokenizer())
    want = []
    for i, t, *_ in ROWS:
        data = words.ids(t) + b"\1\0\0\0"
        for k, at in enumerate(range(0, len(data), 4 * 4096)):
            part = data[at : at + 4 * 4096]
            want.append((-1 if i is None else i, k, at // 4, len(part) // 4, zlib.crc32(part)))
    got = out.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


def test_the_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * n < out.select("doc_id").distinct().count() <= n
