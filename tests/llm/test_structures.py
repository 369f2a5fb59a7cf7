"""Filters, joins, groups and components behind the operators, and their bounds."""

import itertools
import random
import tarfile
import time

import numpy as np
from pyspark.sql import functions as F

from faultloom.llm import bloom, common, components, decontaminate, linededup, media, simhash


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    got = bloom.Bloom.of(keys)
    others = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert got.holds(keys.toPandas()["h"].to_numpy()).all() and got.holds(others).mean() < 0.05
    full = bloom.Bloom.of(keys, max_bits=64)
    assert full.holds(others).mean() > 0.9 and len(full.words) == 1
    none = bloom.Bloom.of(keys.limit(0))
    assert not none.holds(others).any()


def test_without_is_an_anti_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(400)], "doc_id long, n int")
    ids = spark.createDataFrame([(3,), (4,), (4,), (None,), (999,)], "i long")
    want = sorted(r["n"] for r in docs.collect() if r["doc_id"] not in (3, 4, None))
    for limit in (200_000, 0):
        monkeypatch.setattr(bloom, "BROADCAST_IDS", limit)
        assert sorted(r["n"] for r in bloom.without(docs, ids, F.col("doc_id")).collect()) == want


def test_hot_keys_are_split_and_joined_whole(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, n long")
    lookup = spark.createDataFrame([(i, f"v{i}") for i in range(0, 3000, 2)], "k long, v string")
    got = common.spread_join(rows, lookup, "k", by=["n"])
    want = rows.join(lookup, "k", "left")
    key = lambda df: sorted((r["k"], r["n"], r["v"] or "") for r in df.collect())
    assert key(got) == key(want) and sorted(got.columns) == ["k", "n", "v"]


def test_top_rows(spark):
    rows = spark.createDataFrame([(i % 17, i) for i in range(500)], "a int, b int")
    got = [tuple(r) for r in common.top_rows(rows, 30, [F.desc("a"), F.col("b")]).collect()]
    assert sorted(got, key=lambda r: (-r[0], r[1])) == sorted([(i % 17, i) for i in range(500)], key=lambda r: (-r[0], r[1]))[:30]


def test_checksum_of_many_edges(spark):
    """Twenty million edges: a sum of 40-bit hashes would overflow."""
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    n, x = components.checksum(edges)
    assert n == 20_000_000 and components.checksum(edges.where("u % 2 = 0").union(edges.where("u % 2 = 1"))) == (n, x)


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_exchanged_whatever_their_number(spark):
    """A join by broadcast over few documents would hide how the exchange grows."""
    docs = spark.createDataFrame([(i, f"{'a line that many documents share ' * 2}\nown {i}") for i in range(8)], "doc_id long, text string")
    out = linededup.line_dedup(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.doc_id, r.text) for r in out.collect())[:2] == [(0, "own 0"), (1, "own 1")]


def test_near_components_end_to_end(spark):
    """Rows to component ids against all pairs, with copies, nulls, empties, repeated rows and a hot text."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(30, 400))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [*enumerate(texts, 10), *((500 + i, "the hot text of a third of all") for i in range(60)), (1, None), (2, ""), (3, " \n"), (11, texts[1]), (None, texts[4]), (900, "x " * 90_000)]
    fp = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            root[find(b)] = find(a)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("fp"), F.lit("clash").alias("component_id"))
    got = sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_components(df).collect())
    assert got == sorted((i or -1, fp[k], least[find(k)]) for k, (i, _) in enumerate(rows))


def test_groups_are_bounded_by_all_probes(spark):
    """Unique lines, which no document drops, load the shards as well: their groups are split too."""
    rows = [(i, "\n".join(f"Line {i} {j} that no other document has in it at all" for j in range(50))) for i in range(400)]
    rows += [(1000 + i, "A line that very many of these documents share, hot as it is") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.lines_to_drop(docs, shard_keys=2000, group_probes=100)
    assert {r["doc_id"]: len(r["drops"]) for r in out.collect()} == {1000 + i: 1 for i in range(2999)}
    probes = docs.select(F.col("doc_id").alias("id"), F.explode(linededup._hashes(F.col("text"), 40)).alias("x")).select("id", "x.h", "x.fp")
    shard = F.pmod("h", F.lit(4)).alias("shard")
    index = probes.select(shard).groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    sent, copied = linededup.dealt(probes.select("*", shard), index, 100, small=True)
    sizes = [r["count"] for r in sent.groupBy("shard", "copy").count().collect()]
    assert sum(sizes) == 23_000 and max(sizes) < 200
    assert sent.join(copied, ["shard", "copy"], "left_anti").isEmpty()


def test_each_payload_is_stored_once_and_headers_read_alone(spark, tmp_path):
    rows = [(i, f"text {i % 40}" if i % 3 else "hot") for i in range(600)] + [(None, None), (7, ""), (7, ""), (8, "é" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    root = f"file://{tmp_path}/shards"
    data = docs.select(media.digest_of(media.payload_of(F.col("text"))).alias("digest"))
    index = media.store_distinct(docs, data.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), root)
    index.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    names = [m.name for f in (tmp_path / "shards").glob("*.tar") for m in tarfile.open(f)]
    want = {media.hashlib.sha256(media.pad((t or "").encode())).hexdigest() for _, t in rows}
    assert len(names) == len(set(names)) == len(want) and {n.removesuffix(".png") for n in names} == want
    told = lambda df: {r["digest"].hex(): (r["width"], r["height"], r["bits"]) for r in df.collect()}
    got = told(media.headers(index, root))
    assert got == told(media.read_back(index, root)) and set(got) == want


def distance(pattern, text):
    """The least edit distance of the pattern to a substring of the text."""
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        least = min(least, row[-1])
    return least


def spans_within(item, text, most):
    """Whether some run of whole words is at most so many edits from the item, over all runs."""
    words = text.split()
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            run = " ".join(words[i:j])
            if len(run) > len(item) + most:
                break
            row = list(range(len(run) + 1))
            for x, c in enumerate(item):
                new = [x + 1]
                for y, d in enumerate(run):
                    new.append(min(row[y + 1] + 1, new[y] + 1, row[y] + (c != d)))
                row = new
            if row[-1] <= most:
                return True
    return False


def test_leaks_equal_all_distances(spark):
    """Every pair of document and item by dynamic programming; short items must be whole lines."""
    rng = random.Random(5)
    vocabulary = ["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "far", "away", "stock", "phrase"]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    stock = "it is the stock phrase of all items that "
    items = [(i, stock + sentence(8)) for i in range(40)] + [(50 + i, sentence(rng.randint(5, 25))) for i in range(15)]
    items += [(70, "the cat ran"), (71, "on a mat."), (72, "Dog, far away"), (73, "a on a cat a mat")]
    items += [(80, "no"), (81, "A"), (82, "To be!"), (83, None), (84, "?!"), (85, items[0][1])]
    rows = []
    for k in range(60):
        t = list(rng.choice(items[:55])[1])
        for _ in range(rng.randint(0, len(t) // 6)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", " ", "zz"])
        rows.append((k, f"{sentence(20)}\n{''.join(t)} {sentence(10)}"))
    rows += [(100, "I know a banal cannon"), (101, "yes\nNO.\nmaybe"), (102, "to be or not"), (103, "x\nTo  be"), (104, None), (105, ""), (None, stock * 3), (106, "a"), (106, "a"), (108, "x thecat ran"), (109, "on a mats"), (110, "we saw thy cat ran off"), (111, "on a mat"), (107, "word " * 30_000)]
    want = []
    for i, t in rows:
        n = decontaminate.normalise(t)
        lines = {decontaminate.normalise(x) for x in (t or "").split("\n")}
        for j, x in items:
            m = decontaminate.normalise(x)
            if len(m) >= 20:
                hit = i != 107 and distance(m, n) <= int(0.1 * len(m))
            elif len(m.split()) >= 3:
                hit = i != 107 and spans_within(m, n, int(0.1 * len(m)))
            else:
                hit = bool(m) and m in lines
            if hit:
                want.append((-1 if i is None else i, j))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("item_id"), F.lit("clash").alias("start"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 500):
        got = [(-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark, block_chars=size).collect()]
        assert sorted(got) == sorted(want)
    assert (110, 70) in want and (111, 71) in want and not {(109, 71)} & set(want)
    assert {(101, 80), (103, 82), (106, 81)} <= set(want) and not {100, 102} & {i for i, _ in want}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(
        -1 if i is None else i for i, _ in rows if (-1 if i is None else i) not in {a for a, _ in want}
    )


def test_a_stock_phrase_of_many_items_stays_cheap():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tail = lambda: "".join(rng.choices(letters + " ", k=60))
    text = ("choose the right answer from these " + tail() + " ") * 40

    def seconds(n):
        matcher = decontaminate.Matcher([(i, "choose the right answer from these " + tail()) for i in range(n)], 0.1, 20)
        t = time.process_time()
        matcher.matches(text)
        return time.process_time() - t

    assert seconds(3200) < 8  # 384,000 pairs of a hit and an item that has the piece


def test_spans_are_swept_in_linear_time():
    from faultloom.llm import toxicity

    model = toxicity.ToxicityModel({" bad ": 1.0}, [" bad cat "])
    automaton = model.automaton()

    def seconds(n):
        text = " " + "bad cat bad dog " * n
        t = time.process_time()
        assert np.isclose(model.features(text, automaton)[0] * (text.count(" ") - 1), n)
        return time.process_time() - t

    assert seconds(40_000) < 40 * max(seconds(4000), 1e-3)


def test_configuration_program_reaches_its_dual_bound():
    """Every class of a histogram is covered, and the number is within 2 % of a bound that holds for any cover, whatever the counts."""
    from faultloom.llm import packing

    rng = np.random.default_rng(4)
    cases = [(np.array([60]), np.array([7]), 100), (np.array([51, 60, 99]), np.array([10, 1, 1_000_000]), 100)]
    for k in range(24):
        capacity = int(rng.integers(20, 300))
        lengths = np.sort(rng.choice(np.arange(1, capacity), min(int(rng.integers(1, 40)), capacity - 1), replace=False))
        cases.append((lengths, (10 ** rng.uniform(0, 1 + k % 6, len(lengths))).astype(int), capacity))
    for lengths, counts, capacity in cases:
        groups = packing._classes(lengths, counts, 40)
        mass = np.array([(lengths[g] * counts[g]).sum() for g in groups])
        assert np.concatenate(groups).tolist() == list(range(len(lengths))) and len(groups) <= 80 and mass.min() >= mass.sum() / 80 * (1 - 1e-9)
        lengths, counts = np.array([int(np.average(lengths[g], weights=counts[g])) for g in groups]), np.array([counts[g].sum() for g in groups])
        solved, bound = packing.solve_configurations(lengths, counts, capacity)
        cover = np.zeros(len(lengths))
        for taken, x in solved:
            assert sum(lengths[i] * n for i, n in taken.items()) <= capacity
            for i, n in taken.items():
                cover[i] += n * x / counts[i]
        assert cover.min() > 1 - 1e-9 and sum(x for _, x in solved) <= 1.02 * bound
    assert packing.solve_configurations(np.array([60]), np.array([7]), 100)[1] == 7
