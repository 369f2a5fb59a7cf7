"""Aligned tokens, the n-gram join and fill-in-the-middle against direct computations; odd rows; long licence texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultloom.llm import alignment, fim, jaccard, licenses, ngramjoin

PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "don't", "the", "Word", "foo,bar", "é", "中文字", "。", "，", "🙂", "123", "(", "<|endoftext|>", "<s>",
          " ", "　", "▁", "_", "é", "ﬁ", "​", "\x00", "x" * 30, "ß", "—", "“q”"]
CLASH = ["uid", "at", "key", "node", "value", "n", "pairs", "ns", "fragment", "output", "form", "best", "a", "b"]


@pytest.fixture(scope="module")
def own():
    return alignment.aligner(*alignment.default_paths())


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PIECES, k=rng.randint(1, 25))) for _ in range(n)]
    return [t.replace("▁", "") or "x" if i % 2 else t for i, t in enumerate(out)]


def direct(own, text):
    """Groups as text, counts and links of one text, tokenized whole; None without tokens."""
    a, b = own.a.encode(" " + (text or ""), add_special_tokens=False).ids, own.b.encode(text or "")
    bytes_a, bytes_b = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    i = j = 0
    groups, links = [], Counter()
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links[a[x - 1], b[y - 1]] += 1
        i, j = x, y
    return ";".join(groups), len(a), len(b), links


def test_short_texts_equal_whole_tokenization(own):
    some = texts(1500, 1)
    for t, (ok, groups, n_a, n_b, links) in zip(some, own.short([" " + t for t in some]), strict=True):
        want = direct(own, t)
        assert (want is None) == (not ok), t
        if want:
            assert (groups, n_a, n_b, {(k >> 32, k & 0xFFFFFFFF): n for k, n in links.items()}) == want, t


def test_fragments_compose_in_any_order(own):
    """Ranges of a few characters, whose sides often begin apart, composed in random order, also through their stored form."""
    rng, apart = random.Random(2), 0
    for t in texts(1200, 3):
        for size in (3, 7):
            ranges = list(own.ranges(" " + t, size))
            apart += any(start_a != start_b for _, start_a, _, start_b in ranges)
            parts = [own.tokens(*r) for r in ranges]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [alignment._load(alignment._dump(alignment.compose(parts[i], parts[i + 1])))]
            f, want = alignment.whole(parts[0]), direct(own, t)
            assert (want is None) == (not f.ok or not f.links)
            if want:
                assert (";".join(f.groups), f.n_a, f.n_b, Counter(f.links)) == want, (t, size)
    assert apart > 200


@pytest.mark.parametrize(("size", "fan_in", "head"), [(1 << 16, 16, 1 << 20), (7, 2, 1 << 20), (20, 3, 25)])
def test_aligned_documents(spark, own, size, fan_in, head):
    some = [*texts(60, 5), "the the Word", "the the Word", "", None, "a longer text, of words " * 40]
    rows = [(i, t) for i, t in enumerate(some)] + [(None, "the Word"), (0, some[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    got = alignment.align_tokens(docs, size=size, fan_in=fan_in, head_pairs=head).collect()
    told = [(i, direct(own, t)) for i, t in rows]
    count = sum((w[3] for _, w in told if w), Counter())
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    want = [(i, 0, 0, 0, 0, 0, 0, "") if w is None else (
        i, w[1], w[2], sum(w[3].values()), sum(w[3].values()), sum(n for p, n in w[3].items() if count[p] == most[p[1]]), sum(n * count[p] for p, n in w[3].items()),
        hashlib.sha256(w[0].encode()).hexdigest()) for i, w in told]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert alignment.align_tokens(docs.limit(0)).count() == 0


def grams(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("max_bucket", [256, 2])
def test_joined_components_equal_all_pairs(spark, max_bucket):
    """Near copies at all distances from the threshold, copies, templates whose copies don't link, short and odd texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    some = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 6)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            some.append(" ".join(near))
    template = rng.choices(words, k=80)
    some += [" ".join(template + rng.choices(words, k=9)) for _ in range(40)]
    some += [" ".join(template[:70] + rng.choices(words, k=20)) for _ in range(20)] + some[:10]
    some += [" ".join(rng.choices(words[:3], k=rng.randint(20, 40))) for _ in range(60)]  # few n-grams, so that buckets hold many texts that don't link
    some += [None, "", " \n", "one", "One", "two words", "a b c", "a b c d", "A  B\tC d", "one " * 3000, "É é", " ".join(rng.choices(words, k=20_000))]
    rows = list(enumerate(some, 10)) + [(10, some[0]), (None, some[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    got = ngramjoin.jaccard_components(docs, max_bucket=max_bucket).collect()
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    want = [(doc, len(sets[i]), low.get(find(i))) for i, (doc, _) in enumerate(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert ngramjoin.jaccard_components(docs.limit(0)).count() == 0


def test_copies_of_one_text_are_compared_with_it_only(spark, monkeypatch):
    """Copies that link with what they were made from, hardly with each other: the pairs follow the group, not its square."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    some = [base]
    for i in range(400):
        near = list(base)
        for k in range(3):
            near[rng.randrange(len(near))] = f"x{i}y{k}"
        some.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(some)]
    rng.shuffle(rows)
    compared = []
    overlapping = ngramjoin.Segments.overlapping
    monkeypatch.setattr(ngramjoin.Segments, "overlapping", lambda self, pairs, name: compared.append(pairs.count()) or overlapping(self, pairs, name))
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and sum(compared) < 3 * len(rows)


def test_parities_bound_the_difference(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 5, 40, 150, 3000):
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, rng.integers(1, n + 1), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            rows.append((len(a), jaccard.parities(a).tolist(), len(b), jaccard.parities(b).tolist(), 100 * both >= 85 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "n long, x array<long>, m long, y array<long>, links boolean")
    got = df.select("links", jaccard.may_reach(F.col("n"), F.col("x"), F.col("m"), F.col("y"), 85).alias("may")).collect()
    assert all(r.may for r in got if r.links) and any(r.links for r in got) and sum(not r.may for r in got) > 100


def test_long_texts_that_share_a_rare_ngram_are_not_compared(spark, monkeypatch):
    """Parities tell nothing of long sets, and their segments are what a round exchanges most of; buckets of the same nodes are looked at once."""
    rng = random.Random(11)
    some = [[f"w{rng.randrange(10**6)}" for _ in range(3000)] for _ in range(12)]
    for t in some:  # a passage of several rare n-grams in all of them
        t[100:110] = [f"p{i}" for i in range(10)]
    some.append([*some[3][:50], "other", *some[3][51:]])
    compared, overlapping = [], ngramjoin.Segments.overlapping
    monkeypatch.setattr(ngramjoin.Segments, "overlapping", lambda self, pairs, name: compared.append(pairs.count()) or overlapping(self, pairs, name))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == {**{i: i for i in range(12)}, 12: 3} and sum(compared) == 1


def test_counts_bound_the_difference():
    rng = np.random.default_rng(5)
    rows = []
    for n in (600, 2000, 9000):
        for share in (0.0, 0.5, 0.9, 0.92, 0.95, 1.0):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share) + 7, dtype=np.uint64)])
            rows.append((len(rows), 0, -(-85 * (len(a) + len(b)) // 185), 0, 0, len(a) + len(b), ngramjoin.hash_counts(a), ngramjoin.hash_counts(b), len(np.intersect1d(a, b))))
    rows.append((len(rows), 0, 900, 0, 0, 1900, None, rows[0][7], 950))
    batch = pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(6)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (6, 7))], list("abcdefgh"))
    kept = {i for x in ngramjoin.counts_allow(iter([batch])) for i in x.column(0).to_pylist()}
    assert kept >= {r[0] for r in rows if r[8] >= r[2]} and not kept & {r[0] for r in rows if r[8] == 0}


def test_buckets_of_the_same_nodes_are_one(spark):
    rows = [(v, node, True) for v in range(5) for node in (1, 2, 3)] + [(v, node, True) for v in (7, 8) for node in (1, 2)]
    rows += [(9, 1, True), (9, 4, False), (9, 3, True), (10, 1, True), (11, 5, False), (11, 6, False)]
    got = sorted((r.k, r.a, r.b) for r in ngramjoin.distinct_buckets(spark.createDataFrame(rows, "value long, node long, shows boolean")).collect())
    assert got == [(2, 1, 2), (3, 1, 3), (3, 1, 4)]


def test_words_of_a_batch_are_those_of_each_text():
    texts = [None, "", " ", "A", "a b\x0bc\td", *(f"x{chr(i)}y {chr(i)} z É\u2003é" for i in range(1, 128)), " lead and trail \n", "one " * 900]
    for k in (1, 4):
        got = list(ngramjoin.ngrams(pa.array(["q", *texts, "r"])[1:-1], k))
        for t, h in zip(texts, got, strict=True):
            words = ngramjoin.word_hashes(pa.array([w.decode() for w in (t or "").encode().lower().split()], pa.string()))
            assert np.array_equal(h, ngramjoin._combined(words, k)) and len(h) == (max(1, len(words) - k + 1) if len(words) else 0)
    some = [f"{x}{'y' * n}" for x in range(50) for n in range(90)] + ["\x00" * n for n in range(1, 80)]
    assert len(set(ngramjoin.word_hashes(pa.array(["a", *some])[1:]).tolist())) == len(some)


def test_prefixes_are_long_enough():
    """No pair of sizes at the threshold fits beside disjoint prefixes."""
    for n in range(1, 400):
        for m in range(n, 480):
            need = -(-85 * (n + m) // 185)
            if need <= n:
                assert ngramjoin._least(n, 85)[0] >= n - need + 1 and ngramjoin._least(m, 85)[1] >= m - need + 1


def test_wavelet_matrix_counts_and_finds():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 128, 1000):
        symbols = rng.choice(8, size, p=[0.6, 0.1, 0.1, 0.1, 0.02, 0.02, 0.05, 0.01]).astype(np.uint8)
        m = fim.WaveletMatrix(symbols)
        for c in range(8):
            places = np.flatnonzero(symbols == c).tolist()
            assert [m.rank(c, i) for i in range(size + 1)] == [sum(p < i for p in places) for i in range(size + 1)] if size < 200 else m.rank(c, size) == len(places)
            assert [m.select(c, k) for k in range(len(places))] == places


SPLITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"}


@pytest.mark.parametrize("unit", list(SPLITS))
def test_cuts_equal_split_units(unit):
    rng = random.Random(6)
    for _ in range(400):
        t = "".join(rng.choices(["a", "bc", " ", "\n", "🙂é", ".", "\n\n", "\t"], k=rng.randint(0, 30)))
        parts = re.findall(SPLITS[unit], t)
        units = fim.Units(t, unit)
        assert units.n == len(parts), (t, parts)
        assert [units.cut(k) for k in range(units.n + 1)] == [len("".join(parts[:k])) for k in range(len(parts) + 1)]


def test_sentences():
    units = fim.Units("One. Two! 3.5 is it? No", "sentence")
    assert units.n == 4 and [units.cut(k) for k in range(5)] == [0, 4, 9, 20, 23]


def test_fill_in_middle(spark):
    rng = random.Random(7)
    some = ["".join(rng.choices(["line\n", "x", "<", "<S", ">", "\n", "é🙂 "], k=rng.randint(0, 12))) for _ in range(150)] + [None, "", "a<P>b", "long line\n" * 50_000, "\n"]
    rows = [*enumerate(some), (3, some[3]), (None, "no\nid\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored("output", "form")).collect()
    want = []
    for i, t in rows:
        t = t or ""
        units = re.findall(SPLITS["line"], t)
        h = [int(x, 16) for x in re.findall(".{8}", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest())[:4]]
        j, k = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:j], units[j:k], units[k:]))
        if not t or re.search("<[PSM]>", t):
            want.append((i, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 50:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len({w[2] for w in want}) == 3
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_licences_of_very_long_texts(spark):
    """200,000 plain lines before, between and after notices, and a run of 20,000 telling lines."""
    notice = "Licensed under the Apache License, Version 2.0."
    plain = "\n".join(f"plain line {i} of words" for i in range(200_000))
    rows = [(1, "\n".join([plain, notice, plain, notice, plain])), (2, "\n".join([notice] * 20_000)), (3, f"fox\n{notice}\nfox\n{notice}\n\n{notice}\nquick\nfox\n{notice}")]
    model = licenses.train(licenses.sample_paragraphs(spark.createDataFrame([("the quick brown fox",)], "text string")))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r["doc_id"], r["paragraph"]) for r in got] == [(1, 200_000), (1, 400_001), (2, 0), (3, 1), (3, 5), (3, 8)]
