"""What the reviews of the operators found, each on a small input."""

import itertools
import random

from faultloom.llm import jaccard


def _reaches(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_pipeline_links_ordinary_near_copies(spark):
    """All pairs of 5-word shingle sets at a Jaccard similarity of 0.8 or more, checked by brute force."""
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, " ".join(copy), "en", "s", 0))
            at += 1
    rows += [(at, "", "en", "s", 0), (at + 1, None, "en", "s", 0), (at + 2, "one two", "en", "s", 0), (at + 3, "One  two", "en", "s", 0)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t, *_ in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any(sets[a] != sets[b] for a, b in edges)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = _reaches(edges, sets)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_pipeline_near_copies_of_a_large_bucket(spark):
    """Neighbours of a chain link although no centre is similar to all."""
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 104])) for i in range(90)]
    got = {r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_near_copies_are_compared_with_what_they_were_made_from(spark, monkeypatch):
    """The pairs that sketches are fetched for follow the group, not its square."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(220)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        near = list(base)
        for k in range(4):
            near[rng.randrange(len(near))] = f"x{i}y{k}"
        rows.append((i, " ".join(near)))
    made = []
    save = jaccard.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.startswith("links") and name.endswith("-pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard.Scratch, "save", counted)
    got = {r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} and 0 < sum(made) < 4 * len(rows)


def test_small_buckets_need_no_rounds(spark, monkeypatch):
    """Texts that share bands but don't link: each round's plans and jobs stay in the driver's memory, so buckets of few keys have none."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(6):  # any two have some 0.7 of their shingles in common
            at = sorted(rng.sample(range(12, 110, 7), 2))
            rows.append((len(rows), " ".join(f"{w}n{i}" if k in at else w for k, w in enumerate(base))))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rounds, scans = [], []
    save = jaccard.Scratch.save

    def seen(self, df, name):
        if name.startswith("live"):
            rounds.append(name)
        if name.startswith("labels"):
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return save(self, df, name)

    monkeypatch.setattr(jaccard.Scratch, "save", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _reaches(edges, sets) and len(set(got.values())) > 6
    assert len(rounds) <= 2 and len(set(scans)) == 1  # a plan of the same size, however many rounds
