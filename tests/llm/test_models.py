"""The trained operators: language model, licences, toxicity, languages; against independent computations and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import langid, licenses, lm, toxicity

SF = "/root/testdata/sf0.01"


def lm_model(spark, rows):
    texts = lm.Texts.of(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3))
    counted = lm.count_words(texts)
    return texts, counted, lm.train(texts, counted)


def test_lm_scores_equal_token_by_token_sums(spark):
    """Every token's own conditional log-probability, by counts and single windows; all words' probabilities add up to 1."""
    rng = random.Random(6)
    words = [f"w{i:04d}{'abcdefgh'[i % 8]}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words[:40], k=30) + rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "single"), (103, "A\tb\na B"), (103, "A\tb\na B"), (None, "no id"), (104, "\xa0 é"), (105, "long " * 40_000)]
    texts, counted, model = lm_model(spark, rows)
    tally = Counter(w for _, t in rows for w in lm.words_of(t))
    top = sorted(tally, key=lambda w: (-tally[w], w))[: lm.FIRST_RARE]
    assert model.words == top
    of_token = Counter()
    for w, n in tally.items():
        if w not in set(top):
            of_token[zlib.crc32(w[-2:]) % lm.RARE] += n
    assert model.rare_counts == [of_token[k] for k in range(lm.RARE)]
    place = {w: i for i, w in enumerate(top)}
    got = lm.score(texts, model, lm.write_shares(texts, counted, model)).toPandas()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ws = lm.words_of(t)
        if i == 105:
            ws = ws[:50]
        ids = [place.get(w, lm.FIRST_RARE + zlib.crc32(w[-2:]) % lm.RARE) for w in ws]
        padded = [lm.PAD, lm.PAD, *ids, lm.PAD, lm.PAD]
        total = 0.0
        for k, w in enumerate(ws):
            window = np.array([[padded[k + 2 + o] for o in lm.OFFSETS]], np.int16)
            total += float(model.net.log_probabilities(window, np.array([ids[k]]))[0])
            if w not in place:
                total += math.log(tally[w] / of_token[zlib.crc32(w[-2:]) % lm.RARE])
        want[i] = (len(ws), total)
    for r in got.itertuples():
        i = None if np.isnan(r.doc_id) else int(r.doc_id)
        if i == 105:
            assert r.n_tokens == 40_000 and abs(r.mean_log_likelihood - want[i][1] / 50) < 0.05
        else:
            assert r.n_tokens == want[i][0] and abs(r.log_likelihood - want[i][1]) < 1e-2 + 1e-5 * abs(want[i][1])
    assert got[got.n_tokens == 0].mean_log_likelihood.isna().all() and (got.n_tokens == 0).sum() == 2
    every = np.exp(model.net.log_probabilities(np.repeat(np.array([[0, 1, 2, 3]], np.int16), lm.TOKENS, 0), np.arange(lm.TOKENS)))
    assert abs(every.sum() - 1) < 1e-3
    shares = Counter()
    for w, n in tally.items():
        if w not in place:
            shares[zlib.crc32(w[-2:]) % lm.RARE] += n / of_token[zlib.crc32(w[-2:]) % lm.RARE]
    assert all(abs(v - 1) < 1e-9 for v in shares.values())


def test_lm_trains_on_every_position(spark):
    start = lm.WindowNetwork.start(np.ones(lm.TOKENS)).to_bytes()
    docs = spark.createDataFrame([(t,) for t in ["a", "a b", "a b c", " ".join("abcdefghij"), "", None]], "text string")
    nets = docs.mapInArrow(lm._train_task([b"a", b"b", b"c"], start), lm.NET)
    assert sum(r["n"] for r in nets.select("n").collect()) == 1 + 2 + 3 + 10


def test_lm_beats_unigrams_on_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = F.col("doc_id") % 10 == 0
    texts = lm.Texts.of(docs.where(~out))
    counted = lm.count_words(texts)
    model = lm.train(texts, counted)
    unseen = lm.Texts.of(docs.where(out))
    got = lm.score(unseen, model, lm.write_shares(texts, counted, model)).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    tally = Counter(w for r in docs.where(~out).collect() for w in lm.words_of(r["text"]))
    n = sum(tally.values())
    unigram = sum(math.log(tally.get(w, 1 / (len(tally) + 1)) / n) for r in docs.where(out).collect() for w in lm.words_of(r["text"]) if w in set(model.words))
    known = {w: i for i, w in enumerate(model.words)}
    by_net, seen = 0.0, 0
    for r in docs.where(out).collect():
        ids, _ = lm.Vocabulary(model.words).read(r["text"])
        stream, _ = lm.padded([ids])
        at = np.flatnonzero((stream != lm.PAD) & (stream < len(known)))
        if len(at):
            by_net += float(model.net.log_probabilities(lm.windows(stream, at), stream[at].astype(np.int64)).sum())
            seen += len(at)
    assert got[1] > 0 and by_net / seen > unigram / seen + 0.05


MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
PROSE = ["Some plain sentence about the weather today.", "Another line of ordinary prose is here.", "Nothing of note was said."]


def runs_py(text, rare):
    """Paragraphs by a plain loop: (number of the first line, lines)."""
    out, run, gap = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        if set(licenses._words_py(line)) & rare:
            if not run:
                out.append((i, run))
            run += gap + [line]
            gap = []
        elif run and line.strip(" ") and not gap:
            gap = [line]
        else:
            run, gap = [], []
    return [(i, "\n".join(lines)) for i, lines in out]


@pytest.fixture(scope="module")
def licence_model():
    return licenses.train(PROSE * 20)


def test_scan_equals_plain_python(spark, licence_model):
    rng = random.Random(4)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts] + MIT.split("\n") + GPL.split("\n")
    texts = ["\n".join(rng.choice([rng.choice(notices), rng.choice(PROSE), "", "  "]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    texts += [None, "", "\n\n", "Licensed under CC BY-NC 4.0.", "x\x01y\nReleased under the MIT License.\x02\n\x03", f"{PROSE[0]}\n{MIT}\n{PROSE[1]}", texts[0]]
    rows = [*enumerate(texts), (None, texts[0])]
    got = {(r.doc_id, r.paragraph): (r.family, r.probability, r.similarity) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect()}
    want = {}
    for i, t in rows:
        for k, run in runs_py((t or "").translate(str.maketrans("\x01\x02\x03", "   ")), set(licence_model.rare)):
            p = licence_model.probabilities(run)
            family = licence_model.classes[int(p.argmax())]
            if family != licenses.UNKNOWN:
                grams = lambda s: {" ".join(w[j : j + 3]) for w in [licenses._words_py(s)] for j in range(max(1, len(w) - 2))}
                share = max(len(grams(x) & grams(run)) / len(grams(x)) for x in licenses.TEMPLATES[family])
                want[i, k] = (family, float(p.max()), share)
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], atol=1e-5) for k in want)


def test_wrapped_notices_are_confirmed(spark, licence_model):
    rows = [(1, f"Intro.\n\n{MIT}\n\nAnd prose."), (2, f"Intro.\n{GPL}\n\nEnd."), (3, "\n".join(PROSE)), (4, "word " * 200_000 + "\n" + MIT)]
    got = {r.doc_id: (r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect()}
    assert got == {1: ("mit", True), 2: ("gpl-3.0", True), 4: ("mit", True)}


def test_a_hot_line_does_not_fill_the_sample(spark):
    rows = [(i, "the same line of all\n" + f"own line {i}") for i in range(500)] + [(None, None), (1, "")]
    got = licenses.sample_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), rows=5000)
    assert len(got) == len(set(got)) == 501


def test_toxic_hits_equal_a_naive_search():
    rng = random.Random(3)
    letters = "abc"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 4)))
    for _ in range(60):
        model = toxicity.ToxicityModel({rng.choice([f" {w} ", f" {w}"]): rng.uniform(0.5, 3) for w in {word() for _ in range(6)}}, [f" {word()} {word()} " for _ in range(4)])
        text = toxicity.fold(" ".join(word() for _ in range(80)))
        spared = [(i, i + len(p) - 1) for p in model.exceptions for i in range(len(text)) if text.startswith(p, i)]
        total = 0.0
        for i in range(len(text)):
            hits = [w for t, w in model.weights.items() if text.startswith(t, i)]
            if hits and not any(a <= i < b for a, b in spared):
                total += max(hits)
        n = len(text.split())
        got = model.features(text, model.automaton())
        assert abs(got[0] - total / n) < 1e-9 and abs(got[1] - total / math.sqrt(n)) < 1e-9


def test_toxicity_of_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0] and n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))


def test_toxicity_of_odd_rows(spark):
    """Nulls, empties and very long texts score like texts without hits; equal texts and rows equal; many labels as few."""
    bad, good = "you utter moron and fool", "what a lovely day it is"
    rows = [(i, bad if i % 3 == 0 else good) for i in range(60)] + [(100, None), (101, ""), (102, "day " * 100_000), (None, bad), (103, bad), (103, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("Score"), F.lit("clash").alias("Held_Out"), F.lit(1).alias("toxic"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (999, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert [c.lower() for c in out.columns].count("score") == 1 and "toxic" in out.columns
    got = out.toPandas()
    by = {(-1 if np.isnan(i) else int(i)): s for i, s in zip(got.doc_id, got.score, strict=True)}
    assert len(got) == len(rows) and by[100] == by[101] and abs(by[102] - by[100]) < 1e-9 and by[100] < 0.5 < by[103] == by[-1]


@pytest.mark.parametrize("text", ["²½", "Ⅷ", "12 ³", "", None, "— !", "①"])
def test_no_letter_no_language(text):
    assert langid.vector(text) is None


def test_letters_beside_numbers():
    assert np.allclose(langid.vector("x² ½ abc"), langid.vector("x abc"))


def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).where("held_out and lang is not null").toPandas()
    judged = got[got.lang_pred != "und"]
    assert len(judged) > 0.9 * len(got) and (judged.lang_pred == judged.lang).mean() > 0.99 and judged.score.between(0, 1).all()


def test_votes_equal_plain_loops():
    """The machines' decision against a plain reading of the rule: best family, then most pairwise wins."""
    rng = np.random.default_rng(2)
    langs = ["de", "en", "nl", "fr", "es"]
    w = lambda: rng.normal(size=langid.DIMENSIONS + 1)
    model = langid.LanguageModel(langs, ["germanic", "romance"], np.stack([w(), w()]))
    model.pairs = {"germanic": [("de", "en", w()), ("de", "nl", w()), ("en", "nl", w())], "romance": [("es", "fr", w())]}
    for text in ["the cat", "der hund", "un chat noir", "abc " * 500, "x", "éé ñ"]:
        v = langid.vector(text)
        dot = lambda m: sum(float(a) * float(b) for a, b in zip(m[:-1], v, strict=True)) + float(m[-1])  # noqa: E731, B023
        family = max(range(2), key=lambda i: dot(model.family_weights[i]))
        pairs = model.pairs[model.families[family]]
        members = sorted({x for a, b, _ in pairs for x in (a, b)})
        wins = {m: sum((dot(p) >= 0) == (m == a) for a, b, p in pairs if m in (a, b)) for m in members}
        sums = {m: sum(dot(p) * (1 if m == a else -1) for a, b, p in pairs if m in (a, b)) for m in members}
        assert model.predict(text)[0] == max(members, key=lambda m: (wins[m], sums[m]))


def test_languages_of_odd_rows(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 40)]
    rows += [(500, None, "en"), (501, "", None), (502, "½ Ⅷ", "de"), (None, "the dog", None), (503, "hund und katze " * 60_000, None), (504, "the", None), (504, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit(7).alias("LANG_PRED"), F.lit(7).alias("Held_out"))
    out = langid.identify(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.toPandas()
    by = {(-1 if np.isnan(i) else int(i)): (p, s) for i, p, s in zip(got.doc_id, got.lang_pred, got.score, strict=True)}
    assert len(got) == len(rows) and by[500] == by[501] == by[502] == ("und", 0.0) and by[503][0] == "de" and by[-1][0] == "en"
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["doc_id"] for r in langid.accepted(none).collect()} == {r[0] for r in rows if r[1] and re.search("[a-z]", r[1])}


def test_digits_stand_for_letters_on_either_side():
    e = toxicity.EITHER
    cases = {"h3ll0": "hello", "worthle55": "worthless", "worthle$$!!": "worthless", "in 1984 for 100$": "in 1984 for 100", "a92": "a92", "!!! 0": "0", "x_7": "x 7"}
    assert {t: toxicity.fold(t).strip() for t in cases} == cases
    assert toxicity.fold("worth1e$$ id1ot f00l!you") == f" worth{e}ess id{e}ot fool{e}you "
    assert toxicity.fold("7" * 300_000 + " a" + "0" * 300_000).count("o") == 300_000


def test_one_is_the_letter_that_the_lexicon_has():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choices(letters, k=rng.randint(1, n)))
    for _ in range(200):
        lexicon = {rng.choice([f" {w} ", f" {w}"]): 1.0 for w in {word("ila", 5) for _ in range(5)}}
        text = word("1la", 6) + "a"
        variants = [""]
        for c in text:
            variants = [v + x for v in variants for x in (c if c != "1" else "il")]
        longest = max((len(t) for v in variants for t in lexicon if f" {v} ".startswith(t)), default=0)
        got = toxicity.plain(toxicity.fold(text), toxicity.ToxicityModel(lexicon, []).automaton())
        assert got.strip() in variants
        assert max((len(t) for t in lexicon if got.startswith(t)), default=0) == longest
    assert toxicity.plain(toxicity.fold("b1b1b"), toxicity.ToxicityModel({}, []).automaton()) == " bibib "


def test_lexicon_equals_a_loop_over_terms(spark):
    """Rare terms enter however many rows there are; a longer term stays only if it says clearly more; ties in any order."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdef", k=rng.randint(3, 6))) for _ in range(150)]
    rows = [(" ".join(rng.choices(words, k=12) + (["zorgle"] if i % 50 == 0 else ["fool", "foolish"][: 1 + i % 2] if i % 2 else [])), 1) for i in range(1000)]
    rows += [(" ".join([*rng.choices(words, k=12), *(["folk"] if i % 3 == 0 else ["zorgle sings"] if i % 40 == 1 else [])]), 0) for i in range(1000)] + [(None, 1), ("", 0)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    count: dict[str, list[int]] = {}
    for t, y in rows:
        for term in toxicity.terms(toxicity.fold(t)):
            count.setdefault(term, [0, 0])[1 - y] += 1
    count = {t: c for t, c in count.items() if c[0] >= toxicity.MIN_DOCS}
    odds, passing = {}, []
    for t, (a, b) in count.items():
        odds[t] = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
        mean = (a + b) * n1 / (n1 + n0)
        ratio = 2 * (a * math.log(a / mean) + (b * math.log(b / (a + b - mean)) if b else 0))
        if odds[t] >= toxicity.MIN_ODDS and ratio >= toxicity.CHANCE * math.log(len(count)):
            passing.append(t)
    begins = lambda t, s: s != t and t.startswith(s) and not s.endswith(" ") and len(s) > toxicity.SHORTEST
    wanted = {t: math.log(odds[t]) for t in passing if all(odds[t] > toxicity.CLEARLY * odds[s] for s in passing if begins(t, s))}
    assert " foo" in wanted and set(model.weights) == set(wanted)
    assert all(abs(model.weights[t] - w) < 1e-9 for t, w in wanted.items())


def test_words_are_told_once(monkeypatch):
    """A text with a few new words costs a look for these only, and what is remembered stays bounded; tokens and shares stay the same."""
    told, crc32 = [], zlib.crc32
    monkeypatch.setattr(lm.zlib, "crc32", lambda x: told.append(x) or crc32(x))
    monkeypatch.setattr(lm, "HELD_WORDS", 50)
    vocabulary = lm.Vocabulary([b"a", b"b"])
    token = lambda w: {b"a": 0, b"b": 1}.get(w, lm.FIRST_RARE + crc32(w[-2:]) % lm.RARE)
    ids, rare = vocabulary.read("a x y b x A y")
    assert ids.dtype == np.int16 and ids.tolist() == [token(w) for w in b"a x y b x a y".split()] and rare == [b"x", b"y", b"x", b"y"]
    assert len(told) == 2 and vocabulary.ids("x y a").tolist() == [token(w) for w in (b"x", b"y", b"a")] and len(told) == 2
    many = [b"w%d" % i for i in range(300)]
    assert vocabulary.ids(b" ".join(many).decode()).tolist() == [token(w) for w in many] and len(vocabulary.id_of) <= 52
    assert vocabulary.ids("b a").tolist() == [1, 0] and vocabulary.ids(None).tolist() == [] and vocabulary.read("")[1] == []
    shares = lm.Shares.__new__(lm.Shares)
    shares.known, shares.once, shares.h, shares.share = {}, [-float(k) for k in range(lm.RARE)], np.zeros(0, np.int64), np.zeros(0, np.float32)
    for words in (many, [b"w1", b"w1", b"w299", b"new"], []):
        of = np.arange(len(words)) % 2
        want = [sum(shares.once[token(w) - lm.FIRST_RARE] for w in words[k::2]) for k in (0, 1)]
        assert np.allclose(shares.sums(words, of, 2), want)
