"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import random
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultloom.llm import decontaminate, html, langid, licenses, linededup, media, packing, simhash, tokens, toxicity
from faultloom.llm.mph import Mph


def test_minimal_perfect_hash_is_one_to_one():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    mph = Mph.from_bytes(Mph.build(keys).to_bytes())
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
    assert Mph.build(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200, unique=True))
@settings(max_examples=30, deadline=None)
def test_minimal_perfect_hash_any_keys(keys):
    assert sorted(Mph.build(np.array(keys, np.uint64)).index(np.array(keys, np.uint64)).tolist()) == list(range(len(keys)))


def test_covering_masks_cover_all_small_differences():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not diff & m for m in masks)


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tC d b c D"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(" \n") == 0 and simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_give_brute_force_components(spark, bucket):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps)[:30]:
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    want = Counter(Counter(find(f) for f in fps).values())
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.near_links(nodes, max_bucket=bucket)
    parts = simhash.connected_components(links).toPandas()
    got = Counter(parts.root.value_counts().tolist())
    got[1] += len(fps) - len(parts)
    assert got == want


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Shared line number {i} of the pool with enough characters in it" for i in range(6)]
    rows = [(i, "\n".join(rng.choices([*pool, "short", f"Own line of document {i} which is long enough to count"], k=6))) for i in range(60)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    where: dict[str, set] = {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(x) >= 40:
                where.setdefault(x.lower(), set()).add(i)
    for i, t in rows:
        kept = [x for x in t.split("\n") if not (len(x) >= 40 and len(where[x.lower()]) >= 5 and max(where[x.lower()]) != i)]
        assert got[i] == ("\n".join(kept), len(t.split("\n")) - len(kept))


TEXTS = ["", "Hello, world!", "don't 've <|endoftext|> x", "Ünïcode naïve É***", "a\x1cb", "tab\tand nbsp", "ﬁne ① 数学 ок", "it's'll 12ab3 ...'s", "İstanbul Σίσυφος"]


@given(st.lists(st.sampled_from(["the", "'s", "Ab1", "é", "<|", "!!!", " ", "\n", "数", "é", "\x1c", " ", "x-y"]), max_size=30).map("".join))
@settings(max_examples=150, deadline=None)
def test_word_ids_equal_the_tokenizers(text):
    words = tokens.word_ids(tokens.default_tokenizer())
    for t in [text, *TEXTS]:
        want = np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.ids(t) == want


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
@settings(max_examples=40, deadline=None)
def test_plans_place_everything_once(histogram):
    plan = packing.plan_sequences(histogram, 64, classes=8)
    used: dict[int, int] = {}
    places = []
    for length, first, ranks, copies, seq, offset in plan.runs.tolist():
        assert first == used.get(length, 0)
        used[length] = first + ranks
        places += [(seq + r // copies, offset + r % copies * length, length) for r in range(ranks)]
    assert used == histogram
    places.sort()
    at: dict[int, int] = {}
    for seq, offset, length in places:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert all(v <= 64 for v in at.values()) and len(at) == plan.sequences
    assert plan.sequences <= 1.25 * plan.bound + 2


def test_knapsack_is_exact():
    lengths, values = np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0])
    assert packing.knapsack(lengths, values, 7)[1] == 9.0 and packing.knapsack(lengths, values, 10)[1] == 14.0


def test_packed_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.choice([5, 5, 5, 900, 2000, 9000])))) for i in range(120)] + [(500, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    words = tokens.word_ids(tokens.default_tokenizer())
    for i, t in rows:
        ids = words.ids(t) + b"\1\0\0\0"
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.length.sum() * 4 == len(ids) and mine.start.tolist() == [4096 * k for k in range(len(mine))]
        for _, r in mine.iterrows():
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=40), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_myers_equals_dynamic_programming(pattern, text, most):
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        least = min(least, row[-1]) if text else least
    scores = [least]
    got = decontaminate.myers(pattern, text, most)
    if text:
        first_row = len(pattern)
        want = min(scores) if min(scores) <= most and min(scores) < first_row or most >= first_row else min(scores)
        assert (got is not None and got[0] == want) if want <= most and got is not None else got is None or got[0] == want


def test_edited_items_are_found():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(30))) for i in range(20)]
    matcher = decontaminate.Matcher(items, 0.1, 20)
    for i, t in items:
        n = decontaminate.normalise(t)
        k = int(0.1 * len(n))
        chars = list(n)
        for at in rng.sample(range(len(chars)), k):
            chars[at] = rng.choice(["", "z", chars[at] + "q"])
        found = matcher.matches("Some text before, " + "".join(chars) + " and after it.")
        assert [f[0] for f in found] == [i] and found[0][1] <= k
        assert not matcher.matches(" ".join("".join(rng.choices(letters, k=5)) for _ in range(200)))


def test_media_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["", "same text", "same text", "é" * 100, "x" * 100_000, None])]
    out = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, t in rows:
        payload = media.pad((t or "").encode())
        r = out.loc[i]
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload) and r.n_bytes == len((t or "").encode())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.width * r.height == len(payload)
        assert media.png_decode(media.png_encode(payload)) == payload and r.media_sha256 == hashlib.sha256(media.png_encode(payload)).hexdigest()
    assert out.loc[1, "feature"] == out.loc[2, "feature"]
    assert out.loc[1, "shard"] == out.loc[2, "shard"] and out.loc[1, "offset"] == out.loc[2, "offset"]
    writer = media.ShardWriter(f"file://{tmp_path}")
    name, at = writer.put("a.png", b"data")
    writer.close()
    raw = (tmp_path / name).read_bytes()
    assert raw[at : at + 4] == b"data" and tarfile.open(fileobj=io.BytesIO(raw)).extractfile("a.png").read() == b"data"


def test_toxic_words_in_disguise():
    assert toxicity.fold("M0r0n, ѕсum! $tupid") == " moron scum stupid "
    model = toxicity.ToxicityModel({" moron ": 5.0, " clown ": 4.0}, [" clown fish "], bias=-2.0, slopes=(50.0, 0.0))
    a = model.automaton()
    assert model.score(model.features(toxicity.fold("you m0ron"), a)) > 0.9
    assert model.features(toxicity.fold("a clown fish swims"), a) == (0.0, 0.0) and model.score((0.0, 0.0)) < 0.5


def test_licence_classes():
    model = licenses.train(["Some plain sentence about the weather today.", "Another line of ordinary prose is here."] * 20)
    name = lambda t: model.classes[int(model.probabilities(t).argmax())]
    for family, notices in licenses.TEMPLATES.items():
        assert [name(t) for t in notices] == [family] * len(notices)
    assert {name(t) for t in [*licenses.LOOK_ALIKES, "", "Mit und.", "A sentence of no interest."]} == {licenses.UNKNOWN}


def test_host_paths_agree(spark):
    rows = [(i, "http://h.example/x", f"<div class='wrap'><div class=post-{i}><p>{'word ' * 40}</p><div class=comments><p>{'reply ' * 200}</p></div></div><aside>side</aside></div>") for i in range(5)]
    rows.append((9, "http://h.example/y", "<div class='wrap'><div class=post-9><p>Short &eacute;t&eacute;.</p></div><div class=teaser><p>Teaser text</p></div></div>"))
    out = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == " ".join(["word"] * 40) and out[9] == "Short été."


def test_vector_of_chunks_is_that_of_the_whole():
    text = "abc déf " * 50_000
    whole, chunk = langid.vector(text), langid.CHUNK
    try:
        langid.CHUNK = 1000
        assert np.allclose(langid.vector(text), whole)
    finally:
        langid.CHUNK = chunk
