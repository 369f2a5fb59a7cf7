"""Near duplicates by the Jaccard similarity of word shingles: hash tables propose pairs, an exact check decides.

Texts with equal shingle sets are one node. Two kinds of tables propose pairs: the covering tables of the
nodes' SimHash fingerprints (all within the radius), and MinHash bands for what is further apart. Pairs whose
MinHash sketches rule the threshold out are dropped before texts are fetched for them. A pair at
the threshold of 0.8 shares none of the 40 bands of 5 with a chance of (1 - 0.8^5)^40 = 1.3e-7, a more similar
pair with less; it differs in about 10 bits of its fingerprints, out of reach of any covering tables of
a size that can be built. A larger bucket's nodes are never paired with each other all at once: a few centres of
each are compared with the rest, and buckets whose nodes are linked by then are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, among
from .common import Scratch, batches_of, spread_join
from .components import connected_components
from .simhash import RADIUS, majority
from .simhash import near_links as covering_links

SHINGLE, THRESHOLD, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 5
#: A pair whose sketches agree by less than the threshold less this is no match: six deviations of 200 values.
SLACK = 0.17
#: Pairs of texts that a task holds at once.
PAIRS_AT_ONCE = 256
#: Bits that bound the difference of two sets from below, exactly.
PARITIES = 256
#: In buckets of so many keys at most, all pairs are looked at.
FEW = 16
#: Each round compares so many times more centres of a bucket than the last.
MORE_CENTRES = 16
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; the whole text is one if it is shorter."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits as longs: each is the parity of how many of the hashes fall on it. Two sets differ in at least
    as many hashes as these differ in bits."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_reach(n: Column, bits: Column, m: Column, others: Column, percent: float) -> Column:
    """False for pairs of sets of n and m hashes whose parities show that their Jaccard similarity is under percent / 100."""
    differ = sum((F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(others, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (n + m) + F.lit(1e-6)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(one value for each band of the MinHash signature, one byte of each of its places)"""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        least = np.minimum(least, (high[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0))
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64), (least >> np.uint32(13)).astype(np.uint8).tobytes()


def _alike(threshold: float):
    """The pairs whose sketches don't rule the threshold out, of rows (a, b, own, head, sketch_a, sketch_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (4, 5))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            at = pa.array(np.flatnonzero(same >= threshold - SLACK))
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:4]], ["a", "b", "own", "head"])

    return run


def signatures(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text, key, size, fp, sketch, bands, bits): key stands for the shingle set, bits are its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps, sketches, bits, values = [], [], [], [], [], [np.zeros(0, np.uint64)]
            for t in batch.column(1):
                h = shingles(t.as_py(), shingle)
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                fps.append(majority(h))
                band, sketch = signature(h)
                values.append(band)
                sketches.append(sketch)
                bits.append(parities(h))
            lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, np.concatenate(values).view(np.int64))
            key, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps))
            columns = [batch.column(0), batch.column(1), key, pa.array(sizes, pa.int64()), fp, pa.array(sketches, pa.binary()), lists, pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "key", "size", "fp", "sketch", "bands", "bits"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, text string, key long, size long, fp long, sketch binary, bands array<long>, bits array<long>")


def _similar(threshold: float, shingle: int):
    """The pairs whose texts reach the threshold, of rows (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(x.as_py(), shingle)
                keep.append(similarity(own, shingles(y.as_py(), shingle)) >= threshold)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def reach(links: DataFrame) -> DataFrame:
    """(node, label): for each node of a link one that it reaches, the least within two steps and the same from there."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    least = both.join(least.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("label"))
    onward = least.toDF("label", "further")
    return least.join(onward, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


#: What a row of a bucket tells of its key.
NODE = ["value", "key", "size", "own", "bits"]


def _near(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """(k, a, b, value): one bucket for each set of keys that buckets hold, of rows (value, key): its k keys, the least and the greatest.
    Buckets of one key are left out."""
    told = [F.count(F.lit(1)).alias("k"), F.min("key").alias("a"), F.max("key").alias("b"), F.bit_xor(F.xxhash64("key")).alias("x")]
    buckets = rows.groupBy("value").agg(*told).where("k > 1")
    return buckets.groupBy("k", "a", "b", F.when(F.col("k") > 2, F.col("x")).alias("x")).agg(F.min("value").alias("value")).select("k", "a", "b", "value")


def pairs_of(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of keys in a bucket, repeats included, that sizes and parities allow, of rows (value, key, size, own, bits)."""
    a, b = (rows.select("value", *[F.col(k).alias(f"{k}_{c}") for k in ("key", "size", "bits")]) for c in ("a", "b"))
    met = a.join(b, "value").where((F.col("key_a") < F.col("key_b")) & _near(F.col("size_a"), F.col("size_b"), threshold))
    met = met.where(may_reach(F.col("size_a"), F.col("bits_a"), F.col("size_b"), F.col("bits_b"), 100 * threshold))
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def near_links(
    rows: DataFrame, nodes: DataFrame, texts: DataFrame, proposed: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that connect all keys that reach the threshold and share a bucket or are proposed; and what ``reach`` makes of them.

    rows: (value, key, size, own, bits), the larger buckets; own: how many bands are no other's. nodes: (key, size, own, bits, sketch).
    texts: (key, text). proposed: (a, b), the pairs of small buckets and others. First each key is compared with one other, that with the fewest
    bands of its own: what copies were made from links with more of them than one copy with others. Then the pairs that aren't connected by then
    are. Of a larger bucket's keys some centres, found likewise, are compared with all others; then they leave it. After the first round, all keys
    of a bucket that has few are centres, so this ends. Pairs whose parities rule the threshold out aren't made.
    """
    scratch, names = Scratch(rows.sparkSession, "jaccard-links"), ["first"]

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        some = among(pairs.select("a").union(pairs.select("b")))(nodes, "key")  # only what these pairs need is exchanged
        a, b = (some.select(F.col("key").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("size", "own", "bits", "sketch")]) for c in ("a", "b"))
        may = may_reach(F.col("size_a"), F.col("bits_a"), F.col("size_b"), F.col("bits_b"), 100 * threshold)
        head = F.least(F.struct(F.col("own_a").alias("own"), F.col("a").alias("head")), F.struct(F.col("own_b").alias("own"), F.col("b").alias("head")))
        told = pairs.join(a, "a").join(b, "b").where(may & _near(F.col("size_a"), F.col("size_b"), threshold))
        told = told.select("a", "b", head.alias("h"), "sketch_a", "sketch_b").select("a", "b", "h.own", "h.head", "sketch_a", "sketch_b")
        return scratch.save(told.mapInArrow(_alike(threshold), "a long, b long, own long, head long"), name)

    def similar(pairs: DataFrame, name: str) -> None:
        some = among(pairs.select("a").union(pairs.select("b")))(texts, "key")
        told = pairs.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        with batches_of(rows.sparkSession, PAIRS_AT_ONCE):
            scratch.save(told.mapInArrow(_similar(threshold, shingle), "a long, b long"), name)

    told = likely(proposed, "likely")
    other = F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    first = told.groupBy(other.alias("other")).agg(F.min(F.struct("own", "head")).alias("c"))
    first = scratch.save(first.select(F.least("other", "c.head").alias("a"), F.greatest("other", "c.head").alias("b")), "first-pairs")
    similar(first, "first")
    links = scratch.read("a long, b long", names)
    labels = scratch.save(reach(links), "labels0")
    rest = told.select("a", "b").join(first, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        rest = rest.join(labels.toDF(c, f"label_{c}"), c, "left")
    rest = rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    live, centres = rows, 1
    for i in range(64):
        live = live.join(labels, F.col("key") == F.col("node"), "left").select(*NODE, F.coalesce("label", "key").alias("root"))
        ends = live.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("many"))
        live = scratch.save(live.join(ends.where("x <> y").select("value", "many"), "value").select(*NODE, "root", "many"), f"live{i}")
        if i and live.isEmpty():
            return links, labels
        all_of = MORE_CENTRES * centres if i else 0
        slot = F.when(F.col("many") <= all_of, F.col("key")).otherwise(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(centres)))
        heads = live.groupBy("value", slot.alias("slot")).agg(F.min(F.struct("own", "key", "size", "root", "bits")).alias("c"))
        heads = scratch.save(heads.select("value", "c"), f"heads{i}")
        met = live.join(heads, "value").where((F.col("root") != F.col("c.root")) & _near(F.col("size"), F.col("c.size"), threshold))
        met = met.where(may_reach(F.col("size"), F.col("bits"), F.col("c.size"), F.col("c.bits"), 100 * threshold))
        pairs = met.select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
        pairs = likely(scratch.save(pairs, f"links{i}-pairs"), f"links{i}-likely").select("a", "b")
        similar(pairs if i else scratch.save(pairs.union(rest).distinct(), "told"), f"links{i}")
        names.append(f"links{i}")
        links = scratch.read("a long, b long", names)
        labels = scratch.save(reach(links), f"labels{i + 1}")
        live = live.join(heads.select("value", F.col("c.key").alias("key")), ["value", "key"], "left_anti").select(*NODE)
        centres *= MORE_CENTRES
    raise RuntimeError("buckets did not settle")


def near_components(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, key, component_id) for each row, as ``simhash.near_components`` but by Jaccard similarity.

    Texts without a word are equal to each other and to nothing else; one of fewer words than a shingle is a
    shingle of its own.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.save(signatures(docs, text=text, doc_id=doc_id, shingle=shingle), "signed")
    first = [F.first(c).alias(c) for c in ("size", "fp", "sketch", "bands", "bits")]
    nodes = scratch.save(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), *first), "nodes")
    rows = nodes.select("key", "size", F.explode("bands").alias("value"))
    shared = scratch.save(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"), "shared")
    may = Bloom.of(shared.select(F.xxhash64("value").alias("h"))).may_hold(docs, F.xxhash64("value"))
    rows = scratch.save(rows.where(may).distinct(), "met")  # a value that isn't shared after all is a bucket of one
    own = rows.groupBy("key").agg((F.lit(BANDS) - F.count(F.lit(1))).alias("own"))
    told = nodes.join(own, "key", "left").select("key", "size", F.coalesce("own", F.lit(BANDS)).cast("long").alias("own"), "bits", "sketch")
    told = scratch.save(told, "told")
    buckets = scratch.save(distinct_buckets(rows), "buckets")
    rows = rows.select("value", "key").join(buckets.where("k > 2").select("value", "k"), "value").join(told.drop("sketch"), "key")
    rows = scratch.save(rows.select(*NODE, "k"), "rows")
    few = buckets.where("k = 2").select("a", "b").union(pairs_of(rows.where(F.col("k") <= FEW), threshold))

    by_fp = nodes.select("fp", "key")
    heads = scratch.save(by_fp.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    edges = covering_links(heads, radius=radius)
    proposed = edges.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = by_fp.join(heads, "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    proposed = scratch.save(proposed.union(equal).union(few).distinct(), "proposed")

    rows = rows.where(F.col("k") > FEW).select(*NODE)
    keys = rows.select("key").union(proposed.select("a")).union(proposed.select("b")).distinct()
    keys = scratch.save(keys, "keys")
    may = Bloom.of(keys.select(F.xxhash64("key").alias("h"))).may_hold(docs, F.xxhash64("key"))
    texts = signed.select("key", "text").where(may).join(keys, "key", "left_semi")
    texts = scratch.save(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")  # the texts of one key have the same shingles
    links, labels = near_links(rows, told, texts, proposed, shingle=shingle, threshold=threshold)

    across = links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y").select("x", "y")
    roots = connected_components(across, a="x", b="y").toDF("label", "root")
    roots = labels.join(roots, "label", "left").select(F.col("node").alias("key"), F.coalesce("root", "label").alias("root"))
    rooted = scratch.save(nodes.select("key", "rep").join(roots, "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("key", "component_id"), "named")
    return spread_join(signed.select("doc_id", "key"), named, "key", by=["doc_id"], counts=nodes.select("key", "n")).select("doc_id", "key", "component_id")
