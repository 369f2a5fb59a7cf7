"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have a global order, rare ones first. It is cut into fragments, and so is each document's set: pairs
are counted fragment by fragment (partial overlaps), and the sum of a pair's counts decides; pairs whose sizes in the fragments or
parities leave the threshold out of reach aren't counted. Only pairs that share one of
their rarest n-grams can reach the threshold (prefixes); such buckets propose pairs. Equal sets are one node, so copies are
never paired, and buckets of the same nodes are one bucket. A small one proposes the pairs of its nodes; in a larger one some centres are
compared with the rest, and what is linked by then isn't compared again. Large buckets with many unlinked nodes are split by a second shared n-gram, which a
pair above the threshold must have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, among, without
from .common import ROWS_AT_ONCE, Scratch, batches_of, shuffle_partitions, spread_join
from .components import connected_components
from .jaccard import may_reach, parities, reach

WORDS, PERCENT, FRAGMENTS = 4, 85, 4
#: The order goes by the number of n-grams in each of so many hash buckets, counted over all documents; 5 bytes each for a task.
ORDER_BITS, BLOCK = 21, 1 << 14
#: A bucket with more unlinked nodes is split, so many times at most.
MAX_BUCKET, SPLITS, MORE_CENTRES = 4096, 2, 4
#: In buckets of so many nodes at most, all pairs are looked at.
FEW = 16


#: Sets of so many n-grams, whose parities tell little, have their n-grams counted in so many hash buckets.
LONG_SET, COUNTS = 600, 256
#: Texts whose words are told apart at once.
TEXTS_AT_ONCE = 256
#: Longer words, in bytes, are hashed one at a time.
LONG_WORD = 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8, eight bytes at a time for all of them."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    at = np.frombuffer(words.buffers()[1] or bytes(8), kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = (raw.to_pybytes() if raw else b"") + bytes(8)
    eights = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    at, left = at[:-1], np.diff(at)
    out = _mixed(left.astype(np.uint64) * _MIX[0])
    todo = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    for i in range(0, LONG_WORD, 8):
        todo = todo[left[todo] > i]
        unused = np.uint64(64) - np.minimum(left[todo] - i, 8).astype(np.uint64) * np.uint64(8)
        out[todo] = _mixed(out[todo] * _MIX[0] + (eights[at[todo] + i] << unused))
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + left[i]], 42)
    return out


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k of these word hashes; one of all if there are fewer."""
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n if k else 0, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX[0] + words[i : i + n])
    return out


def ngrams(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text a 64-bit hash for each run of k words, repeats included; one of all words if there are fewer. A-Z are lower-cased."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, TEXTS_AT_ONCE).fill_null("")))
        found, ends = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        words = word_hashes(found)
        full = pc.binary_length(found).to_numpy() > 0  # what lies beyond white space at an end of a text is empty
        if not full.all():
            words, ends = words[full], np.concatenate([[0], np.cumsum(full)])[ends]
        runs = _combined(words, k) if len(words) >= k else words
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield runs[start : end - k + 1] if end - start >= k else _combined(words[start:end], k)


def order_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _counted(words: int):
    """(block, counts): how many n-grams each hash bucket gets, in blocks of BLOCK buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for h in ngrams(batch.column(0), words):
                np.add.at(counts, order_bucket(h), 1)
        blocks = counts.reshape(-1, BLOCK)
        kind = np.min_scalar_type(int(counts.max()))
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            row = [pa.array([i]), pa.array([kind.itemsize]), pa.array([blocks[i].astype(kind).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["block", "bytes", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(raw, f"u{size}").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


class Order:
    """The global order of n-grams, by (rank of the hash bucket, hash), and its cut into fragments of equal weight."""

    def __init__(self, counts: np.ndarray, fragments: int) -> None:
        by = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), np.int32)
        self.rank[by] = np.arange(len(counts), dtype=np.int32)
        upto = np.cumsum(counts[by])
        self.fragment = np.empty(len(counts), np.uint8)
        self.fragment[by] = np.minimum(fragments - 1, (upto - counts[by]) * fragments // max(1, upto[-1])).astype(np.uint8)

    @classmethod
    def of(cls, docs: DataFrame, text: str, words: int, fragments: int) -> Order:
        """The driver gets the 2^ORDER_BITS counts."""
        found = docs.select(F.col(text).cast("string")).mapInArrow(_counted(words), "block long, bytes long, counts binary")
        n = min(shuffle_partitions(docs.sparkSession), (1 << ORDER_BITS) // BLOCK)
        with batches_of(docs.sparkSession, ROWS_AT_ONCE):
            total = found.repartition(n, "block").mapInArrow(_summed, "block long, counts binary").toArrow()
        counts = np.zeros(((1 << ORDER_BITS) // BLOCK, BLOCK), np.int64)
        for block, raw in zip(total["block"].to_pylist(), total["counts"].to_pylist(), strict=True):
            counts[block] += np.frombuffer(raw, np.int64)
        return cls(counts.reshape(-1), fragments)

    def first(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The n rarest, in order."""
        rank = self.rank[order_bucket(hashes)]
        if n < len(hashes):
            some = np.flatnonzero(rank <= np.partition(rank, n - 1)[n - 1])
            hashes, rank = hashes[some], rank[some]
        return hashes[np.lexsort((hashes, rank))[:n]]


def _least(n: int, percent: int) -> tuple[int, int]:
    """How many of the n rarest n-grams a set shows to longer ones, and to shorter ones.

    An intersection of i fulfils (100 + percent) i >= percent (n + m). With m >= n it has 2 percent n / (100 + percent) at
    least; with m < n, where m is percent / 100 of n at least, percent n / 100.
    """
    return n + 1 + -2 * percent * n // (100 + percent), n + 1 + -percent * n // 100


def hash_counts(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each of COUNTS buckets, modulo 256."""
    return np.bincount(((hashes >> np.uint64(8)) & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS).astype(np.uint8).tobytes()


def counts_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, need, own, head) of the pairs whose counts don't rule out that need hashes are common, of rows (a, b, need, own, head, both sizes' sum,
    counts_a, counts_b).

    Two sets differ in at least as many hashes as their counts do, and counts at least by what they differ modulo 256. Pairs without counts stay.
    """
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        told = np.flatnonzero(pc.and_(batch.column(6).is_valid(), batch.column(7).is_valid()).to_numpy(zero_copy_only=False))
        x, y = (np.frombuffer(b"".join(batch.column(i).take(pa.array(told)).to_pylist()), np.uint8).reshape(-1, COUNTS) for i in (6, 7))
        differ = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64)
        need, total = (batch.column(i).to_numpy()[told] for i in (2, 5))
        keep[told] = total - differ >= 2 * need
        yield pa.RecordBatch.from_arrays([c.take(pa.array(np.flatnonzero(keep))) for c in batch.columns[:5]], ["a", "b", "need", "own", "head"])


def signed(docs: DataFrame, order, *, text: str, doc_id: str, words: int, percent: int, fragments: int) -> DataFrame:
    """(uid, doc_id, text, key, n, index, probe, rarest, sizes, bits, counts): key stands for the set; rarest has ``probe`` n-grams and SPLITS more;
    sizes are the set's n-grams in each fragment; bits are its parities; counts are null but for long sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ns, index, probe, rarest, sizes, bits, counts = [], [], [], [], [], [], [], []
            for h in map(np.unique, ngrams(batch.column(2), words)):
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                ns.append(len(h))
                i, p = _least(len(h), percent) if len(h) else (0, 0)
                index.append(i)
                probe.append(p)
                rarest.append(order.value.first(h, p + SPLITS).view(np.int64) if len(h) else [])
                sizes.append(np.bincount(order.value.fragment[order_bucket(h)], minlength=fragments).astype(np.int32))
                bits.append(parities(h))
                counts.append(hash_counts(h) if len(h) >= LONG_SET else None)
            numbers = [pa.array(x, pa.int64()) for x in (ns, index, probe)]
            columns = [*batch.columns, pa.array(keys, pa.binary()), *numbers, pa.array(rarest, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "text", "key", "n", "index", "probe", "rarest", "sizes", "bits", "counts"])

    picked = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "uid long, doc_id long, text string, key binary, n long, index long, probe long, rarest array<long>, sizes array<int>, bits array<long>, counts binary")


def _cut(order, words: int, fragments: int):
    """A row for each of the fragments that a text has n-grams of, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at, parts = [], [], []
            for node, h in zip(batch.column(0).to_pylist(), map(np.unique, ngrams(batch.column(1), words)), strict=True):
                own = order.value.fragment[order_bucket(h)]
                for f in range(fragments):
                    if len(part := h[own == f]):
                        nodes.append(node)
                        at.append(f)
                        parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(at, pa.int32()), pa.array(parts, pa.binary())], ["node", "fragment", "part"])

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of two segments of a fragment, of rows (a, b, need, x, y)."""
    for batch in batches:
        parts = (map(lambda x: np.frombuffer(x, np.uint64), batch.column(i).to_pylist()) for i in (3, 4))
        n = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["a", "b", "need", "overlap"])


class Segments:
    """The sets of the nodes, fragment by fragment, cut from the texts of the nodes whose pairs need them.

    nodes: (node, n, own, sizes, bits, counts).
    """

    def __init__(self, scratch: Scratch, sets: DataFrame, nodes: DataFrame, order, words: int, fragments: int, percent: int) -> None:
        self.scratch, self.sets, self.nodes, self.order, self.words, self.fragments, self.percent = scratch, sets, nodes, order, words, fragments, percent

    def of(self, wanted: DataFrame, name: str) -> DataFrame:
        """wanted: (node); segments of a few others do no harm."""
        texts = among(wanted)(self.sets.select(F.col("uid").alias("node"), "text"), "node")
        return self.scratch.save(texts.mapInArrow(_cut(self.order, self.words, self.fragments), "node long, fragment int, part binary"), name)

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, need, own, head) of the pairs of which sizes, parities and counts don't rule the threshold out: n-grams that both must have; which
        of them has fewer n-grams of its own, and how many."""
        nodes = among(pairs.select("a").union(pairs.select("b")))(self.nodes, "node")  # only what these pairs need is exchanged
        a, b = (nodes.select(F.col("node").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "own", "sizes", "bits", "counts")]) for c in ("a", "b"))
        need = F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / F.lit(100.0 + self.percent) - F.lit(1e-6))
        most = sum((F.least(F.get("sizes_a", F.lit(i)), F.get("sizes_b", F.lit(i))) for i in range(self.fragments)), F.lit(0))
        may = may_reach(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), self.percent)
        head = F.least(F.struct(F.col("own_a").alias("own"), F.col("a").alias("head")), F.struct(F.col("own_b").alias("own"), F.col("b").alias("head")))
        told = pairs.select("a", "b").distinct().join(a, "a").join(b, "b").where(may & (most >= need))
        told = told.select("a", "b", need.alias("need"), head.alias("h"), (F.col("n_a") + F.col("n_b")).alias("total"), "counts_a", "counts_b")
        told = told.select("a", "b", "need", "h.own", "h.head", "total", "counts_a", "counts_b")
        return self.scratch.save(told.mapInArrow(counts_allow, "a long, b long, need long, own long, head long"), name)

    def overlapping(self, told: DataFrame, name: str) -> DataFrame:
        """(a, b) of the pairs (a, b, need), each there once, that reach the threshold: partial overlaps of each fragment, summed for each pair."""
        parts = self.of(told.select(F.col("a").alias("node")).union(told.select("b")), f"{name}-segments")
        x, y = (parts.select(F.col("node").alias(c), "fragment", F.col("part").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        met = told.select("a", "b", "need").join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "need", "x", "y")
        sums = met.mapInArrow(_partial, "a long, b long, need long, overlap long").groupBy("a", "b", "need").agg(F.sum("overlap").alias("overlap"))
        found = self.scratch.save(sums.where("overlap >= need").select("a", "b"), name)
        self.scratch.drop(f"{name}-segments")
        return found


#: What a row of a bucket tells of its node: n-grams, those of its first ones that no other node has there, and parities.
NODE = ["node", "n", "own", "bits"]


def _near(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _split(hot: DataFrame, rarest: DataFrame, level: int) -> DataFrame:
    """Rows of hot buckets dealt anew by a further n-gram of each node. Two sets above the threshold share one n-gram more
    in prefixes longer by one."""
    more = hot.join(rarest.select("node", "index", "probe", "rarest"), "node").select("value", *NODE, "shows", "index", "probe", F.posexplode("rarest").alias("at", "gram"))
    more = more.where((F.col("at") < F.col("probe") + level) & (F.col("gram") != F.col("value")))
    shows = F.col("shows") & (F.col("at") < F.col("index") + level)
    return more.select(F.xxhash64("value", "gram").alias("value"), *NODE, shows.alias("shows")).distinct()


def _open(live: DataFrame) -> DataFrame:
    """(value, roots): buckets that hold several roots, and a node that shows itself to longer ones."""
    ends = live.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bool_or("shows").alias("s"), F.count_if("shows").alias("size"))
    return ends.where(F.col("s") & (F.col("x") != F.col("y"))).select("value", "size")


def _met(shared):
    """For each node with prefix n-grams that ``shared`` may hold: (node, n, own, shown, sizes, bits, counts, values), of rows (node, n, index,
    probe, sizes, bits, counts, rarest). own: how many of its prefix are no other's; values: the rest, of which it shows the first ``shown`` to longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bloom(shared.value)
        for batch in batches:
            index, probe = (batch.column(i).to_numpy() for i in (2, 3))
            count, grams = pc.list_value_length(batch.column(7)).to_numpy(), batch.column(7).flatten().to_numpy()
            of = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(grams)) - np.repeat(np.cumsum(count) - count, count)
            keep = np.flatnonzero(at < probe[of])
            keep = keep[may.holds(grams[keep])]
            kept, shown = np.bincount(of[keep], minlength=len(count)), np.bincount(of[keep[at[keep] < index[of[keep]]]], minlength=len(count))
            some = np.flatnonzero(kept)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept[some])]), pa.int32()), pa.array(grams[keep], pa.int64()))
            node, n, sizes, bits, counts = (batch.column(i).take(pa.array(some)) for i in (0, 1, 4, 5, 6))
            columns = [node, n, pa.array((probe - kept)[some], pa.int64()), pa.array(shown[some], pa.int64()), sizes, bits, counts, values]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "own", "shown", "sizes", "bits", "counts", "values"])

    return run


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """(k, a, b, value): one bucket for each set of nodes that buckets hold, of rows (value, node, shows): its k nodes, the least and the
    greatest. Buckets in which no node shows itself, or one is alone, are left out."""
    told = [F.count(F.lit(1)).alias("k"), F.min("node").alias("a"), F.max("node").alias("b"), F.bool_or("shows").alias("s")]
    told.append(F.bit_xor(F.xxhash64("node", "shows")).alias("x"))  # stands for the nodes
    buckets = rows.groupBy("value").agg(*told).where("k > 1 and s")
    return buckets.groupBy("k", "a", "b", F.when(F.col("k") > 2, F.col("x")).alias("x")).agg(F.min("value").alias("value")).select("k", "a", "b", "value")


def pairs_of(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes in a bucket, repeats included, that sizes and parities allow."""
    a, b = (rows.select("value", *[F.col(k).alias(f"{k}_{c}") for k in (*NODE, "shows")]) for c in ("a", "b"))
    met = a.join(b, "value").where((F.col("node_a") < F.col("node_b")) & (F.col("shows_a") | F.col("shows_b")) & _near(F.col("n_a"), F.col("n_b"), percent))
    met = met.where(may_reach(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), percent))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def set_links(
    rows: DataFrame, proposed: DataFrame, rarest: DataFrame, segments: Segments, *, percent: int = PERCENT, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """(a, b): links that connect all nodes whose sets reach the threshold.

    proposed: (a, b), the pairs of small buckets. First each node is compared with one other, that with the fewest n-grams of its own: what
    copies were made from links with more of them than one copy with others. Then the pairs that aren't connected by then are.
    rows: (value, node, n, own, bits, shows), the larger buckets of first n-grams. Of a bucket's nodes some centres, found likewise, are compared with
    all others; then they leave it. After the first round, all nodes of a bucket that has few are centres. Pairs whose
    parities rule the threshold out aren't made. A bucket is done when all its nodes are linked or none is left that shows itself.
    """
    scratch, names = Scratch(rows.sparkSession, "set-links"), ["first"]
    told = segments.likely(proposed, "likely")
    other = F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    first = told.groupBy(other.alias("other")).agg(F.min(F.struct("own", "head", "need")).alias("c"))
    first = scratch.save(first.select(F.least("other", "c.head").alias("a"), F.greatest("other", "c.head").alias("b"), "c.need"), "first")
    labels = scratch.save(reach(segments.overlapping(first, "first")), "labels0")
    rest = told.join(first, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        rest = rest.join(labels.toDF(c, f"label_{c}"), c, "left")
    rest = rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "need")
    live, centres, level = rows, 1, 0
    for i in range(64):
        if i:
            links = segments.scratch.read("a long, b long", names)
            labels = scratch.save(reach(links), f"labels{i}")
        live = live.join(labels, "node", "left").select("value", *NODE, "shows", F.coalesce("label", "node").alias("root"))
        told = scratch.save(_open(live), f"open{i}")
        live = among(told.select("value"))(live, "value").join(told, "value").select("value", *NODE, "shows", "root", "size")
        live = scratch.save(live, f"live{i}")
        n, large = live.agg(F.count(F.lit(1)), F.count_if(F.col("size") > max_bucket)).first()
        if i and not n:
            return links
        if i and level < SPLITS and large:
            level += 1
            split = scratch.save(_split(live.where(F.col("size") > max_bucket), rarest, level), f"split{i}")
            live = live.where(F.col("size") <= max_bucket).select("value", *NODE, "shows").union(split)
            continue
        all_of = 0 if i == 0 else MORE_CENTRES * centres
        slot = F.when(F.col("size") <= all_of, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(centres)))
        heads = live.where("shows").groupBy("value", slot.alias("slot")).agg(F.min(F.struct("own", "node", "n", "root", "bits")).alias("c"))
        heads = scratch.save(heads.select("value", "c"), f"heads{i}")
        met = live.join(heads, "value").where((F.col("root") != F.col("c.root")) & (F.col("node") != F.col("c.node")))
        met = met.where(_near(F.col("n"), F.col("c.n"), percent) & (F.col("shows") | (F.col("n") >= F.col("c.n"))))
        met = met.where(may_reach(F.col("n"), F.col("bits"), F.col("c.n"), F.col("c.bits"), percent))
        pairs = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
        pairs = scratch.save(pairs.distinct(), f"pairs{i}")
        told = segments.likely(pairs, f"likely{i}").select("a", "b", "need")
        segments.overlapping(told if i else scratch.save(told.union(rest).distinct(), "told"), f"links{i}")
        names.append(f"links{i}")
        live = live.join(heads.select("value", F.col("c.node").alias("node")), ["value", "node"], "left_anti").select("value", *NODE, "shows")
        centres *= MORE_CENTRES
    raise RuntimeError("buckets did not settle")


def jaccard_components(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Links join sets with 100 * intersection >= percent * union; component_id is the smallest document id reachable, its own
    included. A text of fewer words than an n-gram is one n-gram; null texts and texts without a word have an empty set, link with nothing
    and are their own component. Repeated rows get a row each; a null id never becomes a component id unless its component has no
    other. Texts are read whole; docs' other columns aren't carried, so none can clash; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    order = spark.sparkContext.broadcast(Order.of(docs, text, words, fragments))
    sets = scratch.save(signed(docs, order, text=text, doc_id=doc_id, words=words, percent=percent, fragments=fragments), "sets")
    some = sets.where("n > 0")
    nodes = some.groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    nodes = scratch.save(nodes, "nodes")
    repeated = nodes.where("rows > 1").select("key", "node")
    copies = some.select("uid", "key").join(repeated, "key").where("uid <> node").select("uid")
    rarest = without(some.select("uid", "n", "index", "probe", "sizes", "bits", "counts", "rarest"), copies, F.col("uid")).withColumnRenamed("uid", "node")
    grams = rarest.select("index", "probe", F.posexplode("rarest").alias("at", "value")).where("at < probe")
    shared = grams.groupBy("value").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("at") < F.col("index")).alias("s")).where("k > 1 and s")
    shared = scratch.save(shared.select("value"), "shared")
    may = spark.sparkContext.broadcast(Bloom.of(shared).words)  # values are hashes
    schema = "node long, n long, own long, shown long, sizes array<int>, bits array<long>, counts binary, values array<long>"
    met = scratch.save(rarest.mapInArrow(_met(may), schema), "met")
    rows = met.select("node", "shown", F.posexplode("values").alias("at", "value")).select("value", "node", (F.col("at") < F.col("shown")).alias("shows"))
    buckets = scratch.save(distinct_buckets(rows), "buckets")
    few, rows = (
        scratch.save(among(buckets.where(which).select("value"))(rows, "value").join(met.select(*NODE), "node").select("value", *NODE, "shows"), name)
        for which, name in ((f"k > 2 and k <= {FEW}", "few"), (f"k > {FEW}", "rows"))
    )
    proposed = scratch.save(buckets.where("k = 2").select("a", "b").union(pairs_of(few, percent)).distinct(), "proposed")
    segments = Segments(scratch, some, met.select("node", "n", "own", "sizes", "bits", "counts"), order, words, fragments, percent)
    links = set_links(rows, proposed, rarest, segments, percent=percent, max_bucket=max_bucket)
    order.destroy()  # all that needs it is written
    roots = scratch.save(connected_components(links, a="a", b="b"), "roots")
    rooted = nodes.select("key", "node", "rep").join(roots, "node", "left").select("key", "rep", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("key", "component_id"), "named")
    told = spread_join(some.select("doc_id", "n", "key"), named, "key", by=["doc_id"], counts=nodes.select("key", F.col("rows").alias("n")))
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return told.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")
