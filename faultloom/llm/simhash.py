"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a non-zero code of radius+1 bits; the table of mask v keeps the positions whose
code has an odd overlap with v. Any ``radius`` positions span at most ``radius`` of the radius+1
dimensions, so some non-zero v is orthogonal to all of them: in its table the pair agrees on every
kept bit and collides. No pair within the radius is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import without
from .common import Scratch, shuffle_partitions, spread_join
from .components import connected_components

BITS, RADIUS, SEED = 64, 3, 42
#: A bucket with more distinct fingerprints is split by equal blocks of the bits it leaves open.
MAX_BUCKET = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(raw)]])
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 if there are none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; codes are dealt in turn, so that each mask keeps about half the bits."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [
        sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))
    ]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints within the radius of each other."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front[-1]) <= radius
            at = front.pop()
            found = left[near]
            out += [(int(at.view(np.int64)), int(x)) for x in found.view(np.int64)]
            front += list(found)
            left = left[~near]
    return out


def _links(radius: int):
    """Edges within the runs of equal (used, value) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 3), np.int64)
        for batch in itertools.chain(batches, [None]):
            rows = tail
            if batch is not None:
                rows = np.concatenate([tail, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            if not len(rows):
                continue
            new = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            cut = [0, *new.tolist()] if batch is not None else [0, *new.tolist(), len(rows)]
            starts, ends = np.array(cut[:-1], np.int64), np.array(cut[1:], np.int64)
            tail = rows[cut[-1] :]
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                edges += _forest(rows[s:e, 2].copy(), radius)
            if edges:
                got = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return run


def _blocks(open_bits: int, n: int) -> list[int]:
    """The open bits in n masks of nearly equal size, none empty."""
    at = [i for i in range(BITS) if open_bits >> i & 1]
    return [m for k in range(n) if (m := sum(1 << i for i in at[k::n]))]


def near_links(nodes: DataFrame, *, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links that connect every pair of distinct fingerprints within the radius.

    nodes: distinct values of ``fp``. Buckets never meet a task whole when they are large: those of
    over ``max_bucket`` fingerprints are dealt anew by blocks of the bits still open, one of which a
    pair within the radius must share, until they are small or no bit is open.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "simhash-links")
    # With radius open bits or fewer a pair may differ in every block; such buckets hold 2^radius values at most.
    max_bucket = max(max_bucket, 1 << radius)
    level, ready, masks = nodes.select("fp"), [], {0: covering_masks(radius)}
    for depth in range(BITS):
        choice = F.lit(None)
        for used, more in masks.items():
            each = F.array(*[F.lit(_signed(used | m)) for m in more])
            choice = F.when(F.col("used") == F.lit(_signed(used)), each).otherwise(choice) if depth else each
        rows = level.select("fp", F.explode(choice).alias("used"))
        rows = rows.select("fp", "used", F.col("fp").bitwiseAND(F.col("used")).alias("value"))
        sizes = rows.groupBy("used", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket)
        hot = scratch.save(sizes.select("used", "value"), f"hot{depth}")
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, ["used", "value"], "left_anti").select("fp", "used", "value"))
        # A bucket whose bits are all used holds one fingerprint, so this ends.
        level = scratch.save(rows.join(hot, ["used", "value"], "left_semi").select("fp", "used").distinct(), f"level{depth}")
        masks = {u: _blocks(~u & (1 << BITS) - 1, radius + 1) for u in {u | m for u, ms in masks.items() for m in ms}}
        masks = {u: ms for u, ms in masks.items() if ms}
        kept = [r[0] & (1 << BITS) - 1 for r in level.select("used").distinct().collect()]  # as many as masks
        masks = {u: masks[u] for u in kept}
    out = None
    for rows in ready:
        dealt = rows.repartition(shuffle_partitions(spark), "used", "value").sortWithinPartitions("used", "value", "fp")
        edges = dealt.select("used", "value", "fp").mapInArrow(_links(radius), "a long, b long")
        out = edges if out is None else out.union(edges)
    return out


def near_components(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fp, component_id) for each row.

    Links join fingerprints at ``radius`` or fewer differing bits; equal fingerprints are one node, so
    copies are never paired. component_id is the smallest document id reachable, the document's own
    included. Null and empty texts have fingerprint 0, which links like any other. A null id never
    becomes a component id unless its component has no other. Repeated rows get a row each; texts are read
    whole. docs' other columns aren't carried, so none can clash; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle), "fps")
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    links = near_links(nodes, radius=radius)
    roots = scratch.save(connected_components(links).toDF("fp", "root"), "roots")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    return spread_join(fps, named, "fp", by=["doc_id"], counts=nodes.select("fp", "n")).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, ids: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component of ids (doc_id, component_id): that of its smallest document id, or
    all rows with that id (repeated rows are one document). Rows without an id stay if their component has none."""
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = ids.groupBy("doc_id").agg(first.alias("first")).where("not first").select("doc_id")
    return without(docs, gone, F.col(doc_id).cast("long"))


def near_dedup(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = RADIUS, similarity: float | None = None
) -> DataFrame:
    """docs with one document of each component, see ``representatives``.

    With ``similarity``, links join texts of that Jaccard similarity of word shingles instead, see
    ``jaccard.near_components``: covering tables propose pairs there, an exact check decides.
    """
    if similarity is None:
        ids = near_components(docs, text=text, doc_id=doc_id, shingle=shingle, radius=radius)
    else:
        from . import jaccard

        ids = jaccard.near_components(docs, text=text, doc_id=doc_id, shingle=shingle, threshold=similarity, radius=radius)
    return representatives(docs, ids, doc_id=doc_id)
