"""Media columns: content-addressed payloads in tar shards of the shared folder.

Each distinct payload of a table is put once into a tar shard, named by its SHA-256; rows carry digest, shard,
offset and length. Metadata columns come from range reads of the stored header only; features come from
reading a payload back. The stored form is an 8-bit grey PNG, 64 samples wide.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import Scratch, spread_join

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # the signature and the IHDR chunk
SHARD_BYTES = 256 << 20
LEVEL = 6


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes, level: int = LEVEL) -> bytes:
    """An 8-bit grey image of 64 samples a row; row filter 0, so that any reader gets the bytes back."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) of the first HEADER_BYTES of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def png_decode(data: bytes) -> bytes:
    """The samples of an image made by ``png_encode``."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only row filter 0 is written here")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation, entropy of the samples and the mean step from one to the next."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float((share * level).sum())
    deviation = float(np.sqrt((share * (level - mean) ** 2).sum()))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"mean={mean:.6f};sd={deviation:.6f};entropy={entropy:.6f};step={step:.6f}"


def _member(name: str, data: bytes) -> bytes:
    """A whole ustar member: header, data, zero bytes up to a multiple of 512."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % 512)


class ShardWriter:
    """Tar shards under ``root``; a name is new for each attempt, so that a task that runs again
    leaves at worst a shard to which no row refers."""

    def __init__(self, root: str) -> None:
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.files.create_dir(self.root, recursive=True)
        self.out, self.at, self.name = None, 0, ""

    def put(self, name: str, data: bytes) -> tuple[str, int]:
        """(shard, offset of the data)"""
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out, self.at = self.files.open_output_stream(f"{self.root}/{self.name}"), 0
        member = _member(name, data)
        self.out.write(member)
        start = self.at + 512
        self.at += len(member)
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def payload_of(text):
    """The UTF-8 bytes of a text column (a null is empty) with zero bytes up to a positive multiple of 64."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(F.ceil(n / WIDTH), F.lit(1)).cast("int") * WIDTH - n))
    return F.concat(data, zeros)


def digest_of(payload):
    return F.unhex(F.sha2(payload, 256))


STORED = "digest binary, shard string, offset long, length long"


def store(payloads: DataFrame, root: str) -> DataFrame:
    """Write payloads to tar shards under root. payloads: (digest, payload), each digest once; a digest is 32 bytes.

    Lazy: a caller writes the result, so that rows and shards stem from the same attempts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(root)
        for batch in batches:
            rows = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = png_encode(payload.as_py())
                rows.append((digest, *writer.put(f"{digest.hex()}.png", media), len(media)))
            yield _batch(rows, STORED)
        writer.close()

    return payloads.select("digest", "payload").mapInArrow(run, STORED)


def store_distinct(docs: DataFrame, digests: DataFrame, root: str, *, text: str = "text") -> DataFrame:
    """Store every distinct payload of docs once. digests: (digest, n), how many rows have each.

    Payloads of a single row are written where they are read. Only those that a Bloom filter of the repeated
    digests lets through are exchanged, after each task has kept one of its copies.
    """
    payload = payload_of(F.col(text))
    rows = docs.select(payload.alias("payload")).select(digest_of(F.col("payload")).alias("digest"), "payload")
    repeated = Bloom.of(digests.where("n > 1").select(F.xxhash64("digest").alias("h")))
    may_repeat = repeated.may_hold(docs, F.xxhash64("digest"))
    once = rows.where(may_repeat).groupBy("digest").agg(F.first("payload").alias("payload"))
    return store(rows.where(~may_repeat), root).union(store(once, root))


META = "width int, height int, bits int"
READ = (
    f"{STORED}, {META}, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kind = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _visit(index: DataFrame, root: str, schema: str, read) -> DataFrame:
    """One row of read(source, row) for each row of the index; a shard stays open while its rows last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["shard"], files.open_input_file(f"{base}/{row['shard']}")
                rows.append(read(source, row))
            yield _batch(rows, schema)

    return index.select("digest", "shard", "offset", "length").mapInArrow(run, schema)


def headers(index: DataFrame, root: str) -> DataFrame:
    """(digest, width, height, bits) by range reads of the headers alone: a payload's other bytes aren't read."""
    return _visit(index, root, f"digest binary, {META}", lambda source, row: (row["digest"], *png_header(source.read_at(HEADER_BYTES, row["offset"]))))


def read_back(index: DataFrame, root: str) -> DataFrame:
    """The index with the metadata and features of the stored payloads, each checked against its digest."""

    def read(source, row: dict) -> tuple:
        head = png_header(source.read_at(HEADER_BYTES, row["offset"]))
        media = source.read_at(row["length"], row["offset"])
        payload = png_decode(media)
        sha = hashlib.sha256(payload).digest()
        if sha != row["digest"]:
            raise ValueError(f"{row['shard']} at {row['offset']} doesn't hold {row['digest'].hex()}")
        own = (len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).digest(), features(payload))
        return (row["digest"], row["shard"], row["offset"], row["length"], *head, *own)

    return _visit(index, root, READ, read)


def media_columns(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Store all texts, read them back, and return each row with what was stored.

    Columns: doc_id, n_bytes, shard, offset, length, width, height, bits and those of the payload; docs' other
    columns aren't carried, so none can clash. Texts are stored whole; a null or empty one is 64 zero bytes.
    Each digest is stored and read once, so rows of equal texts get equal values, shard and offset included;
    repeated rows and null ids get a row each. No rows give no shard. A digest that many rows share is joined
    in several tasks.
    """
    scratch = Scratch(docs.sparkSession, "media")
    root = scratch.path("shards")
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), digest_of(payload_of(F.col(text))).alias("digest"))
    rows = scratch.save(rows, "rows")
    digests = scratch.save(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digests")
    index = scratch.save(store_distinct(docs, digests, root, text=text), "index")
    dealt = scratch.save(index.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), "dealt")
    scratch.drop("index")
    read = scratch.save(read_back(dealt, root), "read")
    scratch.drop("dealt")
    out = spread_join(rows, read, "digest", by=["doc_id", "n_bytes"], counts=digests)
    hashes = [F.lower(F.hex(c)).alias(c) for c in ("digest", "payload_sha256", "media_sha256")]
    return out.select(*hashes, *[c for c in out.columns if c not in ("digest", "payload_sha256", "media_sha256")])
