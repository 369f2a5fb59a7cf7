"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

The network predicts every token from the tokens on both sides of it, which alone enter: a hidden layer
sums one embedding for each place of the window; the token's class and the token within its class are
softmax layers over it. The most frequent words are tokens of their own; all others share RARE tokens by
their last two bytes, and within such a token each word has its share of the token's corpus count. Those
counts cover every word of all documents, so what the model holds grows with the corpus: it is a table in
the shared folder, of which a task reads only the words of the file whose texts it scores.

Every task trains on all positions of its documents, from the same start; parameters are averaged in a
tree, weighted by tokens. The network therefore depends on how documents are dealt to files.
"""

from __future__ import annotations

import io
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, top_rows

CLASS_SIZE, CLASSES = 32, 32
TOKENS = CLASS_SIZE * CLASSES
#: Tokens that stand for all rarer words, by a hash of the word's last two bytes.
RARE = 64
FIRST_RARE = TOKENS - RARE
PAD = TOKENS
HIDDEN = 24
OFFSETS = (-2, -1, 1, 2)
BATCH, RATE = 4096, 2.0
#: How much larger the steps of embeddings and of within-class weights are than those of dense parameters.
SPARSE = 20.0
SLICE = 1 << 13
#: Logits of less than this can't overflow; the least share of a class or token that a log is taken of.
SAFE, LEAST = 80.0, np.float32(1e-37)
FAN_IN = 32
SEED = 42
#: Words that a task counts before it sends them on.
HELD_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    """ASCII white space parts words; A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def rare_token(word: Column) -> Column:
    return F.lit(FIRST_RARE) + F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(RARE))


class TokenOf(dict):
    """Tokens by word; those of rare words are told when first asked for and remembered, as many as fit."""

    def __init__(self, own: dict[bytes, int]) -> None:
        super().__init__(own)
        self.own = own

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
            self.update(self.own)
        self[word] = token = FIRST_RARE + zlib.crc32(word[-2:]) % RARE
        return token


class Vocabulary:
    """Tokens of words, and which words of a text are rare."""

    def __init__(self, words: list[bytes]) -> None:
        self.id_of = TokenOf({w: i for i, w in enumerate(words)})

    def _tokens(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.id_of.__getitem__, words), np.int16, len(words))

    def ids(self, text: str | None) -> np.ndarray:
        return self._tokens(words_of(text))

    def read(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        words = words_of(text)
        out = self._tokens(words)
        return out, list(itertools.compress(words, (out >= FIRST_RARE).tolist()))


class WindowNetwork:
    """Parameters and the forward and backward steps."""

    NAMES = ("embed", "hidden_bias", "class_w", "class_b", "token_w", "token_b")

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 0) -> WindowNetwork:
        """Small random weights; the biases already give the corpus frequencies."""
        rng = np.random.default_rng(seed)
        share = (counts + 1.0).reshape(CLASSES, CLASS_SIZE)
        by_class = share.sum(axis=1)
        p = {
            "embed": rng.normal(0, 0.3, (len(OFFSETS), TOKENS + 1, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "class_w": rng.normal(0, 0.05, (HIDDEN, CLASSES)),
            "class_b": np.log(by_class / by_class.sum()),
            "token_w": rng.normal(0, 0.05, (CLASSES, HIDDEN, CLASS_SIZE)),
            "token_b": np.log(share / by_class[:, None]),
        }
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def hidden(self, window: np.ndarray) -> np.ndarray:
        z = np.take(self.p["embed"][0], window[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            z += np.take(self.p["embed"][k], window[:, k], axis=0)
        z += self.p["hidden_bias"]
        return np.tanh(z, out=z)

    @staticmethod
    def _exponentials(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """exp of logits, in place; lowered by each row's largest first, unless no logit of these weights can overflow."""
        if not float((np.abs(w).sum(axis=0) + np.abs(b)).max()) < SAFE:
            z -= z.max(axis=1, keepdims=True)
        return np.exp(z, out=z)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of targets in the order of their classes, and where each class ends."""
        c = (target // CLASS_SIZE).astype(np.uint8)
        return np.argsort(c, kind="stable"), np.cumsum(np.bincount(c, minlength=CLASSES))  # 8-bit numbers: a radix sort

    def log_probabilities(self, window: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, ends = self._by_class(target)
        h, target = self.hidden(np.take(window.T, order, axis=1).T), target[order]
        c, t = target // CLASS_SIZE, target % CLASS_SIZE
        ones, rows = np.ones(CLASS_SIZE, np.float32), np.arange(len(target))
        z = self._exponentials(h @ self.p["class_w"] + self.p["class_b"], self.p["class_w"], self.p["class_b"])
        share = z[rows, c] / (z @ np.ones(CLASSES, np.float32))
        inner = np.empty_like(share)
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if hi > lo:
                w, b = self.p["token_w"][k], self.p["token_b"][k]
                z = self._exponentials(h[lo:hi] @ w + b, w, b)
                inner[lo:hi] = z[rows[: hi - lo], t[lo:hi]] / (z @ ones)
        out = np.empty_like(share)
        out[order] = np.log(np.maximum(share, LEAST)) + np.log(np.maximum(inner, LEAST))
        return out

    def step(self, window: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability."""
        p, n = self.p, len(target)
        order, ends = self._by_class(target)
        window, target = np.take(window.T, order, axis=1).T, target[order]
        h = self.hidden(window)
        c, t = target // CLASS_SIZE, target % CLASS_SIZE
        ones, rows = np.ones(n, np.float32), np.arange(n)
        d = self._exponentials(h @ p["class_w"] + p["class_b"], p["class_w"], p["class_b"])
        d *= (-1 / (d @ ones[:1].repeat(CLASSES)))[:, None]
        d[rows, c] += 1
        back = d @ p["class_w"].T
        class_w, class_b = h.T @ d, ones @ d
        scale = np.float32(rate / n)
        wide = ones[:1].repeat(CLASS_SIZE)
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if hi > lo:
                w, b, hk = p["token_w"][k], p["token_b"][k], h[lo:hi]
                dk = self._exponentials(hk @ w + b, w, b)
                dk *= (-1 / (dk @ wide))[:, None]
                dk[rows[: hi - lo], t[lo:hi]] += 1
                back[lo:hi] += dk @ w.T
                w += scale * SPARSE / 2 * (hk.T @ dk)
                b += scale * (ones[: hi - lo] @ dk)
        p["class_w"] += scale * class_w
        p["class_b"] += scale * class_b
        h *= h
        np.subtract(scale, np.multiply(h, scale, out=h), out=h)
        back *= h
        p["hidden_bias"] += ones @ back
        back *= SPARSE  # a row of an embedding is seen by a small part of a batch
        for k in range(len(OFFSETS)):
            rows = np.argsort(window[:, k], kind="stable")  # 16-bit numbers: a radix sort
            ids = window[rows, k]
            first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            p["embed"][k][ids[first]] += np.add.reduceat(np.take(back, rows, axis=0), first, axis=0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> WindowNetwork:
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k].copy() for k in cls.NAMES})


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array with padding between documents, and the place of each document's first."""
    gap = np.full(2, PAD, np.int16)
    parts, starts, at = [gap], [], 2
    for ids in docs:
        starts.append(at)
        parts += [ids, gap]
        at += len(ids) + 2
    return np.concatenate(parts), np.array(starts, np.int64)


def windows(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(place, offset): ids around each place, held offset by offset."""
    return np.stack([np.take(stream, at + o) for o in OFFSETS]).T


@dataclass
class Texts:
    """Documents in files of the shared folder: rows of (doc_id, text, file), file being a hash of the file's name."""

    table: DataFrame
    scratch: Scratch

    @classmethod
    def of(cls, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> Texts:
        scratch = Scratch(docs.sparkSession, "lm")
        held = scratch.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "texts")
        return cls(held.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file")), scratch)


def count_words(texts: Texts) -> DataFrame:
    """(file, word, n, total): how often a file has each of its words, and how often all files have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = Counter(), None

        def out() -> pa.RecordBatch:
            columns = [pa.array([own] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["file", "word", "n"])

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (file != own or len(held) > HELD_WORDS):
                    yield out()
                    held.clear()
                own = file
                held.update(words_of(text.as_py()))
        if held:
            yield out()

    some = texts.table.select("file", "text").mapInArrow(run, "file long, word binary, n long").repartition("word")
    some = some.groupBy("file", "word").agg(F.sum("n").alias("n"))  # dealt by word already, as the window is
    return texts.scratch.save(some.withColumn("total", F.sum("n").over(Window.partitionBy("word"))), "words")


@dataclass
class Model:
    words: list[bytes]
    net: WindowNetwork
    rare_counts: list[int]  # of all words of each rare token


def _train_task(words: list[bytes], start: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, net, seen = Vocabulary(words), WindowNetwork.from_bytes(start), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                docs = [vocabulary.ids(t.as_py()) for t in batch.column(0).slice(lo, 128)]
                stream, starts = padded(docs)
                at = np.flatnonzero(stream != PAD)
                at = np.random.default_rng(len(at)).permutation(at)
                for a in range(0, len(at), BATCH):
                    part = at[a : a + BATCH]
                    net.step(windows(stream, part), stream[part].astype(np.int64), RATE / math.sqrt(1 + seen / 2e5))
                    seen += len(part)
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([seen], pa.int64()), pa.array([net.to_bytes()])], ["slot", "n", "net"])

    return run


NET = "slot long, n long, net binary"


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    total, n = None, int(pdf["n"].sum())
    for weight, blob in zip(pdf["n"], pdf["net"], strict=True):
        p = WindowNetwork.from_bytes(blob).p
        share = {k: v.astype(np.float64) * (weight / n) for k, v in p.items()}
        total = share if total is None else {k: total[k] + share[k] for k in total}
    net = WindowNetwork({k: v.astype(np.float32) for k, v in total.items()})
    return pd.DataFrame({"slot": [int(pdf["slot"].iloc[0]) // FAN_IN], "n": [n], "net": [net.to_bytes()]})


def train(texts: Texts, counted: DataFrame) -> Model:
    """The network, from all positions of all documents. Without any word it is the start.

    counted: see ``count_words``. The driver gets the words that are tokens, RARE counts and one network.
    """
    scratch = texts.scratch
    totals = counted.select("word", "total").distinct()
    top = sorted(top_rows(totals, FIRST_RARE, [F.desc("total"), F.col("word")]).collect(), key=lambda r: (-r["total"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in top]
    counts = np.zeros(TOKENS)
    counts[: len(words)] = [r["total"] for r in top]
    every = counted.groupBy(rare_token(F.col("word")).alias("t")).agg(F.sum("n").alias("n")).collect()
    for r in every:
        counts[r["t"]] = r["n"]
    for w, r in zip(words, top, strict=True):
        counts[FIRST_RARE + zlib.crc32(w[-2:]) % RARE] -= r["total"]
    start = WindowNetwork.start(counts)
    rare = [int(n) for n in counts[FIRST_RARE:]]
    nets = scratch.save(texts.table.select("text").mapInArrow(_train_task(words, start.to_bytes()), NET), "nets0")
    for level in range(1, 12):  # FAN_IN ** 12 tasks
        top_slot = nets.agg(F.max("slot")).first()[0]
        if top_slot is None:
            return Model(words, start, rare)
        group = (F.col("slot") / FAN_IN).cast("long")
        nets = scratch.save(nets.withColumn("g", group).groupBy("g").applyInPandas(_mean, NET), f"nets{level}")
        if top_slot < FAN_IN:
            break
    return Model(words, WindowNetwork.from_bytes(nets.first()["net"]), rare)


def write_shares(texts: Texts, counted: DataFrame, model: Model) -> str:
    """A folder for each file of texts with (hash, share) of the rare words in it, sorted: the log of a word's share
    of its token's count."""
    word = F.col("word")
    token = (rare_token(word) - FIRST_RARE + 1).cast("int")
    of_token = F.element_at(F.array(*[F.lit(max(1, n)) for n in model.rare_counts]), token)
    known = texts.table.sparkSession.createDataFrame([(w,) for w in model.words] or [(b"",)], "word binary")  # FIRST_RARE at most
    rare = counted.join(F.broadcast(known), "word", "left_anti")
    out = rare.select("file", F.xxhash64("word").alias("h"), F.log(F.col("total") / of_token).cast("float").alias("share"))
    root = texts.scratch.path("shares")
    out.repartition("file").sortWithinPartitions("file", "h").write.partitionBy("file").parquet(root)
    return root


class Shares:
    """The shares of rare words of one file of texts; a word that isn't there has that of one occurrence."""

    def __init__(self, root: str, rare_counts: list[int]) -> None:
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.once = [-math.log(n + 1) for n in rare_counts]
        self.file = None

    def open(self, file: int) -> None:
        if file == self.file:
            return
        self.file, path = file, f"{self.root}/file={file}"
        self.known: dict[bytes, float] = {}
        h, share = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if self.files.get_file_info(path).type == pafs.FileType.Directory:
            found = pads.dataset(path, filesystem=self.files, format="parquet").to_table(columns=["h", "share"])
            h, share = found["h"].to_numpy(), found["share"].to_numpy()
        order = np.argsort(h, kind="stable")
        self.h, self.share = h[order], share[order]

    def sums(self, words: list[bytes], of: np.ndarray, n: int) -> np.ndarray:
        """The sum over the words of each of n documents; ``of`` tells a word's document."""
        if new := set(words).difference(self.known):
            if len(self.known) > HELD_WORDS:
                self.known.clear()
                new = set(words)
            self.known.update(zip(new, self._look_up(list(new)), strict=True))
        got = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        return np.bincount(of, weights=got, minlength=n) if words else np.zeros(n)

    def _look_up(self, words: list[bytes]) -> list[float]:
        h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        there = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        got = np.zeros(len(h))
        got[there] = self.share[at[there]]
        for i in np.flatnonzero(~there):
            got[i] = self.once[zlib.crc32(words[i][-2:]) % RARE]
        return got.tolist()


def score(texts: Texts, model: Model, shares: str) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row of texts."""
    shared = texts.table.sparkSession.sparkContext.broadcast((model.words, model.net.to_bytes(), model.rare_counts))  # about 0.6 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own, rare = Vocabulary(shared.value[0]), WindowNetwork.from_bytes(shared.value[1]), Shares(shares, shared.value[2])
        for batch in batches:
            files = batch.column(2).to_numpy()
            cuts = sorted({*range(0, len(files), 256), *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)})
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rare.open(int(files[lo]))
                read = [vocabulary.read(t.as_py()) for t in batch.column(1).slice(lo, hi - lo)]
                stream, starts = padded([ids for ids, _ in read])
                where = np.flatnonzero(stream != PAD)
                of = np.repeat(np.arange(len(read)), [len(w) for _, w in read])
                total = rare.sums(list(itertools.chain.from_iterable(ws for _, ws in read)), of, len(read))
                which = np.searchsorted(starts, where, side="right") - 1
                for a in range(0, len(where), SLICE):
                    at = where[a : a + SLICE]
                    lp = own.log_probabilities(windows(stream, at), stream[at].astype(np.int64))
                    total += np.bincount(which[a : a + SLICE], weights=lp, minlength=len(read))
                n = np.array([len(ids) for ids, _ in read], np.int64)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]
                )

    return texts.table.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def lm_scores(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row, by a model of all of docs.

    The sum over all tokens of a whole text, however long; texts without a word (null and empty ones too) have
    0 tokens, sum 0 and no mean. Equal texts of one file get equal scores; repeated rows and null ids are scored
    row by row and train as often as they occur. Of equally frequent words the first in byte order is a token.
    docs' other columns aren't carried, so none can clash; an empty table gives an empty one.
    """
    texts = Texts.of(docs, text=text, doc_id=doc_id)
    counted = count_words(texts)
    model = train(texts, counted)
    return score(texts, model, write_shares(texts, counted, model))
