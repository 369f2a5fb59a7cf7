"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters to Latin ones and digits that stand for letters back to
them; a 1 may be an i or an l, whichever a term of the lexicon has. The lexicon (words of any length and word beginnings
of up to LONGEST letters) and its weights come from counts over all labelled rows; contexts in which a term is harmless become exception phrases. A text's score is a logistic
function of its hits' weight in relation to its length, fitted on a bounded sample of those rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BROADCAST_IDS, Bloom
from .common import Scratch, crc_fold

#: The bound on labelled rows that the logistic function is fitted on.
SAMPLE_ROWS = 10_000
#: A term is in so many toxic rows at least, and this much likelier there.
MIN_DOCS, MIN_ODDS = 4, 6.0
#: A phrase is in so many harmless rows at least.
MIN_SPARED = 3
SHORTEST, LONGEST = 3, 32
#: How many times the log of the number of terms (or phrases) a term's likelihood ratio (a phrase's surprise) must be.
CHANCE = 2.0
#: A longer term says at least so many times more than every beginning of it that passes.
CLEARLY = 1.5
#: The model's size: terms of the highest likelihood ratio, and phrases of the most surprise. Driver and tasks hold that many.
MOST_TERMS, MOST_PHRASES = 200_000, 200_000
#: Terms that a task counts before it sends them on.
HELD_TERMS = 300_000

#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "z", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i",
}
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: An i or an l in folded text; folding leaves no other of these.
EITHER = "ı"
_TABLE = str.maketrans(LOOK_ALIKE)
_DIGITS = str.maketrans(DIGIT_LETTERS | {"1": EITHER, "!": EITHER})
#: Runs before a letter, and those after one, but for exclamation marks at a word's end. A run is looked at once.
_STANDS_IN = re.compile(r"(?<![013457@$!])[013457@$!]++(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]++")
_SIGNS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces; digits count as letters only beside a letter."""
    t = text or ""
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
        t = t.lower().translate(_TABLE)
    else:
        t = t.lower()
    if _STANDS_IN.search(t):
        t = _STANDS_IN.sub(lambda m: m[0].translate(_DIGITS), t)
    t = _SIGNS.sub(" ", t).strip()
    return f" {t} " if t else ""


def terms(folded: str) -> set[str]:
    """Candidate terms: each word (as " word ") and its beginnings (as " wor")."""
    out = set()
    for w in set(folded.replace(EITHER, "i").split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def plain(folded: str, automaton: ahocorasick.Automaton) -> str:
    """Folded text in which every i or l is the letter of the longest term that the word begins with, or i."""

    def settled(word: str) -> str:
        if EITHER not in word:
            return word
        alive, best = [" "], ""
        for c in f"{word} ":
            alive = [p for a in alive for x in (c if c != EITHER else "il") if automaton.match(p := a + x)]
            best = next((p for p in alive if p in automaton), best)
            if not alive:
                break
        known = best.strip()
        return known + word[len(known) :].replace(EITHER, "i")

    if EITHER not in folded:
        return folded
    if not len(automaton):
        return folded.replace(EITHER, "i")
    return f" {' '.join(map(settled, folded.split()))} "


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: list[str]
    bias: float = -2.0
    slopes: tuple[float, float] = (1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        """(weight of hits for each word of the text, weight of hits for a square root of them)."""
        if not folded or not len(automaton):
            return 0.0, 0.0
        folded = plain(folded, automaton)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif abs(w) > abs(hits.get(start, 0.0)):
                hits[start] = w  # of the terms that begin at a word, the one that says most
        spared.sort()
        total, stop, k = 0.0, -1, 0
        for s in sorted(hits):
            while k < len(spared) and spared[k][0] <= s:
                stop = max(stop, spared[k][1])
                k += 1
            if s >= stop:
                total += hits[s]
        words = folded.count(" ") - 1
        return total / words, total / math.sqrt(words)

    def score(self, x: tuple[float, float]) -> float:
        z = self.bias + self.slopes[0] * x[0] + self.slopes[1] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, *, steps: int = 60) -> np.ndarray:
    """Bias and slopes by Newton steps with a little ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(found) -> Iterator[pa.RecordBatch]:
    """(term, a, b) of (terms of a row, toxic or not): in how many toxic and other rows each is, summed as memory allows."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        a, b = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["term", "a", "b"])

    for terms_, toxic in found:
        for t in terms_:
            n = held.get(t)
            if n is None:
                held[t] = n = [0, 0]
            n[1 - toxic] += 1
        if len(held) > HELD_TERMS:
            yield out()
            held.clear()
    if held:
        yield out()


COUNTED = "term string, a long, b long"


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def train(rows: DataFrame, *, sample: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """rows: text and toxic (0 or 1; others teach nothing); ``exceptions`` are added to those learned.

    Terms and phrases are counted, tested and pruned over all rows in Spark; at most MOST_TERMS and MOST_PHRASES reach the
    driver, ties by the term itself. A term must say more than chance would of any of so many terms (a likelihood ratio
    of twice the log of their number), whatever its share of the rows. About ``sample`` rows, chosen by hash, fit the logistic function.
    """
    scratch = Scratch(rows.sparkSession, "toxicity")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(t.as_py()) for t in batch.column(0)], pa.string()), batch.column(1)], ["text", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count((terms(t.as_py()), y) for batch in batches for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True))

    rows = rows.where("toxic in (0, 1)").select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(folded, "text string, toxic long")
    rows = scratch.save(rows, "rows")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, [fold(x) for x in exceptions], bias=8.0 if n1 else -8.0)
    counted = _summed(rows.mapInArrow(count, COUNTED)).where(F.col("a") >= MIN_DOCS)
    counted = scratch.save(counted, "terms")
    a, b = F.col("a"), F.col("b")
    odds = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    expected = (a + b) * (n1 / (n1 + n0))
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    passing = counted.select("term", odds.alias("odds"), ratio.alias("ratio"))
    passing = passing.where((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= CHANCE * math.log(max(2, counted.count()))))
    passing = scratch.save(passing, "passing")
    # A word's own beginning of the same letters counts as shorter than the word.
    reach = F.least(F.length(F.rtrim("term")) - F.when(F.col("term").endswith(" "), 0).otherwise(1), F.lit(LONGEST + 1))
    lengths = F.when(reach > SHORTEST, F.sequence(F.lit(SHORTEST + 1), reach)).otherwise(F.array().cast("array<int>"))
    shorter = passing.select("term", F.explode(F.transform(lengths, lambda k: F.substring("term", F.lit(1), k))).alias("begins"))
    shorter = shorter.join(passing.select(F.col("term").alias("begins"), F.col("odds").alias("most")), "begins")
    best = passing.join(shorter.groupBy("term").agg(F.max("most").alias("most")), "term", "left")
    best = best.where(F.col("most").isNull() | (F.col("odds") > CLEARLY * F.col("most")))
    best = best.orderBy(F.desc("ratio"), "term").limit(MOST_TERMS)
    weights = {r["term"]: math.log(r["odds"]) for r in best.orderBy("term").collect()}
    model = ToxicityModel(weights, [fold(x) for x in exceptions])
    model.exceptions += _learn_exceptions(rows, model, n1 / n0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = [model.features(t.as_py(), automaton) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in x], pa.float64()), pa.array([j for _, j in x], pa.float64()), batch.column(1)], ["d", "s", "toxic"]
            )

    share = min(1.0, sample / (n1 + n0))
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    got = picked.mapInArrow(measured, "d double, s double, toxic long").toPandas()
    got = got.sort_values(["d", "s", "toxic"])
    w = _logistic(got[["d", "s"]].to_numpy(), got["toxic"].to_numpy(float))
    model.bias, model.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return model


def _learn_exceptions(rows: DataFrame, model: ToxicityModel, ratio: float) -> list[str]:
    """Two-word phrases around a hit that only harmless texts have, and more of them than the hit's own share of toxic
    rows would leave by chance. rows: folded texts; ratio: toxic to other rows."""

    def found(text: str, automaton: ahocorasick.Automaton) -> set[str]:
        out = set()
        text = plain(text, automaton)
        for end, (n, w) in automaton.iter(text) if text else ():
            if w is None:
                continue
            start = end - n + 1
            stop = text.index(" ", start + 1)
            before = text.rfind(" ", 0, start) if start else -1
            if before >= 0:
                out.add(text[before : stop + 1])
            after = text.find(" ", stop + 1)
            if after > 0:
                out.add(text[start : after + 1])
        return out

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        yield from _count((found(t.as_py(), automaton), y) for batch in batches for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True))

    if not model.weights:
        return []
    @F.pandas_udf("double")
    def surprise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Of one harmless row: minus the log of the share of harmless rows among those with the hit."""
        automaton = model.automaton()
        for found_ in batches:
            most = [max((w for _, (_, w) in automaton.iter(t) if w is not None), default=0.0) for t in found_]
            yield pd.Series(np.log1p(np.exp(most) * ratio), dtype=float)

    counted = Scratch(rows.sparkSession, "toxicity-phrases").save(_summed(rows.mapInArrow(phrases, COUNTED)), "phrases")
    kept = counted.where((F.col("a") == 0) & (F.col("b") >= MIN_SPARED)).select("term", (F.col("b") * surprise("term")).alias("surprise"))
    kept = kept.where(F.col("surprise") >= CHANCE * math.log(max(2, counted.count())))
    return sorted(r["term"] for r in kept.orderBy(F.desc("surprise"), "term").limit(MOST_PHRASES).collect())


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """docs with score and predicted; empty and null texts get the score of no hits."""
    kept = model

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = kept.automaton()
        for texts in batches:
            yield pd.Series([kept.score(kept.features(fold(t), automaton)) for t in texts], dtype=float)

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*own, run(F.col(text).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """docs with held_out, score and predicted; labels of ids in the held fold teach nothing.

    A document with several labels is toxic if one says so; labels without an id or of no document teach
    nothing, and repeated documents teach as often as they occur. A null id counts as the empty text in the fold.
    Texts are read whole; equal texts get equal scores, and a null or empty one that of no hits. Without labels
    of both kinds every score is near that of the one kind. An empty table gives an empty one. Other columns
    pass; those named held_out, score or predicted (in any case) are replaced.
    """
    out = crc_fold(doc_id, folds) == held
    known = labels.where(F.col("doc_id").isNotNull() & ~(crc_fold("doc_id", folds) == held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    known = Scratch(docs.sparkSession, "toxicity-labels").save(known, "known")
    texts = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).cast("string").alias("text"))
    n = known.count()
    if n <= BROADCAST_IDS:
        known = F.broadcast(known)
    else:  # only texts that may be labelled are exchanged
        texts = texts.where(Bloom.of(known.select(F.xxhash64("__id").alias("h")), n=n).may_hold(docs, F.xxhash64("__doc")))
    model = train(texts.join(known, F.col("__doc") == F.col("__id")).select("text", "toxic"), sample=rows)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "held_out"])
    return score(kept, model, text=text).withColumn("held_out", out)
