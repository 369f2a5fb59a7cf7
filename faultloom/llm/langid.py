"""Hierarchical language identification with linear support vector machines.

A text is a vector of hashed character 1- to 3-grams. One-versus-rest machines choose the language's
family; within a family one-versus-one machines, one for each pair of its languages, vote. All are
trained here from a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

DIMENSIONS = 1 << 13
#: The bound on labelled rows that the machines are trained on, over all languages.
SAMPLE_ROWS = 2400
CHUNK = 1 << 18
UNDETERMINED = "und"
NOT_LETTERS, NUMBERS = re.compile(r"[\W\d_]+"), regex.compile(r"[\p{No}\p{Nl}]+")  # re takes "½" and "Ⅷ" for letters
#: Below this score ``accepted`` rejects a language.
MIN_SCORE = 0.3

#: Families of languages by their usual codes. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr ne gu pa",
    "sinitic": "zh yue",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


def vector(text: str | None) -> np.ndarray | None:
    """The unit vector of the square roots of n-gram counts; None if the text has no letter."""
    words = NOT_LETTERS.sub(" ", text or "")
    if not words.isascii() and NUMBERS.search(words):
        words = NOT_LETTERS.sub(" ", NUMBERS.sub(" ", words))
    words = words.strip().lower()
    if not words:
        return None
    counts = np.zeros(DIMENSIONS)
    padded = f" {words} "
    shift = np.uint64(64 - 13)
    for at in range(0, len(padded), CHUNK):
        c = np.frombuffer(padded[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        two = c[:-1] * np.uint64(0x110000) + c[1:]
        three = two[:-1] * np.uint64(0x110000) + c[2:]
        fresh = 2 if at else 0  # what an earlier chunk has counted isn't counted again
        parts = (c[fresh:], two[max(0, fresh - 1) :] + np.uint64(1 << 45), three)
        with np.errstate(over="ignore"):
            for g in parts:
                if len(g):
                    counts += np.bincount(((g * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=DIMENSIONS)
    v = np.sqrt(counts)
    return v / np.sqrt((v * v).sum())


class Sparse:
    """Rows by their non-zero places: a dense matrix of all would fill the driver."""

    def __init__(self, places: list[bytes], values: list[bytes]) -> None:
        self.at, self.values = [np.frombuffer(p, np.uint16) for p in places], [np.frombuffer(v, np.float32) for v in values]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, r in enumerate(rows):
            out[i, self.at[r]] = self.values[r]
        return out


def train_svm(x: Sparse, y: np.ndarray, *, rounds: int = 1500, lam: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights and, last, the bias of a hinge-loss machine, by averaged subgradient steps.

    y: +1 or -1, or 0 for rows that take no part. Both classes weigh the same, whatever their numbers.
    """
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    w, mean = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        at = np.concatenate([rng.choice(s, 32) for s in sides])
        xb, yb = x[at], y[at]
        wrong = yb * (xb @ w[:-1] + w[-1]) < 1
        w *= 1 - 1 / (t + 10)
        rate = 1 / (lam * (t + 10)) / len(at) * 1e-2
        if wrong.any():
            w[:-1] += rate * (yb[wrong] @ xb[wrong])
            w[-1] += rate * yb[wrong].sum()
        mean += (w - mean) / t
    return mean


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None  # one row each
    pairs: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)
    scale: float = 4.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score of 0 to 1). Ties go to the larger sum of margins, then to the first code."""
        v = vector(text)
        if v is None or not self.languages:
            return UNDETERMINED, 0.0
        margins = self.family_weights[:, :-1] @ v + self.family_weights[:, -1]
        best = int(margins.argmax())
        family = self.families[best]
        grown = np.exp(self.scale * (margins - margins.max()))
        score = float(grown[best] / grown.sum())
        members = sorted(x for x in self.languages if family_of(x) == family)
        if len(members) == 1:
            return members[0], score
        votes = {x: [0, 0.0] for x in members}
        margin_of = {}
        for a, b, w in self.pairs[family]:
            m = float(w[:-1] @ v + w[-1])
            margin_of[a, b], margin_of[b, a] = m, -m
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        lang = max(members, key=lambda x: (votes[x][0], votes[x][1]))
        least = min(margin_of[lang, x] for x in members if x != lang)
        return lang, score / (1 + float(np.exp(-self.scale * min(max(least, -20), 20))))


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """The text and two short spans of it: short texts must be told apart as well."""
    words = text.split()
    out = [text]
    for n in (3, 12):
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n + 1))
            out.append(" ".join(words[at : at + n]))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of labelled texts and of their pieces, by their non-zero places."""
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            whole = text.as_py()
            for piece in _pieces(whole, np.random.default_rng(zlib.crc32(whole.encode("utf-8", "surrogatepass")))):
                if (v := vector(piece)) is not None:
                    at = np.flatnonzero(v)
                    rows.append((lang, at.astype(np.uint16).tobytes(), v[at].astype(np.float32).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        kinds = [pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["l", "at", "v"])


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """labelled: rows to learn from. Nulls in text or lang teach nothing.

    About ``rows`` of them at most are used, as many of each language, chosen by the hash of id and
    text; they are read whole. Tasks make their vectors, of which only the non-zero places come to the
    driver.
    """
    spark = labelled.sparkSession
    usable = labelled.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    usable = usable.where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([])
    each = max(1, rows // len(languages))
    shares = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "l string, share double")
    taken = usable.join(F.broadcast(shares), "l").where(F.pmod(F.xxhash64("i", "t", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    found = taken.select("l", "t").mapInArrow(_examples, "l string, at binary, v binary").collect()
    if not found:
        return LanguageModel([])
    found.sort(key=lambda r: (r["l"], bytes(r["at"]), bytes(r["v"])))  # the same model in any order of rows
    x, y = Sparse([bytes(r["at"]) for r in found], [bytes(r["v"]) for r in found]), np.array([r["l"] for r in found])
    del found
    languages = sorted(set(y.tolist()))
    family = np.array([family_of(k) for k in y])
    families = sorted(set(family.tolist()))
    model = LanguageModel(languages, families)
    if len(families) == 1:
        model.family_weights = np.zeros((1, DIMENSIONS + 1))
    else:
        model.family_weights = np.stack([train_svm(x, np.where(family == f, 1.0, -1.0)) for f in families])
    for f in families:
        members = sorted({k for k in languages if family_of(k) == f})
        model.pairs[f] = []
        for a, b in itertools.combinations(members, 2):
            model.pairs[f].append((a, b, train_svm(x, np.where(y == a, 1.0, np.where(y == b, -1.0, 0.0)))))
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. Null texts and texts without a letter are ``und`` with score 0, as is every
    text if the model knows no language."""
    languages = model

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([languages.predict(t) for t in texts], columns=["lang_pred", "score"])

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(*own, run(F.col(text).cast("string")).alias("__lang"))
    return out.select(*own, "__lang.lang_pred", "__lang.score")


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """docs with held_out, lang_pred and score; rows whose id's crc32 falls in the held fold teach nothing.

    A null id counts as the empty text in the fold. Texts are read whole, however long. Equal texts get equal
    results; repeated rows teach as often as they occur. Ties: see ``LanguageModel.predict``. An empty table
    gives an empty one. Other columns pass; those named held_out, lang_pred or score (in any case) are replaced.
    """
    out = crc_fold(doc_id, folds) == held
    model = train(docs.where(~out), text=text, lang=lang, doc_id=doc_id)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "held_out"])
    return predict(kept, model, text=text).withColumn("held_out", out)


def accepted(identified: DataFrame, *, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows whose language ``identify`` found with a score of ``least`` or more. Where no language could be
    learned, those with a letter."""
    return identified.where((F.col("score") >= least) | (F.col("score") == 0) & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
