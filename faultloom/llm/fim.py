"""Fill-in-the-middle examples: texts cut at two unit boundaries and put together anew.

Each character has a class, the set of units (line, word, sentence) that end with it. A wavelet matrix over the classes
counts any class up to any place; the counts of all classes that hold a unit add up to its boundaries, and a select, or
a bisection on such sums where several classes hold it, finds the place of a cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE, WORD, SENTENCE = 1, 2, 4
UNITS = {"line": LINE, "word": WORD, "sentence": SENTENCE}
LEVELS = 3
MARKS = ("<P>", "<S>", "<M>")


def classes(text: str) -> np.ndarray:
    """For each character the units that end with it: a line at its line end, a word before white space or the text's end, a
    sentence at a full stop, question or exclamation mark at a word's end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | (c - 9 <= 4)
    last = ~space & np.append(space[1:], True)
    stop = last & ((c == 46) | (c == 33) | (c == 63))
    return ((c == 10) * LINE + last * WORD + stop * SENTENCE).astype(np.uint8)


class WaveletMatrix:
    """rank and select of symbols below 2^levels."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS) -> None:
        self.size, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            bits = (symbols >> level) & 1
            words = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words[: len(packed)] = packed
            words = words.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            one = bits.astype(bool)
            self.levels.append((words, before, len(bits) - int(before[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(level: tuple, i: int) -> int:
        words, before, _ = level
        w, r = i >> 6, i & 63
        return int(before[w]) + (int(words[w]) & ((1 << r) - 1)).bit_count()

    def rank(self, symbol: int, i: int) -> int:
        """How many of the first i symbols equal this one."""
        lo, hi = 0, i
        for k, level in enumerate(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (len(self.levels) - 1 - k) & 1:
                lo, hi = level[2] + a, level[2] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """The place of the symbol's k-th occurrence, k from 0; it must have so many."""
        lo = 0
        for d, level in enumerate(self.levels):
            a = self._ones(level, lo)
            lo = level[2] + a if symbol >> (len(self.levels) - 1 - d) & 1 else lo - a
        at = lo + k
        for d, level in reversed(list(enumerate(self.levels))):
            one = symbol >> (len(self.levels) - 1 - d) & 1
            at = self._select_bit(level, one, at - level[2] if one else at)
        return at

    @staticmethod
    def _select_bit(level: tuple, one: int, k: int) -> int:
        words, before, _ = level
        upto = before if one else 64 * np.arange(len(before)) - before
        w = int(np.searchsorted(upto, k, "right")) - 1
        word = int(words[w]) if one else ~int(words[w]) & (1 << 64) - 1
        for _ in range(k - int(upto[w])):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


class Units:
    """The units of a text and where they end."""

    def __init__(self, text: str, unit: str = "line") -> None:
        symbols = classes(text)
        self.size = len(symbols)
        self.matrix = WaveletMatrix(symbols)
        self.classes = [c for c in range(1 << LEVELS) if c & UNITS[unit] and self.matrix.rank(c, self.size)]
        self.ends = self.boundaries(self.size)
        tail = self.size > 0 and self.boundaries(self.size - 1) == self.ends
        self.n = self.ends + tail  # what follows the last end is a unit too

    def boundaries(self, i: int) -> int:
        return sum(self.matrix.rank(c, i) for c in self.classes)

    def cut(self, k: int) -> int:
        """Where the first k units end."""
        if k == 0:
            return 0
        if k > self.ends:
            return self.size
        if len(self.classes) == 1:
            return self.matrix.select(self.classes[0], k - 1) + 1
        lo, hi = 1, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.boundaries(mid) >= k else (mid + 1, hi)
        return lo


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, doc_id: int | None, *, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)"""
    units = Units(text, unit)
    h = numbers(doc_id, seed)
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return units.n, "plain", None, None, text
    i, j = (units.cut(k) for k in sorted(x % (units.n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = marks
    spm = h[3] % 100 < spm_percent
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return units.n, "spm" if spm else "psm", i, j - i, output


def fill_in_middle(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs; options as of ``transform``.

    A null text counts as empty. Empty texts and texts that hold a mark stay plain, with null lengths. Repeated rows get
    equal rows; a null id has cuts of its own. Texts of any length are cut whole, a document at a time. docs' other columns aren't carried, so none can clash; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows = [transform(t or "", i, **options) for i, t in zip(ids, texts, strict=True)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    first, second = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))), F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(first, F.get(parts, F.lit(3)), second))
