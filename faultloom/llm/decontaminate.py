"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = rate * m edits. It is cut into k + 1 pieces, one of
which any such occurrence holds unchanged; an Aho-Corasick automaton finds all exact piece hits in one
pass. A hit is verified from the bottom up: joined with its neighbours into ever larger parts of p pieces,
each of which must be within p - 1 edits (Myers' bit-parallel distance), up to the whole item. Short items are found
the same way, but must begin and end at word edges; those of a word or two prove nothing inside a sentence and must
be a whole line.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import without
from .common import Scratch, union_all

EDIT_RATE = 0.1
#: Shorter items (in normalised characters) begin and end at word edges.
MIN_CHARS = 20
#: Short items of fewer words only match a whole line: "no" is in every text.
MIN_WORDS = 3
#: Characters of test items that one automaton holds; more items are matched in blocks.
BLOCK_CHARS = 2_000_000
#: A piece of more items than this is looked up together with what must stand beside it.
MANY = 16


class _Letters(dict):
    """For str.translate: letters and digits stay, all else is a space."""

    def __missing__(self, code: int) -> str:
        self[code] = c if (c := chr(code)).isalnum() else " "
        return self[code]


_LETTERS = _Letters()


def normalise(text: str | None) -> str:
    """Lower-case words joined by single spaces."""
    return " ".join((text or "").lower().translate(_LETTERS).split())


def cut(n: int, pieces: int) -> list[tuple[int, int]]:
    """n characters in pieces of nearly equal length."""
    at = [i * n // pieces for i in range(pieces + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of the pattern to a substring of the text, end of the first such), or None
    if every distance is over ``most``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    best = None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # row 0 costs nothing: an occurrence may begin anywhere
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def apart(a: str, b: str) -> int:
    """The edit distance of two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


class Matcher:
    """All test items of a block, and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int, min_words: int = MIN_WORDS) -> None:
        self.items: list[tuple[int, str, list[tuple[int, int]]]] = []
        self.short: set[int] = set()
        self.lines: dict[str, list[int]] = {}
        self._grams: dict[int, set[str]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            short = len(t) < min_chars
            if short and t.count(" ") + 1 < min_words:
                self.lines.setdefault(t, []).append(item_id)
                continue
            spans = cut(len(t), int(rate * len(t)) + 1)
            for j, (a, b) in enumerate(spans):
                where.setdefault(t[a:b], []).append((len(self.items), j))
            if short:
                self.short.add(len(self.items))
            self.items.append((item_id, t, spans))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), *self._grouped(places)))
        if where:
            self.automaton.make_automaton()

    def _path(self, item: int, piece: int) -> list[tuple[int, int]]:
        """The parts from the whole item down to the piece."""
        lo, hi = 0, len(self.items[item][2])
        parts = [(lo, hi)]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
            parts.append((lo, hi))
        return parts

    def _grouped(self, places: list[tuple[int, int]]) -> tuple[list, dict]:
        """(places to verify at every hit, {(distance, length): {text: places}}).

        In a part of two pieces with one edit, half of the other piece stands unchanged beside the hit, two
        places off at most: a piece that many items share is verified only for items whose half does.
        """
        if len(places) <= MANY:
            return places, {}
        always, beside = [], {}
        for item, piece in places:
            _, t, spans = self.items[item]
            parts = self._path(item, piece)
            if len(parts) < 2 or parts[-2][1] - parts[-2][0] != 2:
                always.append((item, piece))
                continue
            a, b = spans[parts[-2][0] + (piece == parts[-2][0])]
            mid = (a + b) // 2
            for x, y in ((a, mid), (mid, b)):
                beside.setdefault((x - spans[piece][0], y - x), {}).setdefault(t[x:y], []).append((item, piece))
        return always, beside

    @staticmethod
    def _near(at: int, text: str, always: list, beside: dict) -> list[tuple[int, int]]:
        if not beside:
            return always
        found = dict.fromkeys(always)
        for (far, n), texts in beside.items():
            for start in range(max(0, at + far - 2), at + far + 3):
                found.update(dict.fromkeys(texts.get(text[start : start + n], ())))
        return list(found)

    def _verify(self, item: int, piece: int, at: int, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item around a piece that begins at ``at``; start is that of the
        window that was searched."""
        _, t, spans = self.items[item]
        parts = self._path(item, piece)
        found = (0, at, at + spans[piece][1] - spans[piece][0])
        for lo, hi in reversed(parts):
            budget = hi - lo - 1
            a, b = spans[lo][0], spans[hi - 1][1]
            begin = max(0, at - (spans[piece][0] - a) - budget)
            stop = at + (b - spans[piece][0]) + budget
            if budget == 1 and not self._one_off(t, spans, lo, piece, at, text):
                return None
            if budget:
                same = at - (spans[piece][0] - a)
                if same >= 0 and text.startswith(t[a:b], same):
                    found = (0, same, same + b - a)
                    continue
                got = myers(t[a:b], text[begin:stop], budget)
                if got is None:
                    return None
                found = (got[0], begin, begin + got[1])
        return found

    def _at_edges(self, item: int, piece: int, at: int, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of a short item's best occurrence of whole words around a piece that begins at ``at``."""
        _, t, spans = self.items[item]
        k, diagonal = len(spans) - 1, at - spans[piece][0]
        begins = [i for i in range(max(0, diagonal - k), diagonal + k + 1) if i == 0 or text[i - 1 : i] == " "]
        best = None
        for i in begins:
            for j in range(max(i + 1, i + len(t) - k), min(len(text), i + len(t) + k) + 1):
                if j == len(text) or text[j] == " ":
                    found = (apart(t, text[i:j]), i, j)
                    if found[0] <= k and (best is None or found < best):
                        best = found
        return best

    @staticmethod
    def _one_off(t: str, spans: list[tuple[int, int]], lo: int, piece: int, at: int, text: str) -> bool:
        """Whether a piece's neighbour can be there with one edit at most in both: half of it is then
        unchanged, moved by two places at most."""
        other = lo + 1 if piece == lo else lo
        a, b = spans[other]
        mid, base = (a + b) // 2, at - spans[piece][0]
        for x, y in ((a, mid), (mid, b)):
            half = t[x:y]
            if text.find(half, max(0, base + x - 2), base + y + 2) >= 0:
                return True
        return False

    def _plausible(self, item: int, diagonal: int, text: str, seen: dict[tuple[int, int], set[str]]) -> bool:
        """Whether the text around a diagonal has enough of the item's 3-grams: an edit destroys three at most."""
        _, t, spans = self.items[item]
        k = len(spans) - 1
        grams = self._grams.get(item)
        if grams is None:
            self._grams[item] = grams = {t[i : i + 3] for i in range(len(t) - 2)}
        lo = max(0, diagonal - k) // 64 * 64
        hi = -(-(diagonal + len(t) + k) // 64) * 64
        near = seen.get((lo, hi))
        if near is None:
            seen[lo, hi] = near = {text[i : i + 3] for i in range(lo, min(hi, len(text)))}
        return len(grams & near) >= len(grams) - 3 * k

    def _whole_lines(self, text: str) -> dict[int, tuple[int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        at = 0
        for line in text.split("\n") if self.lines else ():
            t = normalise(line)
            for item_id in self.lines.get(t, ()):
                found.setdefault(item_id, (0, at, at + len(t)))
            at += len(t) + bool(t)
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) for each item found: its best occurrence in normalised text."""
        t = normalise(text)
        if not t:
            return []
        short = [(i, *found) for i, found in self._whole_lines(text or "").items()]
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        seen: dict[tuple[int, int], set[str]] = {}
        for end, (n, always, beside) in self.automaton.iter(t) if self.items else ():
            at = end - n + 1
            shared = bool(beside) or len(always) > MANY
            if len(seen) > 64:
                seen.clear()
            for item, piece in self._near(at, t, always, beside):
                if item in best and best[item][0] == 0:
                    continue
                # Pieces of one occurrence lie on nearly the same diagonal; a verified one isn't tried again.
                diagonal = at - self.items[item][2][piece][0]
                if diagonal in tried.setdefault(item, set()):
                    continue
                if shared and not self._plausible(item, diagonal, t, seen):
                    continue
                verify = self._at_edges if item in self.short else self._verify
                if (found := verify(item, piece, at, t)) is not None:
                    tried[item].add(diagonal)
                    if item not in best or found < best[item]:
                        best[item] = found
        return sorted([*short, *((self.items[i][0], *found) for i, found in best.items())])


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the test items that occur in each document.

    Distances and places refer to normalised text (lower-case words with single spaces). An item of fewer than
    ``min_chars`` normalised characters must begin and end at word edges, with its own budget of edits; if it also has
    fewer than ``min_words`` words, it only matches a whole line. Null and empty texts and items match
    nothing; items without a letter or digit neither. Items of equal text are all reported; of equally near
    occurrences of one item the first is. Repeated rows and null ids are reported row by row; texts are searched
    whole. docs' other columns aren't carried, so none can clash.
    Documents are read once for each block of test items. Driver and tasks hold one block of about
    ``block_chars`` characters (or one item) at a time.
    """
    schema = "doc_id long, item_id long, distance int, start long, end long"
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    items = Scratch(docs.sparkSession, "benchmark").save(items.distinct(), "items")
    blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))

    def over(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t")
        shared = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in mine.collect()])  # about block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_chars, min_words)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.matches(t.as_py())]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "start", "end"])

        return picked.mapInArrow(run, schema)

    return union_all([over(block) for block in range(blocks)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a test item; all columns pass. Rows without an id share their fate: all are
    dropped if one of them holds an item. An empty table, or an empty benchmark, drops nothing."""
    return without(docs, leaks(docs, benchmark, doc_id=doc_id, **options).select("doc_id"), F.col(doc_id).cast("long"))
