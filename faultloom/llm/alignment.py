"""Alignment of two tokenizers' tokens of one text, by an associative monoid of fragments.

Tokens of A (byte-level BPE) and B (BPE of pieces) cover the same bytes. Offsets at which a token of each
ends cut them into groups. A fragment stands for a byte range of a text: the tokens up to its first common
end (open prefix), the groups between common ends (closed) and the tokens after the last (open suffix).
``compose`` joins neighbours and is associative, so a very long document's fragments are made by many tasks and
reduced in a tree of Spark stages. A range is nominal: each tokenizer begins at the first place from there on at which its
tokens surely begin, so a fragment's two sides may begin apart; the open parts carry what lies between.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .tokens import _byte_letters

#: Characters of a range; longer texts are cut. Fragments composed by one task at once.
RANGE, FAN_IN = 1 << 16, 16
#: Units remembered by a worker, and their length; units tokenized at once; texts that a task exchanges with Python at once.
MAX_UNITS, UNIT_CHARS, UNITS_AT_ONCE, TEXTS_AT_ONCE = 150_000, 40, 20_000, 500
#: Id pairs that are sent to every task; the others, each rarer than all links by this number, are joined.
HEAD_PAIRS = 1 << 20
SPACE = "▁"

#: A run of spaces and line ends and what follows: no token of either side crosses its beginning.
UNIT = re.compile("[ \n]+[^ \n]*|[^ \n]+")
#: White space of any kind but those; beside it only a plain character surely ends a token.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
PLAIN_EDGE = re.compile("(?<=[!-~\xa1-ɏ])(?=[ \n])")
_LETTER, _MARK = "A-Za-z一-鿿", "!-&(-/:-@\\[-`{-~、。！，？"
A_EDGE = re.compile(f"{PLAIN_EDGE.pattern}|(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_MARK}])(?=[{_LETTER}])")

LATIN = re.compile("[\n -~\xa1-\u024f]*").fullmatch
#: How byte-level BPE splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Tokens = list[tuple[int, int]]  # (id, end)


@dataclass
class Fragment:
    """``first`` and ``last`` hold (id, end) of both sides; without a common end all is in ``first``."""

    ok: bool = True
    cut: bool = False
    first_a: Tokens = field(default_factory=list)
    first_b: Tokens = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    last_a: Tokens = field(default_factory=list)
    last_b: Tokens = field(default_factory=list)


def _cut(a: Tokens, b: Tokens) -> tuple[list[tuple[Tokens, Tokens]], Tokens, Tokens]:
    """The groups between common ends, and what is left of both sides."""
    common = {e for _, e in a} & {e for _, e in b}
    if not common:
        return [], a, b
    groups, i, j = [], 0, 0
    for end in sorted(common):
        x, y = i, j
        while i < len(a) and a[i][1] <= end:
            i += 1
        while j < len(b) and b[j][1] <= end:
            j += 1
        groups.append((a[x:i], b[y:j]))
    return groups, a[i:], b[j:]


def _close(f: Fragment, groups: Iterable[tuple[Tokens, Tokens]]) -> None:
    for a, b in groups:
        f.groups.append(f"{','.join(str(t) for t, _ in a)}|{','.join(str(t) for t, _ in b)}")
        f.links.append((a[-1][0], b[-1][0]))
        f.n_a += len(a)
        f.n_b += len(b)


def fragment(a: Tokens, b: Tokens, ok: bool = True) -> Fragment:
    """The fragment of the tokens of a range."""
    return compose(Fragment(), Fragment(ok=ok, first_a=a, first_b=b))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbours. Common ends that show up only as open parts meet are found here."""
    left_a, left_b = (x.last_a, x.last_b) if x.cut else (x.first_a, x.first_b)
    groups, rest_a, rest_b = _cut(left_a + y.first_a, left_b + y.first_b)
    out = Fragment(ok=x.ok and y.ok, cut=x.cut or bool(groups), n_a=x.n_a, n_b=x.n_b, groups=list(x.groups), links=list(x.links))
    if not out.cut:
        out.first_a, out.first_b = rest_a, rest_b
        return out
    out.first_a, out.first_b = (x.first_a, x.first_b) if x.cut else groups.pop(0)
    _close(out, groups)
    if y.cut:
        out.groups += y.groups
        out.links += y.links
        out.n_a, out.n_b = out.n_a + y.n_a, out.n_b + y.n_b
    out.last_a, out.last_b = (y.last_a, y.last_b) if y.cut else (rest_a, rest_b)
    return out


def whole(f: Fragment) -> Fragment:
    """A document's fragment with its prefix closed; both sides end together, so that no suffix is left."""
    out = Fragment(ok=f.ok, cut=True)
    if f.cut:
        _close(out, [(f.first_a, f.first_b)])
    return Fragment(ok=f.ok, cut=f.cut, groups=out.groups + f.groups, links=out.links + f.links, n_a=out.n_a + f.n_a, n_b=out.n_b + f.n_b)


class Aligner:
    """Both tokenizers, what their ids stand for, and the units already aligned."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in _byte_letters().items()}
        size = 1 + max(self.a.get_vocab().values())
        tokens = (self.a.id_to_token(i) or "" for i in range(size))
        self.bytes_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        joined = {c for i, p in enumerate(pieces) if len(p) > 1 and not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for c in p}
        loners = f"[^{''.join(map(re.escape, sorted(joined | {SPACE, ' '})))}]"  # characters of no longer piece
        self.b_edge = re.compile(f"(?<=[^ {SPACE}])(?= )|(?<={loners})|(?={loners})")
        self.space = self.b.piece_to_id(SPACE)
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        numbers = [str(i) for i in range(max(size, len(pieces)))]
        self.told = [np.array([n + mark for n in numbers], object) for mark in ",|;\n"]
        # The same merges: an id is a merge's rank. For Latin text only, where no tables of letters differ.
        vocabulary = {t: i for t, i in ((t, self.a.token_to_id(t)) for t in self.a.get_vocab(with_added_tokens=False))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.quick_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple] = {}

    def ids_a(self, part: str) -> list[int]:
        return self.a.encode(part, add_special_tokens=False).ids if part else []

    def ids_b(self, part: str) -> list[int]:
        """Ids of a part that begins where a token does. The library sets a space before what it gets; a line end
        is never in a longer piece."""
        if part.startswith(" "):
            return self.b.encode(part[1:]) if len(part) > 1 else [self.space]
        return self.b.encode("\n" + part)[2:] if part else []

    def tokens(self, part_a: str, start_a: int, part_b: str, start_b: int) -> Fragment:
        a, b = self.ids_a(part_a), self.ids_b(part_b)
        ok = b"".join(self.bytes_a[i] for i in a) == part_a.encode() and b"".join(self.bytes_b[i] for i in b) == part_b.encode()
        ends = [np.cumsum([start, *(len(of[i]) for i in ids)])[1:].tolist() for ids, of, start in ((a, self.bytes_a, start_a), (b, self.bytes_b, start_b))]
        return fragment(list(zip(a, ends[0], strict=True)), list(zip(b, ends[1], strict=True)), ok)

    def unit(self, part: str) -> tuple:
        """(groups as text, A tokens, B tokens, links, whether the bytes are the text's)"""
        f = whole(self.tokens(part, 0, part, 0))
        return (";".join(f.groups), f.n_a, f.n_b, [a << 32 | b for a, b in f.links], f.ok)

    def units(self, text: str) -> list[str]:
        return PLAIN_EDGE.split(text) if ODD_SPACE.search(text) else UNIT.findall(text)

    def _together(self, parts: list[str], ids_a) -> list[tuple]:
        """``unit`` of parts that can stand one after another: each begins with a space or a line end, none ends with one."""
        text = "".join(parts)
        a, b = np.array(ids_a(text), np.int64), np.array(self.ids_b(text), np.int64)
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != text.encode():
            return [self.unit(p) for p in parts]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(p.encode()) for p in parts])
        last_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        last_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        closes = ends[np.searchsorted(ends, end_b)] == end_b
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        told = np.empty(len(a) + len(b), object)
        told[np.arange(len(a)) + np.concatenate([[0], stop_b])[np.cumsum(last_a) - last_a]] = np.where(last_a, self.told[1][a], self.told[0][a])
        told[np.arange(len(b)) + stop_a[np.cumsum(last_b) - last_b]] = np.where(closes, self.told[3][b], np.where(last_b, self.told[2][b], self.told[0][b]))
        links = (a[last_a] << 32 | b[last_b]).tolist()
        at = np.concatenate([[0], np.searchsorted(end_a[last_a], ends, "right")]).tolist()
        n_a, n_b = (np.diff(np.searchsorted(e, ends, "right"), prepend=0).tolist() for e in (end_a, end_b))
        groups = "".join(told.tolist()).split("\n")
        return [(groups[i], n_a[i], n_b[i], links[at[i] : at[i + 1]], True) for i in range(len(parts))]

    def learn(self, parts: list[str]) -> dict[str, tuple]:
        """``unit`` of each part, many at once; as many as there is room for are remembered."""
        joint: tuple[list[str], list[str]] = ([], [])
        found = {}
        for p in parts:
            if p[0] not in " \n" or p[-1] in " \n" or ODD_SPACE.search(p) or SPACE in p:
                found[p] = self.unit(p)
            else:
                joint[LATIN(p) is None].append(p)
        for some, ids_a in zip(joint, (self.quick_a.encode_ordinary, self.ids_a), strict=True):
            for at in range(0, len(some), UNITS_AT_ONCE):
                part = some[at : at + UNITS_AT_ONCE]
                found.update(zip(part, self._together(part, ids_a), strict=True))
        for p in parts:
            if len(self.known) < MAX_UNITS and len(p) <= UNIT_CHARS:
                self.known[p] = found[p]
        return found

    def short(self, texts: list[str]) -> Iterator[tuple]:
        """(ok, groups as text, A tokens, B tokens, links with their number) of texts with their leading space."""
        units = [self.units(t) for t in texts]
        known = self.known
        distinct = set().union(*units)
        found = {u: known[u] for u in distinct if u in known}
        found |= self.learn([u for u in dict.fromkeys(itertools.chain.from_iterable(units)) if u not in found])
        for own in units:
            links: dict[int, int] = {}
            n_a = n_b = 0
            ok = True
            for u, n in Counter(own).items():
                _, a, b, more, good = found[u]
                ok = ok and good
                n_a += n * a
                n_b += n * b
                for link in more:
                    links[link] = links.get(link, 0) + n
            yield ok, ";".join([found[u][0] for u in own]), n_a, n_b, links

    def ranges(self, text: str, size: int) -> Iterator[tuple[str, int, str, int]]:
        """(part for A, its first byte, part for B, its first byte) of each nominal range of ``size`` characters."""

        def edges(edge: re.Pattern) -> list[int]:
            at = [0]
            for nominal in range(size, len(text), size):
                m = edge.search(text, nominal)
                at.append(m.start() if m else len(text))
            return [*at, len(text)]

        start_a = start_b = 0
        a, b = edges(A_EDGE), edges(self.b_edge)
        for i in range(len(a) - 1):
            part_a, part_b = text[a[i] : a[i + 1]], text[b[i] : b[i + 1]]
            yield part_a, start_a, part_b, start_b
            start_a += len(part_a.encode())
            start_b += len(part_b.encode())


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


_ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, ns array<long>"


def _row(uid: int, doc_id, ok: bool, groups: str, n_a: int, n_b: int, links: dict) -> dict:
    """A row of _ALIGNED; without tokens zeros and the empty text."""
    if not ok or not links:
        return {"uid": uid, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": [], "ns": []}
    n = sum(links.values())
    told = {"n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "groups_sha256": hashlib.sha256(groups.encode()).hexdigest()}
    return {"uid": uid, "doc_id": doc_id, **told, "pairs": list(links), "ns": list(links.values())}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _align_short(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                uids, ids, texts = (c.to_pylist() for c in batch.slice(at, TEXTS_AT_ONCE).columns)
                told = own.short([" " + (t or "") for t in texts])
                rows = [_row(u, i, bool(t) and ok, *more) for u, i, t, (ok, *more) in zip(uids, ids, texts, told, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, _arrow(_ALIGNED))

    return run


def _split_long(path_a: str, path_b: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        names = ["uid", "doc_id", "at", "part_a", "start_a", "part_b", "start_b"]
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                parts = enumerate(own.ranges(" " + text.as_py(), size))
                rows = [(uid.as_py(), doc_id.as_py(), i, *p) for i, p in parts]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


_FRAGMENT = "uid long, doc_id long, at long, fragment string"


def _dump(f: Fragment) -> str:
    return json.dumps(list(vars(f).values()), separators=(",", ":"))


def _load(s: str) -> Fragment:
    ok, cut, first_a, first_b, groups, links, n_a, n_b, last_a, last_b = json.loads(s)
    pairs = lambda x: [tuple(t) for t in x]
    return Fragment(ok, cut, pairs(first_a), pairs(first_b), groups, pairs(links), n_a, n_b, pairs(last_a), pairs(last_b))


def _leaves(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            made = [_dump(own.tokens(*p)) for p in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["uid", "doc_id", "at", "fragment"])

    return run


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """One fragment of a group's neighbours."""
    rows = rows.sort_values("at")
    out = Fragment()
    for s in rows["fragment"]:
        out = compose(out, _load(s))
    return rows.head(1).assign(at=rows["up"].iloc[0], fragment=_dump(out))[["uid", "doc_id", "at", "fragment"]]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uid, doc_id, _, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            f = whole(_load(s))
            rows.append(_row(uid, doc_id, f.ok, ";".join(f.groups), f.n_a, f.n_b, Counter(a << 32 | b for a, b in f.links)))
        yield pa.RecordBatch.from_pylist(rows, _arrow(_ALIGNED))


def align(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", paths: tuple[str, str] | None = None, size: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each of docs: uid (of the row), doc_id, counts, the groups' hash and the links as (pairs, ns): id of A << 32
    | id of B, and how often.

    Texts of over ``size`` characters are cut into ranges that other tasks tokenize, and their fragments composed
    ``fan_in`` at a time.
    """
    spark = docs.sparkSession
    path_a, path_b = paths or default_paths()
    scratch = Scratch(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") > size, F.lit(False))
    scratch.save(rows.where(~is_long).mapInArrow(_align_short(path_a, path_b), _ALIGNED), "aligned")
    parts = rows.where(is_long).mapInArrow(_split_long(path_a, path_b, size), "uid long, doc_id long, at long, part_a string, start_a long, part_b string, start_b long")
    dealt = parts.repartition(shuffle_partitions(spark), "uid", "at")
    level = scratch.save(dealt.mapInArrow(_leaves(path_a, path_b), _FRAGMENT), "level0")
    most = level.agg(F.max("at")).first()[0] or 0
    depth = 0
    while most > 0:
        depth += 1
        up = level.withColumn("up", F.floor(F.col("at") / fan_in))
        level = scratch.save(up.groupBy("uid", "up").applyInPandas(_reduce, _FRAGMENT), f"level{depth}")
        scratch.drop(f"level{depth - 1}")
        most //= fan_in
    level.mapInArrow(_roots, _ALIGNED).write.mode("append").parquet(scratch.path("aligned"))
    return spark.read.parquet(scratch.path("aligned"))


def _weighed(head):
    """Adds count_sum and n_best from the broadcast pairs; ``rest`` holds the pairs that aren't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = head.value
        for batch in batches:
            pairs, ns = batch.column("pairs"), batch.column("ns")
            sizes = np.diff(pairs.offsets.to_numpy())
            flat, n = pairs.flatten().to_numpy(), ns.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total, tops = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            if hit.any():
                np.add.at(total, owner[hit], n[hit] * counts[at[hit]])
                np.add.at(tops, owner[hit], n[hit] * best[at[hit]])
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(left, x[~hit]) for x in (flat, n)]
            names = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tops), pa.array(total), *rest], [*names, "n_best", "count_sum", "pairs", "ns"])

    return run


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide links of each id pair, and whether none of the same B id has more."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "ns")).alias("l")).groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.ns").alias("n"))
    counts = Scratch(aligned.sparkSession, "link-counts").save(counts, "counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", paths: tuple[str, str] | None = None, size: int = RANGE, fan_in: int = FAN_IN, head_pairs: int = HEAD_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    Null and empty texts, and texts whose tokens don't give back the text's bytes behind a space (one with U+2581,
    say), have no tokens: zeros and the empty text. Repeated rows get a row each and count each; null ids stay; ids whose counts
    tie are all best. Texts of any length are read whole. docs' other columns aren't carried, so none can clash; an empty table gives an
    empty one. The commonest ``head_pairs`` id pairs at most are broadcast, the others joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    aligned = align(docs, text=text, doc_id=doc_id, paths=paths, size=size, fan_in=fan_in)
    counts = scratch.save(link_counts(aligned), "counts")
    n, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    over = 0 if n <= head_pairs else total // head_pairs  # fewer than head_pairs pairs have more than their share
    head = counts.where(F.col("n") > over).orderBy("pair").toArrow()
    arrays = tuple(head[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast(arrays)
    out = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, ns array<long>"
    weighed = aligned.select(*[c.split()[0] for c in _ALIGNED.split(", ")]).mapInArrow(_weighed(sent), out)
    if over:
        weighed = scratch.save(weighed, "weighed")
        rare = weighed.select("uid", F.explode(F.arrays_zip("pairs", "ns")).alias("l")).select("uid", F.col("l.pairs").alias("pair"), F.col("l.ns").alias("k"))
        rare = rare.join(counts, "pair").groupBy("uid").agg(F.sum(F.col("k") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("t"))
        weighed = weighed.join(rare, "uid", "left")
        weighed = weighed.withColumn("n_best", F.col("n_best") + F.coalesce("t", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
