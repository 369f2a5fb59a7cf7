"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The covering program (fewest sequences
whose configurations cover every length's count) is solved by multiplicative weights: each round prices
lengths by their weight, finds the most valuable configuration by knapsack dynamic programming, and lowers
the weights of what the configurations found so far cover, until their number is near its own dual bound. The fractional solution is rounded down to whole sequences with exact
lengths, best fit closing each one; the rest is packed by best fit on the histogram. All of this works on
counts of lengths, never on documents; documents find their places by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .tokens import default_tokenizer, word_ids

CAPACITY = 4096
END_ID = 1
#: Rounds end when the fractional number is within GAP of its dual bound; each has TURNS of weights over the configurations found.
CLASSES, ROUNDS, TURNS, STEP, GAP = 96, 2000, 200, 0.4, 1.01
UNITS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None
) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids of a document; a null text is an empty one."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path or default_tokenizer())
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The most valuable multiset of items (index: copies) within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(lengths, kind="stable")
    size, worth = lengths[order], values[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = worth[:k] + best[c - size[:k]]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], choice[c] = gain[j], j
    taken: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            i = int(order[choice[c]])
            taken[i] = taken.get(i, 0) + 1
            c -= int(lengths[i])
    return taken, float(best[capacity])


def solve_configurations(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, turns: int = TURNS, step: float = STEP, gap: float = GAP
) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations with their fractional numbers, a lower bound on any fractional cover).

    The covering program as a game: one side weighs items, the other shares sequences out to configurations, and
    what a configuration covers of the weighted items is the payoff. A round finds the best configuration of all for
    the weights by knapsack, which also gives a bound by duality; then both sides update multiplicatively
    over the configurations found so far, each foreseeing the other's last change, and the means of their turns
    stand. It ends once the cover is within ``gap`` of the bound. Numbers cover every item once at least.
    """
    counts = counts.astype(float)
    unit = bound = float((lengths * counts).sum() / capacity)
    # One column for each item alone makes every item covered from the start.
    found = [{i: int(max(1, min(capacity // n, c)))} for i, (n, c) in enumerate(zip(lengths, counts, strict=True))]
    known = {tuple(f.items()) for f in found}
    covers = np.diag([unit * f[i] / counts[i] for i, f in enumerate(found)])
    weight, shares = np.full(len(lengths), 1 / len(lengths)), np.full(len(found), 1 / len(found))
    best, number = shares, np.inf
    for _ in range(rounds):
        taken, value = knapsack(lengths, weight / counts, capacity)
        bound = max(bound, float(weight.sum()) / value)
        if number <= gap * bound:
            break
        key = tuple(sorted(taken.items()))
        if key not in known:
            known.add(key)
            found.append(dict(key))
            column = np.zeros(len(lengths))
            for i, k in key:
                column[i] = unit * k / counts[i]
            covers, shares = np.column_stack([covers, column]), np.append(shares, shares.max())
        shares = 0.9 * shares / shares.sum() + 0.1 / len(shares)
        log_weight, log_shares = np.log(weight), np.log(shares)
        covered, paid = covers @ shares, covers.T @ weight
        weights, parts = np.zeros_like(weight), np.zeros_like(shares)
        for _ in range(turns):
            covered_before, paid_before = covered, paid
            covered, paid = covers @ shares, covers.T @ weight
            log_weight -= step * (2 * covered - covered_before)
            log_shares += step * (2 * paid - paid_before)
            log_weight -= log_weight.max()
            log_shares -= log_shares.max()
            weight, shares = np.exp(log_weight), np.exp(log_shares)
            weight, shares = weight / weight.sum(), shares / shares.sum()
            weights, parts = weights + weight, parts + shares
        weight, shares = np.maximum(weights / turns, 1e-12), parts / turns
        if (now := unit / float((covers @ shares).min())) < number:
            number, best = now, shares
    # Surplus is no harm: rounding takes whole configurations only while items last.
    return [(f, float(x) * number) for f, x in zip(found, best, strict=False) if x > 0], bound


@dataclass
class Plan:
    """Types of sequences: ``runs`` has for each length and copy count the ranks it takes."""

    runs: np.ndarray  # rows: length, first rank, ranks, copies in a sequence, first sequence, offset
    sequences: int
    bound: float


def _classes(lengths: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Neighbouring lengths in at most n groups, none of less than half an equal share of the tokens: the
    weights of the program settle slowly if one item's mass is far below the others'."""
    mass = lengths * counts.astype(float)
    least = mass.sum() / (2 * n)
    ends, held = [], 0.0
    for i, x in enumerate(mass):
        held += x
        if held >= 2 * least or (held >= least and i + 1 < len(mass) and held + mass[i + 1] > 3 * least):
            ends.append(i + 1)
            held = 0.0
    if not ends or held >= least:
        ends.append(len(mass))
    ends[-1] = len(mass)  # a small rest joins the last group
    return np.split(np.arange(len(mass)), ends[:-1])


def least_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = 20) -> float:
    """A lower bound on any packing: all tokens, or all pieces as seen by a dual feasible function, which
    counts a piece of over 1/(k+1) of a sequence as 1/k of it, one of over 2/(k+1) as 2/k, and so on."""
    share = lengths / capacity
    bounds = [float((share * counts).sum())]
    for k in range(1, most + 1):
        whole, rest = np.divmod((k + 1) * lengths, capacity)
        bounds.append(float((np.where(rest == 0, share, whole / k) * counts).sum()))
    return max(bounds)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, *, classes: int = CLASSES) -> Plan:
    """A packing of a histogram of lengths of 1..capacity. Its size depends on the number of distinct
    lengths, not on that of documents."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"no sequence of {capacity} holds a piece of {length}")
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def emit(items: dict[int, int], times: int) -> None:
        nonlocal made
        at = 0
        for length, k in items.items():
            runs.append((length, int(used[length]), k * times, k, made, at))
            used[length] += k * times
            left[length] -= k * times
            at += k * length
        made += times

    def largest(limit: int, taken: dict[int, int]) -> int:
        """The largest length up to the limit of which more are left than taken; 0 if none."""
        spare = left[1 : limit + 1].copy()
        for length, k in taken.items():
            if length <= limit:
                spare[length - 1] -= k
        at = np.flatnonzero(spare > 0)
        return int(at[-1]) + 1 if len(at) else 0

    def close(items: dict[int, int]) -> dict[int, int]:
        """Fill what room is left: by one or two pieces exactly if there are such, else by best fit."""
        room = capacity - sum(n * k for n, k in items.items())
        while room:
            spare = left[: room + 1].copy()
            for n, k in items.items():
                if n <= room:
                    spare[n] -= k
            pairs = np.minimum(spare[1:room], spare[1:room][::-1])
            if room % 2 == 0 and room > 1:
                pairs[room // 2 - 1] //= 2
            if spare[room] > 0:
                chosen = [room]
            elif len(pairs) and (best := int(pairs.argmax())) >= 0 and pairs[best] > 0:
                chosen = [best + 1, room - best - 1]
            elif len(at := np.flatnonzero(spare > 0)):
                chosen = [int(at[-1])]
            else:
                break
            for n in chosen:
                items[n] = items.get(n, 0) + 1
                room -= n
        return items

    if left[capacity]:
        emit({capacity: 1}, int(left[capacity]))
    lengths = np.flatnonzero(left)
    bound = made + least_sequences(lengths, left[lengths], capacity)
    if len(lengths):
        groups = _classes(lengths, left[lengths], classes)
        mean = np.array([np.average(lengths[g], weights=left[lengths[g]]) for g in groups])
        number = np.array([left[lengths[g]].sum() for g in groups])
        unit = -(-capacity // UNITS)
        size = np.maximum(1, np.round(mean / unit)).astype(np.int64)
        solved, _ = solve_configurations(size, number, capacity // unit)
        for taken, x in sorted(solved, key=lambda s: -s[1]):
            want = int(x)
            order = sorted(taken, key=lambda i: -mean[i])
            while want > 0:
                items: dict[int, int] = {}
                room = capacity
                for i in order:
                    for _ in range(taken[i]):
                        spare = [n for n in lengths[groups[i]] if n <= room and left[n] > items.get(int(n), 0)]
                        if spare:
                            n = int(max(spare, key=lambda n: left[n] - items.get(int(n), 0)))
                            items[n] = items.get(n, 0) + 1
                            room -= n
                if not items:
                    break
                # The last item gives way to the one that fits best.
                if len(items) > 1 or sum(items.values()) > 1:
                    last = min(items)
                    items[last] -= 1
                    items = {n: k for n, k in items.items() if k}
                items = close(items)
                times = max(1, min(want, *(int(left[n]) // k for n, k in items.items())))
                emit(items, times)
                want -= times
        while n := largest(capacity, {}):
            items = close({n: 1})
            emit(items, min(int(left[n]) // k for n, k in items.items()))
    table = np.array(runs, np.int64).reshape(-1, 6)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], made, bound)


def _place(plan: Plan):
    """A UDF from (length, rank among the length) to (sequence_id, offset)."""
    runs = plan.runs
    length, first, copies, seq, offset = (runs[:, i].copy() for i in (0, 1, 3, 4, 5))
    rank_range = int(first.max()) + int(runs[:, 2].max()) + 1 if len(runs) else 1
    key = length * rank_range + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, n * rank_range + rank, side="right") - 1
        nth = rank - first[at]
        return pd.DataFrame({"sequence_id": seq[at] + nth // copies[at], "offset": offset[at] + nth % copies[at] * n})

    return place


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: every piece whole in one sequence, gapless from offset 0.

    ``pieces`` has a column ``length`` of 1..capacity. The plan goes to tasks as an array bounded by the
    number of distinct lengths (at most ``capacity``). Ranks are dealt in shares of a length, so that a
    length that most pieces have is spread over tasks. Equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    share = max(1, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    salts = F.greatest(F.lit(1), F.ceil(F.col("__n") / share)).cast("long")
    sizes = spark.createDataFrame(list(counts.items()), "length long, __n long")  # at most `capacity` rows
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("__salt", F.pmod(F.xxhash64(*keys), salts))
    salted = salted.withColumn("__within", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*pieces.columns)))
    # Every (length, salt) has about `share` rows, so there are few: their starts fit one small window.
    each = pieces.join(F.broadcast(sizes), "length").withColumn("__salt", F.pmod(F.xxhash64(*keys), salts))
    each = each.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    ranked = salted.join(starts, ["length", "__salt"])
    spot = _place(plan)(F.col("length"), F.col("__start") + F.col("__within") - 1)
    out = ranked.select(*pieces.columns, spot.alias("__spot"))
    return out.select(*pieces.columns, F.col("__spot.sequence_id"), F.col("__spot.offset"))


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, **columns: str) -> DataFrame:
    """Tokenise and pack whole documents; see ``token_pieces`` and ``pack``.

    A null or empty text is the end id alone. Texts are read whole; those of over ``capacity`` ids are cut into pieces.
    Repeated rows and null ids are packed row by row; which of several equal rows gets which place is open, and so
    are sequence numbers as such. docs' other columns aren't carried, so none can clash. No rows give no sequences.
    """
    return pack(token_pieces(docs, capacity=capacity, tokenizer=tokenizer, **columns), capacity=capacity)
