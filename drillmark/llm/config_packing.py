"""Best-fit packing by a configuration linear program over the length histogram.

A document of more tokens than a sequence is cut into full sequences, before
which a shorter first piece may stand; nothing else is cut.  Only the histogram
of the piece lengths, one row per length, goes to the driver.  There the linear
program "fewest packs, each filled by one of all possible patterns, that hold all
pieces" is solved by multiplicative weights: a length's price is its share of a
sequence times ``exp(-ETA * (covered share - average covered share))``, so lengths
that lag behind get dearer.  The dearest pattern is found by dynamic programming
over the room (a knapsack); the same table completes a pattern for every length.
Those within ``NEAR`` of the best price are taken, none for more than ``STEP`` of
the pieces of a length at a time.  The amounts are then rounded down or to the
nearest number, what is left is placed by best fit, and the best of a few such
roundings stays.

Pieces count themselves by length while they are made; with the numbers of the
pieces made elsewhere that gives each its rank within the length, and by it a
place in a pattern, without any sort.

Defined results: an added token of the tokenizer's file that occurs in a text has
its own id, as in ``tokenizers``; a missing or empty text is the end token alone;
repeated rows are packed like any others; an empty table gives no rows; rows need
no id; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.byte_pairs import ids_with_added
from drillmark.llm.packing import Patterns, places
from drillmark.llm.shared import kept

SEQUENCE = 1024
END = 2
#: Multiplicative weights: strength of the prices, share of a length moved per
#: round, how far a pattern may stay behind the best price, and rounds at most.
ETA = 1.0
STEP = 0.02
NEAR = 0.1
ROUNDS = 2_000


# ------------------------------------------------------------------ the program


def priced(price: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(best price for each room, length to take first; 0: leave one token free)."""
    size = len(price) - 1
    best, first = np.zeros(size + 1), [0] * (size + 1)
    for room in range(1, size + 1):
        with_length = price[room:0:-1] + best[:room]  # of length room, room - 1, ... 1: the longest of equals
        k = int(with_length.argmax())
        if with_length[k] > best[room - 1]:
            best[room], first[room] = with_length[k], room - k
        else:
            best[room] = best[room - 1]
    return best, first


def completed(length: int, first: list[int]) -> dict[int, int]:
    """The pattern that fills up a length: how often it holds each length."""
    held, room = {length: 1}, len(first) - 1 - length
    while room:
        if first[room]:
            held[first[room]] = held.get(first[room], 0) + 1
            room -= first[room]
        else:
            room -= 1
    return held


def fractional(counts: np.ndarray, eta: float = ETA, step: float = STEP, near: float = NEAR, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Patterns and the amounts that hold all pieces, or nearly all if the rounds run out."""
    size = len(counts) - 1
    share = np.arange(size + 1) / size
    volume = float((counts * share).sum())
    used = np.zeros(size + 1)
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        covered = np.divide(used, counts, out=np.ones(size + 1), where=counts > 0)
        live = covered < 1 - 1e-9
        if not live.any():
            break
        price = np.where(live, share * np.exp(-eta * (covered - float((used * share).sum()) / volume)), 0.0)
        best, first = priced(price)
        budget = np.where(live, np.minimum(step * counts, counts - used), 0.0)
        left = budget.tolist()
        lengths = np.flatnonzero(live)
        lengths = lengths[price[lengths] + best[size - lengths] >= (1 - near) * best[size]]
        # those that lag behind go first, the longer of equals
        for length in lengths[np.lexsort((-lengths, covered[lengths]))].tolist():
            held = completed(length, first)
            amount = min(left[n] / many for n, many in held.items())
            if amount > 1e-9:
                for n, many in held.items():
                    left[n] -= amount * many
                pattern = tuple(n for n in sorted(held, reverse=True) for _ in range(held[n]))
                amounts[pattern] = amounts.get(pattern, 0.0) + amount
        used += budget - np.array(left)
    return amounts


def best_fit(counts: dict[int, int], size: int) -> Patterns:
    """(number of packs, lengths in a pack): longest first, each where the least room stays."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room <= size and not by_room[room]:
                room += 1
            if room > size:
                per = size // length
                for packs, many in ((left // per, per), (1, left % per)):
                    if packs and many:
                        by_room[size - many * length].append((packs, (length,) * many))
                break
            packs, pattern = by_room[room].pop()
            moved = min(packs, left)
            if packs > moved:
                by_room[room].append((packs - moved, pattern))
            by_room[room - length].append((moved, (*pattern, length)))
            left -= moved
            room = length
    return [found for packs in by_room for found in packs]


def rounded(amounts: dict[tuple[int, ...], float], counts: dict[int, int], size: int) -> Patterns:
    """Whole packs that hold exactly the pieces, as few as any of the roundings gives."""
    order = sorted(amounts.items(), key=lambda x: (size - sum(x[0]), -x[1], x[0]))
    found = best_fit(counts, size)
    for half in (0.0, 0.5):
        for waste in (0, 1, 3, size):
            left, packs = dict(counts), []
            for pattern, amount in order:
                held = {n: pattern.count(n) for n in set(pattern)}
                whole = min(int(amount + half + 1e-9), *(left[n] // many for n, many in held.items()))
                if whole > 0 and size - sum(pattern) <= waste:
                    packs.append((whole, pattern))
                    for n, many in held.items():
                        left[n] -= whole * many
            packs += best_fit({n: c for n, c in left.items() if c}, size)
            if sum(p for p, _ in packs) < sum(p for p, _ in found):
                found = packs
    return found


def solved(counts: dict[int, int], size: int = SEQUENCE) -> Patterns:
    """(number of packs, lengths in a pack) for all pieces of the histogram."""
    table = np.zeros(size + 1)
    table[list(counts)] = list(counts.values())
    return rounded(fractional(table), counts, size) if counts else []


# ------------------------------------------------------------------- documents


def pieces(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]): ``nth`` is the
    number, from 0, among the pieces of this length that the task ``part`` made."""
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<long>" if ids else "")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in rows:
            out: list[tuple] = []
            for id, text in zip(batch.column("id"), batch.column("text")):
                id, tokens = id.as_py(), np.append(ids_with_added(text.as_py() or "", path), np.uint32(end)).astype("<u4")
                first = len(tokens) % size or size
                for piece, at in enumerate([0, *range(first, len(tokens), size)]):
                    own = tokens[at : at + (size if piece else first)]
                    row = (id, piece, at, len(own), zlib.crc32(own.tobytes()), part, made[len(own)])
                    made[len(own)] += 1
                    out.append((*row, own.astype(np.int64)) if ids else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(batches, schema)


def packed(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with the sequence each lies in and its offset there, from 0 without gaps."""
    cut = kept(cut, "pieces")
    sizes = kept(cut.groupBy("length", "part").agg(F.max("nth").alias("last")), "sizes")
    totals = sizes.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect()  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before")
    # a row per length and task; a task's rows of one length meet one of them
    ranked = cut.join(sizes.select("length", "part", earlier), ["length", "part"])
    ranked = ranked.select(*[c for c in cut.columns if c not in ("part", "nth")], (F.col("before") + F.col("nth")).alias("rank"))
    lengths, ranks, sequences, offsets = places(solved({r["length"]: r["n"] for r in totals}, size))
    span = int(ranks.max(initial=0)) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths * span + ranks
        for batch in rows:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            placed = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequences[at] + rank - ranks[at]))
            yield placed.append_column("offset", pa.array(offsets[at]))

    return ranked.mapInArrow(batches, schema + ", sequence_id long, `offset` long")


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in as few sequences as the program finds."""
    return packed(pieces(df, path, id, text, size, end, ids), size)
