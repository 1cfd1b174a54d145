"""Packing documents into token sequences by shortest-pack-first.

A document of more tokens than a sequence is cut into full sequences and a rest;
nothing else is cut.  Only the histogram of the piece lengths, one row per
length, goes to the driver.  There lengths are placed longest first, each into
the pack with the most room, and what is counted is patterns (the lengths in a
pack), not packs: a step moves as many packs at once as there are pieces of the
length.  Patterns go back to the pieces by rank: the r-th piece of a length
takes the r-th place that the patterns hold for that length.

Defined results: an added token of the tokenizer's file that occurs in a text has
its own id, as in ``tokenizers``; a missing or empty text is the end token alone; repeated rows
are packed like any others; an empty table gives no rows; rows need no id;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmark.llm.byte_pairs import ids_with_added
from drillmark.llm.shared import kept
from drillmark.operators.ordered import number_rows

SEQUENCE = 2048
END = 1
#: Pieces numbered by one task.
BLOCK_ROWS = 10_000

Patterns = list[tuple[int, tuple[int, ...]]]


def pieces(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): the token pieces of each document."""
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for k, body in enumerate(batch.column("text").to_pylist()):
                tokens = np.append(ids_with_added(body or "", path), np.uint32(end)).astype("<u4")
                for at in range(0, len(tokens), size):
                    part = tokens[at : at + size]
                    out["row"].append(k)
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["doc_tokens"].append(len(tokens))
                    if ids:
                        out["ids"].append(part.astype(np.int64))
            columns = {"id": batch.column("id").take(pa.array(out.pop("row"), pa.int32()))}
            listed = out.pop("ids")
            columns |= {c: pa.array(v, pa.int64()) for c, v in out.items()}
            if ids:
                columns["ids"] = pa.array(listed, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(batches, schema + (", ids array<long>" if ids else ""))


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> Patterns:
    """(number of packs, lengths in a pack) for all pieces of the histogram."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left = histogram.get(length, 0)
        room = size
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                by_room[size - length].append((left, (length,)))
                break
            packs, pattern = by_room[room].pop()
            moved = min(packs, left)
            if packs > moved:
                by_room[room].append((packs - moved, pattern))
            by_room[room - length].append((moved, (*pattern, length)))
            left -= moved
    return [found for packs in by_room for found in packs]


def places(patterns: Patterns) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of the runs of places the patterns hold, by length and rank."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset))
            next_rank[length] = rank + packs
            offset += length
        sequence += packs
    table = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(table[np.lexsort((table[:, 1], table[:, 0]))].T)


def packed(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with the sequence each lies in and its offset there, from 0 without gaps."""
    cut = kept(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    blocks = max(1, sum(counts.values()) // BLOCK_ROWS)
    order = [F.xxhash64("id", "start", "ids_crc32"), "id", "start", "ids_crc32"]
    # blocks of one length follow the order of the hash, so no task numbers a whole length
    block = F.expr(f"cast((xxhash64(id, start, ids_crc32) / 18446744073709551616 + 0.5) * {blocks} as int)")
    numbered = number_rows(cut, ["length"], order, block, "rank")
    lengths, ranks, sequences, offsets = places(shortest_pack_first(counts, size))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("rank").schema)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(ranks.max(initial=0)) + 1
        keys = lengths * span + ranks
        for batch in rows:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + np.minimum(rank - 1, span - 1), "right") - 1
            yield batch.drop_columns(["rank"]).append_column(
                "sequence_id", pa.array(sequences[at] + rank - 1 - ranks[at])
            ).append_column("offset", pa.array(offsets[at]))

    return numbered.mapInArrow(batches, schema + ", sequence_id long, `offset` long")


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packed(pieces(df, path, id, text, size, end, ids), size)
