"""Alignment of the tokens of two tokenizers by interval coalescing.

A is a byte-level BPE file (``tokenizers`` format) and B a sentencepiece model
with byte pieces.  Both tokenise a blank plus the text (B puts that blank there
itself), so the tokens of each cut the same bytes into intervals.  All A and B
intervals are sorted by their start, ends are accumulated by their maximum, and
a group breaks where a start reaches that running maximum.  Inside the groups
overlapping A and B tokens are expanded into links.

Texts are aligned in runs of some megabytes as a few arrays.  Their id pairs are
named per block of texts: a block writes the list of its pairs once, and each of
its documents refers to that list by place, so that corpus-wide counts meet
documents in one row per block and pair instead of one per link.

Defined results: a missing or empty text, and one whose joined A or B bytes are
not the blank plus the text, has no tokens and zeros; strings of special tokens
in a text are plain text; repeated rows count as so many documents; rows need no
id; an empty table gives no rows; other columns are not read.  A text is cut into
parts for B only before a blank that follows another character, which no piece of
the model holds (checked when it is read), so any length gives the same tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmark.llm.byte_pairs import _once, encoder, ids_of, ranks_of
from drillmark.llm.shared import kept

#: Characters aligned in one go, and characters whose documents share a list of pairs.
RUN_CHARS = 1_000_000
BLOCK_CHARS = 16_000_000
#: Longest text given to B in one call.
PART_CHARS = 1 << 20

_MARK = "▁"
_CUT = regex.compile(f"[^ {_MARK}](?= )")


# ------------------------------------------------------------------ tokenizers


class ByteLevel:
    """A: ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        self.path = path
        ranks = ranks_of(path)
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, id in ranks.items():
            self.lengths[id] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return ids_of(" " + text, self.path).astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return encoder(self.path).decode_bytes(ids.tolist())


class Pieces:
    """B: ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError(f"{path}: a piece holds a blank after another character")
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, text: str) -> np.ndarray:
        ids, at = [], 0
        while len(text) - at > PART_CHARS:
            cut = _CUT.search(text, at + PART_CHARS)
            if cut is None:
                break
            ids += self.model.encode(text[at : cut.end()])
            at = cut.end() + 1  # the model puts the blank there again
        return np.array(ids + self.model.encode(text[at:]), np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, read once per worker process."""
    return _once(("byte level", path_a), lambda: ByteLevel(path_a)), _once(("pieces", path_b), lambda: Pieces(path_b))


def tokens_of(text: str | None, a: ByteLevel, b: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both tokenizers; none unless both spell the blank and the text."""
    if text:
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(text), b.encode(text)
        if a.joined(ids_a) == raw and b.joined(ids_b) == raw:
            return ids_a, ids_b
    return np.empty(0, np.int64), np.empty(0, np.int64)


# ------------------------------------------------------------------- intervals


def coalesced(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B interval, counted from 0 along the bytes."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((np.arange(len(start)), start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(start), np.int64)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(start_a)], group[len(start_a) :]


def expanded(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) numbers of all pairs of intervals that overlap; each side is sorted and without overlaps of its own."""
    first = np.searchsorted(end_b, start_a, "right")
    many = np.maximum(np.searchsorted(start_b, end_a, "left") - first, 0)
    a = np.repeat(np.arange(len(start_a)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return a, b


@dataclass
class Run:
    """Aligned texts: all tokens one after the other, ``doc_*`` by text."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray

    def slices(self) -> Iterator[tuple[slice, slice]]:
        """The A and the B tokens of each text."""
        for a, n, b, m in zip(np.cumsum(self.doc_a) - self.doc_a, self.doc_a, np.cumsum(self.doc_b) - self.doc_b, self.doc_b):
            yield slice(a, a + n), slice(b, b + m)


def aligned(texts: list[str | None], a: ByteLevel, b: Pieces) -> Run:
    """The alignment of some texts.  Their bytes lie one after the other, so no
    group and no link goes from one text into the next."""
    found = [tokens_of(text, a, b) for text in texts]
    none = np.empty(0, np.int64)
    ids_a, ids_b = (np.concatenate([none, *(f[side] for f in found)]) for side in (0, 1))
    doc_a, doc_b = (np.array([len(f[side]) for f in found], np.int64) for side in (0, 1))
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    spans = end_a - a.lengths[ids_a], end_a, end_b - b.lengths[ids_b], end_b
    return Run(ids_a, ids_b, *coalesced(*spans), *expanded(*spans), doc_a, doc_b)


class Writer:
    """The groups of a text as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, a: ByteLevel, b: Pieces):
        # a token with what stands before it: A inside, at the start of a group, of the text; B inside, first
        self.table = [s + str(i) for s in (",", ";", "") for i in range(a.size)] + [s + str(i) for s in (",", "|") for i in range(b.size)]
        self.a, self.b = a.size, b.size

    def written(self, run: Run) -> Iterator[str]:
        first_a = np.diff(run.group_a, prepend=-1) != 0
        begin_a = (np.cumsum(run.doc_a) - run.doc_a)[run.doc_a > 0]
        kind = first_a.astype(np.int64)
        kind[begin_a] = 2
        # a group lists its A tokens, then its B tokens: each side moves behind what the other has before it
        groups = int(run.group_a[-1]) + 1 if len(run.group_a) else 0
        before_a = np.cumsum(np.bincount(run.group_a, minlength=groups))
        before_b = np.cumsum(np.bincount(run.group_b, minlength=groups))
        codes = np.empty(len(run.ids_a) + len(run.ids_b), np.int64)
        earlier = np.concatenate([[0], before_b[:-1]]) if groups else before_b
        codes[np.arange(len(run.ids_a)) + earlier[run.group_a]] = kind * self.a + run.ids_a
        first_b = np.diff(run.group_b, prepend=-1) != 0
        codes[np.arange(len(run.ids_b)) + before_a[run.group_b]] = 3 * self.a + first_b * self.b + run.ids_b
        for a, b in run.slices():
            yield "".join(map(self.table.__getitem__, codes[a.start + b.start : a.stop + b.stop].tolist()))


# ------------------------------------------------------------------- documents


def _narrow(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def _runs(rows: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about so many characters."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in rows:
        for id, text in zip(batch.column("id"), batch.column("text")):
            ids.append(id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def alignments(df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b, group_a, group_b, link_a, link_b): the token ids of each text, the
    group of every token, and the places of the tokens that are linked."""
    schema = "id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>, link_a array<int>, link_b array<int>"
    lists = pa.list_(pa.int32())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        for ids, texts in _runs(rows, RUN_CHARS):
            run = aligned(texts, a, b)
            out: dict[str, list] = {c: [] for c in ("a", "b", "group_a", "group_b", "link_a", "link_b")}
            for of_a, of_b in run.slices():
                base = run.group_a[of_a.start] if of_a.stop > of_a.start else 0
                links = slice(*np.searchsorted(run.link_a, [of_a.start, of_a.stop]))
                values = (run.ids_a[of_a], run.ids_b[of_b], run.group_a[of_a] - base, run.group_b[of_b] - base,
                          run.link_a[links] - of_a.start, run.link_b[links] - of_b.start)
                for column, value in zip(out.values(), values):
                    column.append(value.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())} | {c: pa.array(v, lists) for c, v in out.items()})

    return _narrow(df, id, text).mapInArrow(batches, schema)


_BLOCKS = (
    "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, held array<int>"
)


def _blocks(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (``pairs`` missing) and one row per block with its pairs
    and the number of its documents that hold each.  ``places`` are a document's
    pairs as places in that list, ``times`` how often each occurs, both unsigned
    32-bit integers."""
    names = [c.split(" ")[0] for c in _BLOCKS.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        writer = _once(("writer", path_a, path_b), lambda: Writer(a, b))
        block = TaskContext.get().partitionId() << 32
        told: list[tuple] = []
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate([np.empty(0, np.int64), *pairs])
            own, place, held = np.unique(flat, return_inverse=True, return_counts=True)
            place, many = place.astype("<u4"), np.concatenate([np.empty(0, "<u4"), *times])
            ends = np.cumsum([0, *map(len, pairs)])
            columns = [list(c) for c in zip(*told)]
            packed = [[x[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])] for x in (place, many)]
            n = len(told)
            values = [[block] * (n + 1), *[[*c, None] for c in (*columns, *packed)], [None] * n + [own], [None] * n + [held]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        for ids, texts in _runs(rows, RUN_CHARS):
            run = aligned(texts, a, b)
            doc = np.repeat(np.arange(len(ids)), run.doc_a)[run.link_a]
            span = a.size * b.size
            keys, counts = np.unique(doc * span + run.ids_a[run.link_a] * b.size + run.ids_b[run.link_b], return_counts=True)
            edges = np.searchsorted(keys, np.arange(len(ids) + 1) * span)
            links = np.bincount(doc, minlength=len(ids))
            for k, ((of_a, of_b), line) in enumerate(zip(run.slices(), writer.written(run))):
                n_a, n_b = of_a.stop - of_a.start, of_b.stop - of_b.start
                groups = int(run.group_a[of_a.stop - 1] - run.group_a[of_a.start]) + 1 if n_a else 0
                told.append((ids[k], n_a, n_b, groups, int(links[k]), hashlib.sha256(line.encode()).hexdigest() if n_a else ""))
                pairs.append(keys[edges[k] : edges[k + 1]] - k * span)
                times.append(counts[edges[k] : edges[k + 1]].astype("<u4"))
            size += sum(len(t or "") for t in texts)
            if size >= BLOCK_CHARS:
                yield closed()
                block, told, pairs, times, size = block + 1, [], [], [], 0
        if told:
            yield closed()

    return df.mapInArrow(batches, _BLOCKS)


def linked_counts(df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    The count of an id pair is the number of documents that hold it linked.
    ``n_best`` are the links whose count is the highest that their A id has
    anywhere, ``count_sum`` is the sum of the counts over the links.
    """
    _, pieces = tokenizers(path_a, path_b)
    found = kept(_blocks(_narrow(df, id, text), path_a, path_b), "aligned")
    listed = found.filter(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    listed = listed.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("held"))
    counts = kept(listed.groupBy("pair").agg(F.sum("held").alias("docs")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {pieces.size}"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    told = counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    lookup = listed.select("block", "place", "pair").join(told, "pair").select(F.col("block").alias("of"), "place", "docs", "best")
    plain = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    documents = found.filter(F.col("pairs").isNull()).select("block", *plain, "places", "times")

    def summed(key, documents: pa.Table, lookup: pa.Table) -> pa.Table:
        place = lookup.column("place").to_numpy()
        docs, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        docs[place], best[place] = lookup.column("docs").to_numpy(), lookup.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for places, times in zip(documents.column("places"), documents.column("times")):
            at, many = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (places, times))
            sums.append((int(many @ best[at]), int(many @ docs[at])))
        out = documents.select(plain)
        for name, values in zip(("n_best", "count_sum"), zip(*sums) if sums else ([], [])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("block").cogroup(lookup.groupBy("of")).applyInArrow(summed, schema)
