"""Byte-level BPE: texts to token ids and back.

A text longer than a chunk is cut into chunks that overlap, and each chunk is
pre-tokenised on its own, in parallel.  The pattern looks forward only, so two
scans that share one pre-token boundary agree from there on: the scan of a chunk
and that of the next are stitched at the first boundary they share in the
overlap.  Where an overlap holds none (one pre-token covers it), the pieces on
both sides are scanned again as one.  The pieces between stitches are encoded
each on its own; the ids of a text are those of its pieces in order.

Defined results: a missing text is empty and gives no ids; equal rows give equal
results; an empty table gives no rows; rows need no id; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the overlap with the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 10


# ------------------------------------------------------------------ vocabulary


def _once(key, make):
    """Made once per worker process.  This module reaches workers by value, anew
    with each task, so what should outlive a task hangs on an installed module."""
    made = tiktoken.__dict__.setdefault("_made_once", {})
    if key not in made:
        made[key] = make()
    return made[key]


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (.tiktoken) or a byte-level BPE file (.json)."""
    return _once(("ranks", path), lambda: _read_ranks(path))


def _read_ranks(path: str) -> dict[bytes, int]:
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model = read["model"]
    special = {t["content"] for t in read["added_tokens"]}
    byte_of = _bytes_of_letters()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if read["normalizer"] is not None or read["pre_tokenizer"]["add_prefix_space"] or made != sorted(made):
        raise ValueError(f"{path}: the ids are not in the order of the merges")
    return ranks


def _bytes_of_letters() -> dict[str, int]:
    """The letters byte-level BPE files write bytes with: printable bytes stand
    for themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return _once(
        ("encoder", path, pattern),
        lambda: tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={}),
    )


def _scanner(pattern: str):
    return regex.compile(pattern)


# ---------------------------------------------------------------------- chunks


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Where pre-tokens end; of a text that goes on, only ends that more text cannot move."""
    ends = [m.end() for m in _scanner(pattern).finditer(text)]
    if not whole:  # the last pre-tokens may go on, or look at what follows
        while ends and ends[-1] >= len(text) - 1:
            ends.pop()
    return ends


def stitch(text: str, scans: list[list[int]], pattern: str, chunk: int) -> list[tuple[int, list[int]]]:
    """(first character, ends of the pre-tokens) of the pieces of one text.

    ``scans``: for each chunk the ends its own scan found, counted from the
    start of the text.  The scan of a chunk is taken over from the first end (or
    start) that it shares with the true ones so far.
    """
    pieces: list[tuple[int, list[int]]] = []
    begin, true = 0, scans[0]
    for k in range(1, len(scans)):
        own = {k * chunk, *scans[k]}
        shared = next((e for e in true if e >= k * chunk and e in own), None)
        at = true[-1] if true else begin
        if shared is None and at < len(text):  # one pre-token over the whole overlap: scan on from the last true end
            to = len(text) if k + 1 == len(scans) else min(len(text), (k + 2) * chunk)
            true = [*true, *_onwards(text, at, to, pattern)]
            shared = next((e for e in true if e >= k * chunk and e in own), None)
        if shared is None:
            continue
        pieces.append((begin, [e for e in true if e <= shared]))
        begin, true = shared, [e for e in scans[k] if e > shared]
    pieces.append((begin, true))
    return [(a, ends) for a, ends in pieces if ends]


def _onwards(text: str, at: int, to: int, pattern: str) -> list[int]:
    return [at + e for e in boundaries(text[at:to], pattern, to == len(text))]


def _long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of texts of more than one chunk."""
    # equal rows have equal keys; ``copies`` counts them
    keyed = long.select(F.xxhash64("id", "text").alias("key"), "id", "text", F.length("text").alias("n"))
    last = F.expr(f"cast((n - 1) div {chunk} as int)")
    chunks = keyed.select("key", "id", "text", "n", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(
        "key", "id", "at", F.expr(f"n <= at * {chunk} + {chunk + overlap}").alias("whole"),
        F.expr(f"substring(text, at * {chunk} + 1, {chunk + overlap})").alias("body"),
    )

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ends = [
                [at * chunk + e for e in boundaries(body, pattern, whole)]
                for at, whole, body in zip(*(batch.column(c).to_pylist() for c in ("at", "whole", "body")))
            ]
            yield batch.append_column("ends", pa.array(ends, pa.list_(pa.int64())))

    scanned = chunks.repartition("key", "at").mapInArrow(
        scan, "key long, id long, at int, whole boolean, body string, ends array<long>"
    )

    def pieces(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, bodies, ends = (table.column(c).to_pylist() for c in ("at", "body", "ends"))
        copies = at.count(0)
        bodies, ends = bodies[::copies], ends[::copies]
        text = "".join([b[:chunk] for b in bodies[:-1]] + bodies[-1:])
        found = stitch(text, ends, pattern, chunk)
        return pa.table(
            {
                "key": pa.array([table.column("key")[0].as_py()] * len(found), pa.int64()),
                "id": pa.array([table.column("id")[0].as_py()] * len(found), pa.int64()),
                "copies": pa.array([copies] * len(found), pa.int32()),
                "piece": pa.array(range(len(found)), pa.int32()),
                "body": pa.array([text[a : e[-1]] for a, e in found], pa.string()),
                "sizes": pa.array([np.diff([a, *e]).tolist() for a, e in found], pa.list_(pa.int32())),
            }
        )

    cut = scanned.groupBy("key").applyInArrow(
        pieces, "key long, id long, copies int, piece int, body string, sizes array<int>"
    )

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoder(path, pattern)._encode_single_piece
        for batch in rows:
            out = []
            for body, sizes in zip(batch.column("body").to_pylist(), batch.column("sizes").to_pylist()):
                ids, at = [], 0
                for n in sizes:
                    ids += single(body[at : at + n])
                    at += n
                out.append(ids)
            yield batch.select(["key", "id", "copies", "piece"]).append_column("ids", pa.array(out, pa.list_(pa.int32())))

    encoded = cut.repartition("key", "piece").mapInArrow(
        encode, "key long, id long, copies int, piece int, ids array<int>"
    )

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path, pattern).decode_bytes
        now = None  # key, id, copies, ids so far, two digests

        def done():
            _, id, copies, n, ids, raw = now
            return _rows([id] * copies, [n] * copies, [ids.hexdigest()] * copies, [raw.hexdigest()] * copies)

        for batch in rows:
            for row in batch.to_pylist():
                if now is None or now[0] != row["key"]:
                    if now is not None:
                        yield done()
                    now = [row["key"], row["id"], row["copies"], 0, hashlib.sha256(), hashlib.sha256()]
                now[4].update(((" " if now[3] else "") + " ".join(map(str, row["ids"]))).encode())
                now[5].update(decode(row["ids"]))
                now[3] += len(row["ids"])
        if now is not None:
            yield done()

    return encoded.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(digest, DIGESTS)


DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(ids, n, ids_sha, raw_sha) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
         "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(raw_sha, pa.string())}
    )


def round_trip(
    df: DataFrame,
    path: str,
    id: str = "doc_id",
    text: str = "text",
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Encode every text, decode its ids, and return both digests, one row per input row."""
    narrow = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def one_chunk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        written = {i: str(i) for i in ranks_of(path).values()}.__getitem__
        for batch in rows:
            n, ids_sha, raw_sha = [], [], []
            for body in batch.column("text").to_pylist():
                ids = coder.encode_ordinary(body)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(written, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield _rows(batch.column("id"), n, ids_sha, raw_sha)

    short = narrow.filter(F.length("text") <= chunk).mapInArrow(one_chunk, DIGESTS)
    return short.unionByName(_long(narrow.filter(F.length("text") > chunk), path, pattern, chunk, overlap))


def decoded(df: DataFrame, ids: str, path: str) -> DataFrame:
    """``df`` with the raw bytes of its id lists as ``bytes``; a missing list gives none."""

    @F.pandas_udf("binary")
    def raw(lists: pd.Series) -> pd.Series:
        decode = encoder(path).decode_bytes
        return lists.map(lambda x: None if x is None else decode(list(x)))

    return df.withColumn("bytes", raw(ids))


# ------------------------------------------------------------ whole texts


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A very long text in parts that ``PATTERN`` treats apart: cut before a blank after a non-blank."""
    at = 0
    while len(text) - at > size:
        cut = _AFTER_WORD.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


_AFTER_WORD = regex.compile(r"\S(?=\s)")


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a text in which nothing is an added token."""
    encode = encoder(path).encode_ordinary
    return np.concatenate([np.array(encode(part), np.uint32) for part in parts_of(text)])


def added_tokens(path: str) -> dict[str, int]:
    """The texts that a byte-level BPE file (.json) gives ids of their own before any merge."""
    return _once(("added", path), lambda: _read_added(path))


def _read_added(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: an added token takes what is beside it into account")
    return {t["content"]: t["id"] for t in added}


def ids_with_added(text: str, path: str) -> np.ndarray:
    """Ids as ``tokenizers`` gives them by default: the text is cut at the file's added tokens first."""
    added = added_tokens(path)
    if not any(token in text for token in added):
        return ids_of(text, path)
    longest_first = sorted(added, key=len, reverse=True)
    found, at = [], 0
    for m in regex.finditer("|".join(map(regex.escape, longest_first)), text):
        found += [ids_of(text[at : m.start()], path), np.array([added[m.group()]], np.uint32)]
        at = m.end()
    return np.concatenate([*found, ids_of(text[at:], path)])
