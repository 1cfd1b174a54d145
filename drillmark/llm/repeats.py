"""Removal of long word sequences that occur more than once (recompression).

A text is a sequence of word names (64-bit hashes).  A round of recompression
cuts the alphabet into left and right symbols by a bit of their names and names
every pair (left, right) of neighbours anew.  Names are functions of content,
so all tasks give equal pairs equal names without asking each other.  Whether
two neighbours become one symbol depends on the two alone: inside two equal
passages the parse differs at most by one symbol of the round before at each
end.  After ``r`` rounds a symbol has at most 2**r words, so the parses of equal
passages agree from word 2**r - 1 on.

A symbol is never left and right at once, so a run of one symbol is not paired
but stays in the parse as it is; the phrases inside a run have one name and are
sent as one row with all their places.

Two Spark rounds follow the local ones.

1. *Reveal.*  Each boundary of the high-level parse is the start of a phrase of
   ``window - 2**r + 1`` words.  Every window of ``window`` words holds the whole
   phrase of some boundary in its first 2**r words, at the same place in each
   occurrence.  Parses that agree at a boundary agree at all later ones that the
   window's end is far enough from, so the last boundary in the first 2**r words
   is such a one.  Phrases are counted by name; a window whose phrase at that
   last boundary occurs once occurs once.
2. *Verify.*  The windows whose last phrase occurs again are counted by the two
   independent 64-bit names of their words.

Each map task sends one row per name and block of rows with the places packed,
so a passage in a third of all documents reaches its reducer as a few rows.

Defined results: a missing text has no words; texts shorter than a window keep
all words; repeated rows repeat each other's windows; an empty table gives no
rows.  Ids need not be unique or present: rows are told apart by id and a digest
of their text, and rows equal in both lose the same words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmark.llm.shared import kept

WINDOW = 35
ROUNDS = 4
#: Words of the texts that are parsed together; a longer text is parsed alone.
BLOCK_WORDS = 1 << 17

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# ------------------------------------------------------------------ local work


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit names."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair (a, b)."""
    return _mix(_mix(a) * np.uint64(3) + b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def parse(names: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of each symbol after the rounds; no symbol spans two owners."""
    start = np.arange(len(names))
    symbols, own = names, owner
    for k in range(rounds):
        if len(symbols) < 2:
            break
        right = (_mix(symbols ^ np.uint64(k + 1)) >> np.uint64(63)).astype(bool)
        joined = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        named = symbols.copy()
        at = np.flatnonzero(joined)
        named[at] = _pair(symbols[at], symbols[at + 1])
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, start, own = named[stay], start[stay], own[stay]
    return start, symbols


def rolling(names: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Name of the ``length`` words from each position on (that many positions fewer, plus one)."""
    if len(names) < length:
        return np.empty(0, np.uint64)
    base = np.uint64(_SEEDS[seed])
    # names of 1, 2, 4, ... words, put together by the bits of the length
    out, done, power, size, factor = None, 0, _mix(names + base), 1, base
    while True:
        if length & size:
            part = power[done : done + len(names) - length + 1]
            out = part.copy() if out is None else out * factor + part
            done += size
        size *= 2
        if size > length:
            return _mix(out)
        power = power[: len(power) - size // 2] * factor + power[size // 2 :]
        with np.errstate(over="ignore"):
            factor = factor * factor


def _named_blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows of a batch in blocks of about BLOCK_WORDS words: rows, their numbers of
    words, the names of all words.  Only one text's words are held at a time."""
    rows, names, words = [], [], 0

    def told():
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        return rows, sizes, np.concatenate(names)

    texts = batch.column("text").cast(pa.binary())
    for k, text in enumerate(texts):
        rows.append(k)
        names.append(word_names(text.as_buffer().to_pybytes().split() if text.is_valid else []))
        words += len(names[-1])
        if words >= BLOCK_WORDS:
            yield told()
            rows, names, words = [], [], 0
    if rows:
        yield told()


# ---------------------------------------------------------------- Spark rounds


def _reveal(window: int, rounds: int):
    phrase = window - (1 << rounds) + 1

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at, sizes, names in _named_blocks(batch):
                if sizes.max(initial=0) < window:
                    continue
                owner = np.repeat(np.arange(len(sizes)), sizes)
                start, _ = parse(names, owner, rounds)
                base = np.cumsum(sizes) - sizes
                whole = start + phrase <= (base + sizes)[owner[start]]
                start = start[whole & (sizes[owner[start]] >= window)]
                key = rolling(names, phrase)[start].view(np.int64)
                yield _sent(batch, at, key, None, owner[start], start - base[owner[start]])

    return batches


def _sent(batch, at, key, check, owner, place) -> pa.RecordBatch:
    """Rows (key, check, n, ids, digests, places): one per key, all its occurrences in the block."""
    order = np.lexsort((place, owner, key)) if check is None else np.lexsort((place, owner, check, key))
    key, owner, place = key[order], owner[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if check is not None:
        check = check[order]
        new[1:] |= check[1:] != check[:-1]
    first = np.flatnonzero(new)
    offsets = pa.array(np.r_[first, len(key)].astype(np.int32))
    rows = pa.array(np.asarray(at, np.int64)[owner])
    docs = pa.ListArray.from_arrays(offsets, batch.column("doc").take(rows))
    places = pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))
    columns = {"key": pa.array(key[first])}
    if check is not None:
        columns["check"] = pa.array(check[first])
    return pa.RecordBatch.from_pydict(columns | {"docs": docs, "places": places})


def _again(names: list[str]):
    """Of rows sorted by ``names``: the occurrences of those that occur more than once."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, not yet known to occur again
        last = None  # its name; ``seen`` tells whether the name occurred again already
        seen = False
        for batch in rows:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = [batch.column(n).to_numpy() for n in names]
            n = batch.num_rows
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            head = tuple(k[0] for k in keys)
            new[0] = head != last
            counts = pc.list_value_length(batch.column("places")).to_numpy()
            group = np.cumsum(new) - (1 if new[0] else 0) if n else np.empty(0, np.int64)
            # group 0 goes on from the batch before when new[0] is false
            total = np.bincount(group, minlength=group[-1] + 1)
            places = np.bincount(group, weights=counts, minlength=group[-1] + 1)
            twice = (total > 1) | (places > 1)
            if not new[0]:
                twice[0] = True
                if held is not None and not seen:
                    yield held
            elif held is not None and not seen:
                pass  # occurred once
            good = twice[group]
            if good.any():
                yield table.filter(pa.array(good)).select(["docs", "places"]).combine_chunks().to_batches()[0]
            seen = bool(good[-1])
            last = tuple(k[-1] for k in keys)
            held = None if seen else batch.slice(n - 1, 1).select(["docs", "places"])

    return batches


def _verify(window: int, rounds: int):
    reach = 1 << rounds

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at, sizes, names in _named_blocks(batch):
                base = np.cumsum(sizes) - sizes
                found = [batch.column("places")[k].values.to_numpy() + b for k, b in zip(at, base)]
                owner = np.repeat(np.arange(len(sizes)), [len(f) for f in found])
                place = np.concatenate(found).astype(np.int64)
                of = np.repeat(np.arange(len(sizes)), sizes)
                # the last boundary up to each word; every text begins with one
                cut = np.zeros(len(names), np.int64)
                bounds = parse(names, of, rounds)[0]
                cut[bounds] = bounds
                last = np.maximum.accumulate(cut)
                again = np.zeros(len(names), bool)
                again[place] = True
                # a window starts at least ``window`` words before its text's end
                start = np.flatnonzero(np.arange(len(names)) + window <= (base + sizes)[of])
                end = last[start + reach - 1]
                start = start[(end >= start) & again[end]]
                if not len(start):
                    continue
                key, check = (rolling(names, window, s)[start].view(np.int64) for s in (0, 1))
                yield _sent(batch, at, key, check, of[start], start - base[of[start]])

    return batches


def _merged(lists: DataFrame) -> DataFrame:
    """(doc, places): all places of a document, each once."""
    pairs = lists.select(F.explode(F.arrays_zip("docs", "places")).alias("at"))
    return pairs.select("at.docs", "at.places").groupBy(F.col("docs").alias("doc")).agg(F.collect_set("places").alias("places"))


def _spans(window: int):
    """Starts of repeated windows as covered spans [from, to) of a document."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for places in batch.column("places"):
                start = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.diff(start) > window) + 1
                out.append(np.c_[start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]] + window].ravel())
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "spans": pa.array(out, pa.list_(pa.int32()))})

    return batches


def repeated_spans(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``texts`` has (doc, id, text) per row, ``spans`` has
    (doc, spans) for the documents that lose words, word numbers as from, to, from, to, ..."""
    rounds = min(ROUNDS, max(0, (window + 1).bit_length() - 2))
    texts = df.select(
        F.xxhash64(F.col(id), F.col(text)).alias("doc"), F.col(id).alias("id"), F.col(text).cast("string").alias("text")
    )
    spark = df.sparkSession
    phrases = texts.select("doc", "text").mapInArrow(_reveal(window, rounds), "key long, docs array<long>, places array<int>")
    again = phrases.repartition("key").sortWithinPartitions("key").mapInArrow(_again(["key"]), "docs array<long>, places array<int>")
    revealed = kept(_merged(again), "phrases")
    around = texts.select("doc", "text").join(revealed, "doc").mapInArrow(
        _verify(window, rounds), "key long, check long, docs array<long>, places array<int>"
    )
    verified = (
        around.repartition("key").sortWithinPartitions("key", "check")
        .mapInArrow(_again(["key", "check"]), "docs array<long>, places array<int>")
    )
    spans = kept(_merged(verified).mapInArrow(_spans(window), "doc long, spans array<int>"), "spans")
    return texts, spans


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _kept_words(words: list[bytes], spans: list[int]) -> list[bytes]:
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out += words[at:a]
        at = b
    return out + words[at:]


def digests(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, words, removed words and the SHA-256 of the words left, joined by one blank."""
    texts, spans = repeated_spans(df, id, text, window)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            total, removed, digest = [], [], []
            for body, cut in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
                words = body.as_buffer().to_pybytes().split() if body.is_valid else []
                left = _kept_words(words, cut.as_py()) if cut.is_valid else words
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id").cast(pa.int64()), "n_words": pa.array(total, pa.int64()),
                 "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            )

    return texts.join(spans, "doc", "left").mapInArrow(
        batches, "id long, n_words long, n_removed long, kept_sha256 string"
    )


def cut_spans(body: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and the blanks that follow them."""
    starts = [m.start() for m in _WORD.finditer(body)] + [len(body)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(body[at : starts[a]])
        at = starts[b]
    return b"".join([*out, body[at:]])


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` with their repeated passages cut out of the text."""
    _, spans = repeated_spans(df, id, text, window)

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [b if s is None or b is None else cut_spans(b.encode(), list(s)).decode() for b, s in zip(bodies, spans)],
            dtype=object,
        )

    inner = df.columns
    keyed = df.select(
        F.xxhash64(F.col(id), F.col(text)).alias("_doc"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(inner)]
    )
    body = f"_c{inner.index(text)}"
    joined = keyed.join(spans.withColumnRenamed("doc", "_doc"), "_doc", "left")
    return joined.withColumn(body, F.when(F.col("spans").isNull(), F.col(body)).otherwise(cut(body, "spans"))).select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(inner)]
    )
