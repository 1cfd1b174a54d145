"""JSON arrays of any size, read in pieces.

A file is read as pieces of some megabytes that may begin and end anywhere, also
inside a string or between a backslash and what it escapes.  Each piece is
scanned once without knowing where it begins: for each of the three states a
piece can begin in (outside strings, inside one, inside and escaped) it tells the
state it ends in, by how much it changes the depth of brackets, and how many
commas it holds at each depth.  Such summaries compose, so a prefix over the
pieces of a file, block by block, gives every piece its true state, its depth and
the number of the element it begins in.  Then each piece cuts itself at the commas
of depth one.  Only elements that lie in several pieces are put together again;
each element is parsed on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark.operators.barrier import staged
from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)

#: Bytes of a piece, and pieces whose summaries are composed in one task.
PIECE_BYTES = 4 << 20
BLOCK_PIECES = 1024
#: Up to this many pieces their states are broadcast: at most 5 MB.
MAX_BROADCAST_PIECES = 100_000

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b'"\\[]{},')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_BLANK = b" \t\r\n"
_CHANGE = {ord("["): 1, ord("{"): 1, ord("]"): -1, ord("}"): -1}
_OTHER = bytes(set(range(256)) - set(b"[]{},"))
_ESCAPE = re.compile(rb'\\["\\]')
#: Up to this many brackets and commas of a piece are counted one by one.
_FEW = 256
#: Bytes of elements that are handed over together.
_BATCH_BYTES = 16 << 20


# ------------------------------------------------------------------------ scan


def marks(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, characters, state at the end) of the brackets and commas outside strings."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_SPECIAL[data])
    kind = data[at]
    slashes = at[kind == _BACKSLASH]
    escaped = np.zeros(len(data) + 1, bool)
    escaped[0] = state == ESCAPED
    if len(slashes):
        begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        nth = np.arange(len(slashes)) - np.repeat(begins, np.diff([*begins, len(slashes)]))
        if state == ESCAPED and slashes[0] == 0:  # the first of this run is itself escaped
            run = slice(0, begins[1] if len(begins) > 1 else len(slashes))
            nth[run] -= 1
        escaped[slashes[nth % 2 == 0] + 1] = True
    quotes = (kind == _QUOTE) & ~escaped[at]
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    plain = ~inside & (kind != _QUOTE) & (kind != _BACKSLASH)
    ends_inside = (int(quotes.sum()) + (state != OUTSIDE)) % 2 == 1
    end = OUTSIDE if not ends_inside else ESCAPED if escaped[len(data)] else INSIDE
    return at[plain], kind[plain], end


def _told(only: bytes, end: int) -> dict:
    """The summary of the brackets and commas outside strings."""
    if len(only) <= _FEW:
        depth, top, commas = 0, 0, {}
        for char in only:
            if char == _COMMA:
                commas[depth] = commas.get(depth, 0) + 1
            else:
                depth += _CHANGE[char]
                top = max(top, depth)
        depths = sorted(commas)
        return {"ends": end, "step": depth, "top": top, "depths": depths, "commas": [commas[d] for d in depths]}
    kind = np.frombuffer(only, np.uint8)
    depth = np.cumsum(_STEP[kind])
    depths, many = np.unique(depth[kind == _COMMA], return_counts=True)
    return {"ends": end, "step": int(depth[-1]), "top": max(0, int(depth.max())), "depths": depths.tolist(), "commas": many.tolist()}


def _by_state(raw: bytes, states: tuple) -> list[dict]:
    """The summaries for states that do not escape the first byte.

    Escaped quotes and backslashes are blanked, then the stretches between quotes are outside and inside
    strings in turns: which ones come first is all that the state decides.
    """
    plain = _ESCAPE.sub(b"  ", raw) if b"\\" in raw else raw
    stretches = plain.split(b'"')
    out = []
    for state in states:
        begins = int(state != OUTSIDE)
        inside = (len(stretches) - 1 + begins) % 2 == 1
        end = OUTSIDE if not inside else ESCAPED if plain.endswith(b"\\") else INSIDE
        out.append(_told(b"".join(stretches[begins::2]).translate(None, _OTHER), end))
    return out


def summaries(raw: bytes) -> list[dict]:
    """What a piece does that begins in each state: end state, change of depth, greatest
    depth, and the commas by depth, all counted from the depth it begins at."""
    out = _by_state(raw, (OUTSIDE, INSIDE))
    if not raw:
        return [*out, _told(b"", ESCAPED)]
    # only an escaped quote or backslash makes a difference
    return [*out, _by_state(b" " + raw[1:], (INSIDE,))[0] if raw[0] in (_QUOTE, _BACKSLASH) else out[1]]


def summary(raw: bytes, state: int) -> dict:
    """What a piece does that begins in a state."""
    return summaries(raw)[state]


def composed(first: list[dict], then: list[dict]) -> list[dict]:
    """The summaries, by state, of two pieces in a row."""
    out = []
    for a in first:
        b = then[a["ends"]]
        commas = dict(zip(a["depths"], a["commas"]))
        for depth, many in zip(b["depths"], b["commas"]):
            commas[depth + a["step"]] = commas.get(depth + a["step"], 0) + many
        out.append(
            {"ends": b["ends"], "step": a["step"] + b["step"], "top": max(a["top"], a["step"] + b["top"]), "depths": list(commas), "commas": list(commas.values())}
        )
    return out


#: Where a piece begins: state, depth, elements before, whether the array was opened.
START = (OUTSIDE, 0, 0, False)


def advanced(start: tuple, by_state: list[dict]) -> tuple:
    """Where the next piece begins."""
    state, depth, index, opened = start
    found = by_state[state]
    commas = dict(zip(found["depths"], found["commas"]))
    return found["ends"], depth + found["step"], index + commas.get(1 - depth, 0), opened or depth + found["top"] >= 1


def cut(raw: bytes, start: tuple) -> Iterator[tuple[int, bytes, bool, bool, bool]]:
    """(element, its bytes, begins here, ends here, is the last) of a piece.

    Anything but blanks outside the array raises; one closing brace may follow it,
    which ``file_pieces`` adds to every file.
    """
    state, depth, index, opened = start
    at, kind, _ = marks(raw, state)
    after = depth + np.cumsum(_STEP[kind])
    top = ((kind == _COMMA) & (after == 1)) | ((kind == ord("[")) & (after == 1)) | ((_STEP[kind] < 0) & (after == 0))
    first, begun, free = (0, False, 0) if depth >= 1 else (None, False, 0)
    for place, char in zip(at[top].tolist(), kind[top].tolist()):
        if char == ord("["):
            if first is not None or opened or raw[free:place].strip(_BLANK):
                raise ValueError("more than one array")
            first, begun, opened = place + 1, True, True
            continue
        if first is None:
            raise ValueError("text outside the array")
        yield index, raw[first:place], begun, True, char != _COMMA
        if char == _COMMA:
            index, first, begun = index + 1, place + 1, True
        else:
            first, free = None, place + 1
    if first is not None:
        yield index, raw[first:], begun, False, False
    elif raw[free:].strip(_BLANK) not in (b"", b"}"):
        raise ValueError("text outside the array")


# ---------------------------------------------------------------------- pieces


def file_pieces(spark: SparkSession, paths) -> DataFrame:
    """(source_file, part, block, value, size): the bytes of files in pieces, in order of ``part``.

    Lines are read up to closing braces, which splits long lines; every piece ends
    with one, so a file gets one more than it has.
    """
    lines = spark.read.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )
    schema = "source_file string, part long, block long, value binary, size long"
    piece, span = PIECE_BYTES, PIECE_BYTES * BLOCK_PIECES

    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, body, held = None, [], 0  # (file, split, size, bytes of the split before), lines

        def told() -> pa.RecordBatch:
            file, split, size, before = now
            part = split + before
            return pa.RecordBatch.from_pydict(
                {"source_file": [file], "part": pa.array([part], pa.int64()), "block": pa.array([part // span], pa.int64()),
                 "value": pa.array([b"}".join(body) + b"}"], pa.binary()), "size": pa.array([size], pa.int64())}
            )

        for batch in rows:
            for file, split, size, value in zip(*(batch.column(c).to_pylist() for c in ("source_file", "split", "size", "value"))):
                if now is not None and ((file, split) != now[:2] or held >= piece):
                    yield told()
                    now = (file, split, size, now[3] + held if (file, split) == now[:2] else 0)
                    body, held = [], 0
                elif now is None:
                    now = (file, split, size, 0)
                body.append(value)
                held += len(value) + 1
        if body:
            yield told()

    return lines.mapInArrow(joined, schema)


_SUMMARY = "struct<ends:int,step:long,top:long,depths:array<long>,commas:array<long>>"
_PLACED = "source_file string, part long, state int, depth long, element long, opened boolean"


def _unreadable(file: str, why: str) -> ValueError:
    return ValueError(f"Not readable as one JSON array: {file} ({why})")


def starts(pieces: DataFrame) -> DataFrame:
    """(source_file, part, state, depth, element, opened): where each piece begins.

    ``pieces``: (source_file, part, block, value[, size]); blocks are runs of
    pieces.  A task composes a block, and one row per block goes to the task of
    its file.  A file that does not end outside its array stops the job.
    """
    sized = "size" in pieces.columns
    shown = pieces if sized else pieces.withColumn("size", F.lit(None).cast("long"))
    schema = f"source_file string, part long, block long, size long, bytes long, by_state array<{_SUMMARY}>"
    kinds = pa.list_(pa.struct([("ends", pa.int32()), ("step", pa.int64()), ("top", pa.int64()), ("depths", pa.list_(pa.int64())), ("commas", pa.list_(pa.int64()))]))

    placed = ["state", "depth", "element", "opened"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = [v or b"" for v in batch.column("value").to_pylist()]
            found = [summaries(v) for v in values]
            names = ["source_file", "part", "block", "size"]
            out = batch.select(names).append_column("bytes", pa.array([len(v) for v in values], pa.int64()))
            yield out.append_column("by_state", pa.array(found, kinds))

    told = staged(shown.select("source_file", "part", "block", "size", "value").mapInArrow(scanned, schema))

    def whole(table: pa.Table) -> list[dict]:
        rows = table.sort_by("part").to_pylist()
        out = rows[0]["by_state"]
        for row in rows[1:]:
            out = composed(out, row["by_state"])
        return out

    def of_block(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).select(["source_file", "block", "size"])
        row = row.append_column("bytes", pa.array([sum(table.column("bytes").to_pylist())], pa.int64()))
        return row.append_column("by_state", pa.array([whole(table)], kinds))

    blocks = told.groupBy("source_file", "block").applyInArrow(
        of_block, f"source_file string, block long, size long, bytes long, by_state array<{_SUMMARY}>"
    )

    def of_file(table: pa.Table) -> pa.Table:
        rows, start, out = table.sort_by("block").to_pylist(), START, []
        for row in rows:
            out.append((row["source_file"], row["block"], *start))
            start = advanced(start, row["by_state"])
        state, depth, _, opened = start
        added = 1 if sized else 0
        if not opened or state != OUTSIDE or depth != -added or (sized and sum(r["bytes"] for r in rows) != rows[0]["size"] + added):
            raise _unreadable(rows[0]["source_file"], "the array does not end")
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["of", "at", *placed])

    begun = blocks.groupBy("source_file").applyInArrow(
        of_file, "of string, at long, state int, depth long, element long, opened boolean"
    )

    def of_piece(key, table: pa.Table, begun: pa.Table) -> pa.Table:
        first = begun.to_pylist()[0]
        start, out = (first["state"], first["depth"], first["element"], first["opened"]), []
        for row in table.sort_by("part").to_pylist():
            out.append((row["source_file"], row["part"], *start))
            start = advanced(start, row["by_state"])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["source_file", "part", *placed])

    return told.groupBy("source_file", "block").cogroup(begun.groupBy("of", "at")).applyInArrow(of_piece, _PLACED)


def array_elements(pieces: DataFrame, few: bool = False) -> DataFrame:
    """(source_file, record_index, value): the elements of the arrays, as texts.

    With ``few``, known from a file listing, the states of the pieces are broadcast
    and the pieces themselves are never shuffled.
    """
    known = starts(pieces)
    placed = pieces.select("source_file", "part", "value").join(F.broadcast(known) if few else known, ["source_file", "part"])
    schema = "source_file string, record_index long, part long, body binary, whole boolean, last boolean"

    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]
    names = ["source_file", "record_index", "part", "body", "whole", "last"]

    def elements(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in rows:
            columns = (batch.column(c) for c in ("source_file", "part", "value", "state", "depth", "element", "opened"))
            for file, part, value, *start in zip(*columns):
                file, part, raw, start = file.as_py(), part.as_py(), value.as_py() or b"", tuple(x.as_py() for x in start)
                try:
                    for index, body, begins, ends, last in cut(raw, start):
                        out.append((file, index, part, body, begins and ends, last))
                except ValueError as error:
                    raise _unreadable(file, str(error)) from None
                held += len(raw)
                if held >= _BATCH_BYTES:
                    if out:
                        yield told()
                    out, held = [], 0
        if out:
            yield told()

    found = staged(placed.mapInArrow(elements, schema))
    ordered = F.array_sort(F.collect_list(F.struct("part", "body")))
    glued = F.aggregate(F.transform(ordered, lambda x: x["body"]), F.lit(b""), lambda a, b: F.concat(a, b))
    key = ["source_file", "record_index"]
    parts = found.filter(~F.col("whole")).groupBy(*key).agg(glued.alias("body"), F.bool_or("last").alias("last"))
    every = found.filter("whole").select(*key, "body", "last").unionByName(parts)
    text = F.col("body").cast("string")
    # the one element of an array without any is blank
    none = (F.col("record_index") == 0) & F.col("last") & (F.trim(F.translate(text, "\t\r\n", "   ")) == "")
    return every.filter(~none).select(*key, text.alias("value"))


def read_array_elements(spark: SparkSession, paths) -> DataFrame:
    """The elements of JSON-array files of any size."""
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length")
    told = sizes.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.min_by("path", "length").alias("least"), F.min("length").alias("fewest")).first()
    if not told["files"] or not told["fewest"]:
        raise _unreadable(told["least"] or str(paths), "no bytes")
    pieces = file_pieces(spark, paths)
    most = told["bytes"] // PIECE_BYTES + told["files"] + spark.read.text(paths).rdd.getNumPartitions()
    return array_elements(pieces, most <= MAX_BROADCAST_PIECES)
