"""Approximate nearest neighbours by a forest of hash prefixes.

A tree hashes a vector to a long string of bits, one per direction: on which
side of the sample's median the vector lies.  Its sorted array of strings is the
tree; rows that share a prefix lie next to each other.  A query descends each
tree to its longest match and then ascends all trees together, one bit at a
time, until the rows below it, summed over the trees, are ``share`` times all
rows (and at least as many as are asked for).  All of them, however many share a prefix, are compared by distance.

Rows are dealt into segments of about ``SEGMENT_ROWS`` by a hash, each a forest
of its own, so that no task holds a whole tree; queries meet each segment in
blocks.  A segment returns the best of its rows per query, which are merged.

Directions and medians are fitted on a sample of at most ``SAMPLE_ROWS`` rows, by
the order of a hash; every row is indexed.

Defined results: vectors that are missing, zero, hold missing or non-finite
components, or are not of the most frequent length (the greatest, if several)
take no part, nor do rows without an id; rows equal in id and vector are one; a
row is no neighbour of its own id; equal distances are ordered by id; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.shared import kept

TREES = 64
BITS = 32
#: Rows below the query, summed over the trees, in multiples of all rows.
SHARE = 1.5
SEGMENT_ROWS = 16_384
QUERY_BLOCK = 1_024
SAMPLE_ROWS = 8_192
SEED = 7


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    size = sizes.first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


class Forest:
    """Directions and medians of all trees."""

    def __init__(self, sample: np.ndarray, trees: int, bits: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.trees, self.bits = trees, bits
        turns = []
        while sum(t.shape[1] for t in turns) < trees * bits:  # orthogonal directions, a rotation at a time
            turns.append(np.linalg.qr(rng.normal(size=(size, size)))[0])
        self.directions = np.concatenate(turns, axis=1)[:, : trees * bits]
        self.medians = np.median(sample @ self.directions, axis=0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows): the bit strings as numbers of ``bits`` bits."""
        out = np.empty((self.trees, len(vectors)), np.uint64)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for t in range(self.trees):
            part = slice(t * self.bits, (t + 1) * self.bits)
            out[t] = ((vectors @ self.directions[:, part]) > self.medians[part]) @ weights
        return out


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, forest: Forest, share: float, k: int):
    """(query, row, distance) of the best ``k`` of the rows for each query."""
    strings = forest.strings(rows)
    order = np.argsort(strings, axis=1, kind="stable")
    arrays = np.take_along_axis(strings, order, axis=1)
    asked = forest.strings(queries)
    goal = share * len(rows) + forest.trees * (k + 1)  # so at least k rows besides the query's own
    # ascend: the ranges of all trees at each depth, until they hold enough
    depth = np.full(len(queries), -1)
    for level in range(forest.bits, -1, -1):
        open_ = np.flatnonzero(depth < 0)
        if not len(open_):
            break
        low, high = _ranges(arrays, asked[:, open_], level, forest.bits)
        depth[open_[((high - low).sum(axis=0) >= goal) | (level == 0)]] = level
    for q in range(len(queries)):
        low, high = _ranges(arrays, asked[:, q : q + 1], int(depth[q]), forest.bits)
        found = np.zeros(len(rows), bool)
        for t in range(forest.trees):
            found[order[t, low[t, 0] : high[t, 0]]] = True
        found &= ids != query_ids[q]
        at = np.flatnonzero(found)
        distance = np.sqrt(((rows[at] - queries[q]) ** 2).sum(axis=1))
        if len(at) > k:  # all that tie with the k-th go into the exact order
            near = distance <= np.partition(distance, k - 1)[k - 1]
            at, distance = at[near], distance[near]
        best = np.lexsort((ids[at], distance))[:k]
        yield q, at[best], distance[best]


def _ranges(arrays: np.ndarray, asked: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows that share ``level`` bits with the queries begin and end in each tree."""
    shift = np.uint64(bits - level)
    first = (asked >> shift) << shift
    last = first + ((np.uint64(1) << shift) - np.uint64(1))
    low = np.stack([np.searchsorted(a, f, "left") for a, f in zip(arrays, first)])
    high = np.stack([np.searchsorted(a, f, "right") for a, f in zip(arrays, last)])
    return low, high


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = kept(usable(df, id, vector).distinct(), "vectors")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().column("v")
    out = "query_id long, vec_id long, score double"
    if not counts["rows"] or not counts["queries"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(_matrix(sample), trees, bits)
    segments = math.ceil(counts["rows"] / SEGMENT_ROWS)
    blocks = math.ceil(counts["queries"] / QUERY_BLOCK)
    name = F.xxhash64("vec_id", "v")
    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    every_segment = F.sequence(F.lit(0), F.lit(segments - 1))
    index = rows.select("vec_id", "v", F.pmod(name, F.lit(segments)).cast("int").alias("segment"), F.explode(every_block).alias("block"))
    asked = rows.filter(is_query).select(
        "vec_id", "v", F.explode(every_segment).alias("segment"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    )

    def meet(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and asked.num_rows:
            ids, query_ids = index.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            for q, at, distance in search(_matrix(index.column("v")), ids, _matrix(asked.column("v")), query_ids, forest, share, k):
                found.append((np.full(len(at), query_ids[q]), ids[at], distance))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    by = ["segment", "block"]
    best = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, out)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
