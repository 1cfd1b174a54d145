"""SimHash fingerprints and the trie self-join that links them.

Fingerprints are bit strings.  Seen as a binary trie, two sets of fingerprints
are compared by walking pairs of nodes together: a pair splits into its four
pairs of children, a pair whose paths differ in more bits than allowed is
dropped with everything below it.  The first levels of that walk choose which
blocks of fingerprints meet (``block_pairs``); Spark sends the blocks there; the
walk goes on inside each task, one level at a time over arrays of node pairs.

A task returns the edges of a spanning forest of the links that it found, so a
group of g similar fingerprints gives at most g edges and not g*g links; the
components of all edges are those of all links.

Defined results: a missing text has no words; a text without words has the
fingerprint zero and is linked like any other; equal fingerprints are one node
of the trie, so repeated rows are linked; rows without an id take part but give
no component its name (a component with no id at all has none); an empty table
gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.shared import kept
from drillmark.operators.joins import spread_join

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Levels of the trie that are walked before data are sent: 6, and more above so many fingerprints a block.
BLOCK_BITS = 6
BLOCK_ROWS = 4_000_000
#: Node pairs whose subtrees hold at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 64
#: Node pairs walked at a time; the rest wait on a stack.
FRONTIER = 1 << 16

FINGERPRINT = "id long, body long, fingerprint long"


# ---------------------------------------------------------------- fingerprints


def fingerprint_of(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of all shingle hashes, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, blanks of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(len(words) - shingle, 0)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), ends[-(last + 1) :].tolist())),
        np.uint64,
        last + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in parts
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(df: DataFrame, id: str, text: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, body, fingerprint) of each row; ``body`` names the text, the fingerprint is a signed long."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(2).cast(pa.binary())
            found = [fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["id", "body", "fingerprint"],
            )

    narrow = df.select(F.col(id).cast("long").alias("id"), _body(text).alias("body"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(batches, FINGERPRINT)


def _body(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ------------------------------------------------------------- trie self-join


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sorted distinct uint64 arrays that differ in at most
    ``limit`` bits.  ``right`` None: pairs i < j within ``left``.  All of
    ``left``, and all of ``right``, agree in their first ``depth`` bits.

    Each step takes node pairs (ranges of both arrays, level, differing bits so
    far), splits both nodes at the next bit and keeps the child pairs within
    the budget.
    """
    same = right is None
    other = left if same else right
    if not len(left) or not len(other):
        return
    spent = 0 if same or depth == 0 else int(_ones((left[:1] ^ other[:1]) >> np.uint64(64 - depth))[0])
    if spent > limit:
        return
    # a frontier: bounds in left, bounds in right, level, differing bits
    stack = [tuple(np.array([v], np.int64) for v in (0, len(left), 0, len(other), depth, spent))]
    while stack:
        a, b, c, d, level, bits = stack.pop()
        if len(a) > FRONTIER:
            stack.append(tuple(x[FRONTIER:] for x in (a, b, c, d, level, bits)))
            a, b, c, d, level, bits = (x[:FRONTIER] for x in (a, b, c, d, level, bits))
        direct = ((b - a) * (d - c) <= LEAF_PAIRS) | (level >= 64)
        if direct.any():
            n, m = (b - a)[direct], (d - c)[direct]
            total = n * m
            owner = np.repeat(np.arange(len(total)), total)
            place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i = a[direct][owner] + place // m[owner]
            j = c[direct][owner] + place % m[owner]
            hit = _ones(left[i] ^ other[j]) <= limit
            if same:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit]
        go = ~direct
        if not go.any():
            continue
        a, b, c, d, level, bits = (x[go] for x in (a, b, c, d, level, bits))
        cut_l = _split(left, a, b, level)
        cut_r = _split(other, c, d, level)
        parts = []
        for lo, hi, lo2, hi2, cost in (
            (a, cut_l, c, cut_r, 0),
            (cut_l, b, cut_r, d, 0),
            (a, cut_l, cut_r, d, 1),
            (cut_l, b, c, cut_r, 1),
        ):
            good = (lo < hi) & (lo2 < hi2) & (bits + cost <= limit)
            if same:
                good &= lo < hi2  # pairs i < j only
                if cost and lo is cut_l:
                    good &= ~((a == c) & (b == d))  # the mirror image of the pair before
            if good.any():
                parts.append(tuple(x[good] for x in (lo, hi, lo2, hi2, level + 1, bits + cost)))
        if parts:
            stack.append(tuple(np.concatenate(x) for x in zip(*parts)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each range, agreeing in its first ``level`` bits, where the bit at ``level`` becomes 1."""
    shift = (63 - level).astype(np.uint64)
    bound = ((values[lo] >> shift) | np.uint64(1)) << shift
    out_lo, out_hi = lo.copy(), hi.copy()
    while True:  # binary search of all ranges together
        open_ = out_lo < out_hi
        if not open_.any():
            return out_lo
        mid = (out_lo + out_hi) >> 1
        less = open_ & (values[np.minimum(mid, len(values) - 1)] < bound)
        out_lo = np.where(less, mid + 1, out_lo)
        out_hi = np.where(open_ & ~less, mid, out_hi)


class Forest:
    """Union-find over positions; keeps the smaller position as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            while True:  # to the roots, for all pairs together
                up, vp = root[a], root[b]
                if (up == a).all() and (vp == b).all():
                    break
                a, b = up, vp
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(root, high, low)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.root
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        at = np.arange(len(root))
        apart = root != at
        return at[apart], root[apart]


def block_pairs(bits: int, limit: int) -> list[list[int]]:
    """For each block (first ``bits`` bits) the blocks at or after it within the limit."""
    return [[b for b in range(a, 1 << bits) if (a ^ b).bit_count() <= limit] for a in range(1 << bits)]


def links(nodes: DataFrame, limit: int = MAX_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Edges (a, b), a < b as unsigned, that connect what links of distinct ``fingerprint`` values connect."""
    pairs = block_pairs(block_bits, limit)
    # pair number -> (a, b); each fingerprint goes to every pair its block is part of
    numbers = {(a, b): n for n, (a, b) in enumerate((a, b) for a in range(len(pairs)) for b in pairs[a])}
    groups = [[numbers[min(a, b), max(a, b)] for b in range(len(pairs)) if (a ^ b).bit_count() <= limit] for a in range(len(pairs))]
    table = nodes.sparkSession.createDataFrame(list(enumerate(groups)), "block int, pair array<int>")
    block = F.shiftrightunsigned("fingerprint", 64 - block_bits).cast("int") if block_bits else F.lit(0)
    sent = (
        nodes.select("fingerprint", block.alias("block"))
        .join(F.broadcast(table), "block")  # 2**block_bits rows
        .select(F.explode("pair").alias("pair"), "fingerprint")
    )

    def forest(batch: pa.Table) -> pa.Table:
        values = np.sort(batch.column("fingerprint").to_numpy().view(np.uint64))
        out = _forest_of(values, block_bits, limit)
        return pa.table({"a": out[0].view(np.int64), "b": out[1].view(np.int64)})

    return sent.groupBy("pair").applyInArrow(forest, "a long, b long")


def _forest_of(values: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between the one or two blocks in ``values``."""
    top = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
    cut = int(np.searchsorted(top, top[-1])) if len(values) else 0
    forest = Forest(len(values))
    if cut == 0:
        for i, j in walk(values, None, depth, limit):
            forest.add(i, j)
    else:
        for i, j in walk(values[:cut], values[cut:], depth, limit):
            forest.add(i, j + cut)
    high, low = forest.edges()
    return values[low], values[high]


# ------------------------------------------------------------------ components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges; root is the smallest node, as signed longs.

    Alternating large-star and small-star rounds: every node points its larger,
    then its smaller neighbours at the smallest one it knows, until no edge
    changes.  Minima are taken per map task before the shuffle and joined back
    with the frequent nodes spread, so a star of any size is cut over tasks.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = kept(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            spread_join(both.filter("b > a"), smallest, ["a"], F.col("b"))
            .select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        )
        large = kept(large, "edges")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = spread_join(large, least, ["b"], F.col("a"))
        small = joined.select(F.col("m").alias("a"), "b").unionByName(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
        )
        now = kept(small.filter("a < b").distinct(), "edges")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == after:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _classes(marked: DataFrame, limit: int) -> DataFrame:
    """(fingerprint, least, root): each fingerprint with its smallest id and the root that names its class."""
    nodes = kept(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes")
    levels = max(BLOCK_BITS, math.ceil(math.log2(max(nodes.count(), 1) / BLOCK_ROWS)))
    trees = components(links(nodes, limit, levels))
    return nodes.join(trees.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component): one row per input row.

    ``component`` is the smallest id that can be reached over links of at most
    ``limit`` differing bits, the row's own included.
    """
    marked = kept(fingerprints(df, id, text, shingle), "fingerprints")
    # the root by fingerprint names the class; its smallest id names the component
    classes = _classes(marked, limit)
    named = classes.groupBy("root").agg(F.min("least").alias("component"))
    by_print = kept(spread_join(classes, named, ["root"], F.col("fingerprint")).select("fingerprint", "component"), "classes")
    return spread_join(marked, by_print, ["fingerprint"], F.coalesce("id", F.lit(0))).select("id", "fingerprint", "component")


def one_per_group(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """Exactly one row of ``df`` per near-duplicate group.

    The first row by id (a missing one last), hash of the text and hash of all
    columns stays; of rows equal in all columns any one.
    """
    marked = kept(fingerprints(df, id, text, shingle), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "body")
    by_print = marked.groupBy("fingerprint").agg(F.min(row).alias("row"))
    classes = _classes(marked, limit).select("fingerprint", "root")
    first = by_print.join(classes, "fingerprint").groupBy("root").agg(F.min("row").alias("row"))
    names = ["_none", "_id", "_body"]
    chosen = kept(first.select("row.none", "row.id", "row.body").toDF(*names), "chosen")
    inner = df.columns
    columns = [F.col(f"`{c}`") for c in inner]
    named = df.select(
        # the caller's columns may have any name, also those made here
        *[c.alias(f"_c{k}") for k, c in enumerate(columns)],
        F.col(id).isNull().alias("_none"),
        F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("_id"),
        _body(text).alias("_body"),
        F.xxhash64(*columns).alias("_row"),
    )
    # each task sends one row of equal id and text, so copies do not meet in one task
    single = named.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy("_row"))).filter("_nth = 1")
    return single.join(chosen, names).select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(inner)])
