"""Hard negatives by a multiway tree of split points with distance ranges.

The score of two rows is the inner product of their vectors.  With ``M`` the
longest length of any vector, a further component ``sqrt(M^2 - |x|^2)`` gives all
rows the length ``M``, and an anchor (with a zero there) the distance
``|q|^2 + M^2 - 2 * score`` squared: a window of scores is a window of distances,
an annulus around the anchor.

The tree: a node has some split points, every row belongs to the nearest one, and
each split point stores the least and greatest distance to the rows of every
sibling subtree.  A subtree goes when, for one split point, its range and the
annulus around the anchor cannot meet.  The first level is made by Spark: at most
``SUBTREES`` split points, ranges by an aggregate over all rows, subtrees in
segments of about ``SEGMENT_ROWS`` rows dealt by a hash, however large one is.
Each segment is a tree of its own inside a task, down to leaves in which the
scores are computed exactly.

An anchor first searches the segment of the split point it is nearest to.  What
it finds there narrows its annulus, and only the segments that the annulus meets
are searched next.  Both searches, for the positives and for the negatives, go
that way.  Distances have a slack for rounding; scores are integers and exact.

Split points are fitted on a sample of at most ``SAMPLE_ROWS`` rows, by the order
of a hash; every row is indexed.

Defined results: rows without an id, label or vector, with missing or non-finite
components, or not of the most frequent length (the greatest, if several) take no
part; zero vectors do.  Rows equal in id, label and vector are one; a row is no
partner of its own id.  Equal scores are ordered by id.  A window whose lower end
lies above its upper one (a negative positive score) is empty.  Vectors so long
that a score might leave 55 bits stop the job.  An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.shared import kept

SEGMENT_ROWS = 8_192
SUBTREES = 128
SAMPLE_ROWS = 8_192
#: Split points of a node inside a segment, and rows of a leaf.
FANOUT = 8
LEAF_ROWS = 256
#: Subtrees stop here; what is left is one leaf.
DEPTH = 40
#: Windows searched at a time, and windows that meet a segment in one group.
WINDOW_RUN = 2_048
WINDOW_BLOCK = 65_536
#: Windows compared with all ranges of the first level at a time.
ROUTED = 128
#: Slack of distances, relative to them and to the longest vector.
SLACK = 1e-6

LOWEST, HIGHEST = -(2**63), 2**63 - 1


def usable(df: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """(id, label, v): the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~bad & (F.size("v") > 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    return rows.filter(F.size("v") == (size["n"] if size else 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as 64-bit integers."""
    size = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if size < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def between(a: np.ndarray, b: np.ndarray, squared_a: np.ndarray, squared_b: np.ndarray) -> np.ndarray:
    """Distances of two sets of vectors."""
    return np.sqrt(np.maximum(squared_a[:, None] + squared_b[None, :] - 2.0 * (a @ b.T), 0.0))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that gives all of them the length ``sqrt(longest)``."""
    rest = np.maximum(longest - (vectors * vectors).sum(axis=1), 0.0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


# ------------------------------------------------------------------------ tree


@dataclass
class Node:
    """Split points, what they know of each subtree, and the subtrees; or the rows of a leaf."""

    rows: np.ndarray
    points: np.ndarray | None = None
    nearest: np.ndarray | None = None  # least distance of split point i to subtree j
    farthest: np.ndarray | None = None
    subtrees: list | None = None


def spread_points(vectors: np.ndarray, many: int) -> np.ndarray:
    """Numbers of rows far from each other, chosen one by one; fewer if rows repeat."""
    chosen = [int(np.argmax(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))]
    least = ((vectors - vectors[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < many and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def ranges(distance: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(split points, subtrees): least and greatest distance of each split point to the rows of each subtree."""
    low, high = np.full((distance.shape[1], many), np.inf), np.full((distance.shape[1], many), -np.inf)
    for j in np.unique(owner):
        part = distance[owner == j]
        low[:, j], high[:, j] = part.min(axis=0), part.max(axis=0)
    return low, high


def grown(vectors: np.ndarray, rows: np.ndarray, fanout: int, leaf: int, depth: int = 0) -> Node:
    """The tree over some rows of lifted vectors."""
    if len(rows) <= leaf or depth == DEPTH:
        return Node(rows)
    step = max(1, len(rows) // 1024)  # split points are sought among some of the rows
    points = rows[::step][spread_points(vectors[rows[::step]], fanout)]
    own, squared = vectors[points], (vectors[rows] ** 2).sum(axis=1)
    distance = between(vectors[rows], own, squared, (own**2).sum(axis=1))
    owner = distance.argmin(axis=1)
    sizes = np.bincount(owner, minlength=len(points))
    if sizes.max() == len(rows):  # nothing to split, as when rows repeat
        return Node(rows)
    low, high = ranges(distance, owner, len(points))
    return Node(rows, own, low, high, [grown(vectors, rows[owner == j], fanout, leaf, depth + 1) for j in range(len(points))])


def meets(distance: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray, longest: float) -> np.ndarray:
    """(anchors, subtrees): whether the annulus of an anchor can hold a row of the subtree.

    A row of subtree j lies between ``low[i, j]`` and ``high[i, j]`` from split
    point i, so between ``max(low - d, d - high)`` and ``d + high`` from an anchor
    at distance d from that point.
    """
    least = np.maximum(low[None] - distance[:, :, None], distance[:, :, None] - high[None]).max(axis=1)
    most = (distance[:, :, None] + high[None]).min(axis=1)
    slack = SLACK * (1.0 + math.sqrt(longest) + outer)
    return (least <= (outer + slack)[:, None]) & (most >= (inner - slack)[:, None]) & np.isfinite(low[0])[None]


class Asked:
    """Windows of some anchors, with the best rows found so far; ``of`` is the place of a window's anchor."""

    def __init__(self, anchors, ids, labels, of, low, high, longest: float, same: bool, k: int):
        self.anchors, self.ids, self.labels, self.of = anchors, ids, labels, of
        self.low, self.high, self.same, self.k = low, high, same, k
        self.squared = (anchors * anchors).sum(axis=1)
        self.longest = longest
        self.score = np.full((len(of), k), LOWEST, np.int64)
        self.row = np.full((len(of), k), HIGHEST, np.int64)

    def annulus(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer distance of the windows, as narrow as what was found allows."""
        floor = np.maximum(self.low[some], self.score[some, -1])
        base = self.squared[self.of[some]] + self.longest
        inner = np.sqrt(np.maximum(base - 2.0 * self.high[some], 0.0))
        outer = np.sqrt(np.maximum(base - 2.0 * floor, 0.0))
        return inner, outer

    def take(self, some: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Exact comparison of the windows ``some`` with the rows of a leaf."""
        own, place = np.unique(self.of[some], return_inverse=True)
        found = scores(self.anchors[own], vectors)
        kin = labels[None, :] == self.labels[own][:, None]
        usable = (kin if self.same else ~kin) & (ids[None, :] != self.ids[own][:, None])
        found = found[place]
        floor = np.maximum(self.low[some], self.score[some, -1])
        good = usable[place] & (found >= floor[:, None]) & (found <= self.high[some][:, None])
        w, r = np.nonzero(good)
        if not len(w):
            return
        touched = np.unique(w)
        window = np.concatenate([some[w], np.repeat(some[touched], self.k)])
        score = np.concatenate([found[w, r], self.score[some[touched]].ravel()])
        row = np.concatenate([ids[r], self.row[some[touched]].ravel()])
        order = np.lexsort((row, ~score, window))  # ~ turns the order of integers round
        window, score, row = window[order], score[order], row[order]
        first = np.flatnonzero(np.diff(window, prepend=-1))
        rank = np.arange(len(window)) - np.repeat(first, np.diff([*first, len(window)]))
        keep = rank < self.k
        self.score[window[keep], rank[keep]] = score[keep]
        self.row[window[keep], rank[keep]] = row[keep]


def search(node: Node, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: Asked, some: np.ndarray) -> None:
    """Every row below the node that may be in the windows ``some`` is compared."""
    if node.subtrees is None:
        asked.take(some, vectors[node.rows], ids[node.rows], labels[node.rows])
        return
    own, place = np.unique(asked.of[some], return_inverse=True)
    flat = np.concatenate([asked.anchors[own], np.zeros((len(own), 1))], axis=1)
    distance = between(flat, node.points, asked.squared[own], (node.points**2).sum(axis=1))[place]
    for j in np.argsort(distance.mean(axis=0)):
        column = slice(j, j + 1)
        live = np.flatnonzero(meets(distance, node.nearest[:, column], node.farthest[:, column], *asked.annulus(some), asked.longest)[:, 0])
        if len(live):
            search(node.subtrees[j], vectors, ids, labels, asked, some[live])


# ---------------------------------------------------------------------- tables


@dataclass
class Level:
    """The first level of the tree."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # first segment of each subtree
    many: np.ndarray  # segments of each subtree
    longest: float


@dataclass
class Index:
    """All rows in segments (id, label, v, segment), and the first level."""

    rows: DataFrame
    level: Level


def indexed(rows: DataFrame) -> Index | None:
    """Split points, ranges and segments of the usable rows; None without rows."""
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("v", F.abs))
    told = rows.agg(F.count("*").alias("n"), F.max(squared).alias("longest"), F.max(largest).alias("most"), F.max(F.size("v")).alias("size")).first()
    if not told["n"]:
        return None
    if told["size"] * told["most"] ** 2 >= 2.0**55:
        raise ValueError("inner products of these vectors do not fit 55 bits")
    longest = float(told["longest"])
    sample = rows.orderBy(F.xxhash64("id", "v"), "id", "label").limit(SAMPLE_ROWS).select("v").toArrow().column("v")
    vectors = lifted(_matrix(sample), longest)
    points = vectors[spread_points(vectors, min(SUBTREES, math.ceil(told["n"] / SEGMENT_ROWS)))]

    lengths = (points**2).sum(axis=1)

    def away(batch: pa.RecordBatch) -> np.ndarray:
        own = lifted(_matrix(batch.column("v")), longest)
        return between(own, points, (own**2).sum(axis=1), lengths)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("subtree", pa.array(away(batch).argmin(axis=1), pa.int32()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(points)
        low, high, count = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                owner = batch.column("subtree").to_numpy()
                some = ranges(away(batch), owner, n)
                low, high = np.minimum(low, some[0]), np.maximum(high, some[1])
                count += np.bincount(owner, minlength=n)
        point, subtree = np.nonzero(np.isfinite(low))
        columns = [point.astype(np.int32), subtree.astype(np.int32), low[point, subtree], high[point, subtree], count[subtree]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["point", "subtree", "low", "high", "n"])

    found = kept(rows.mapInArrow(owned, "id long, label long, v array<double>, subtree int"), "subtrees")
    told = found.mapInArrow(spans, "point int, subtree int, low double, high double, n long").groupBy("point", "subtree")
    told = told.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    low, high = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
    sizes = np.zeros(len(points), np.int64)
    for r in told.collect():  # at most SUBTREES squared
        low[r["point"], r["subtree"]], high[r["point"], r["subtree"]] = r["low"], r["high"]
        sizes[r["subtree"]] = r["n"]
    many = np.maximum(1, -(-sizes // SEGMENT_ROWS))
    first = np.cumsum(many) - many
    start = F.array(*[F.lit(int(x)) for x in first])
    parts = F.array(*[F.lit(int(x)) for x in many])
    segment = F.element_at(start, F.col("subtree") + 1) + F.pmod(F.xxhash64("id", "v"), F.element_at(parts, F.col("subtree") + 1))
    placed = found.select("id", "label", "v", segment.cast("long").alias("segment"))
    return Index(placed, Level(points, low, high, first, many, longest))


_WINDOWS = "id long, label long, v array<double>, anchor long, window long, low long, high long"
_FOUND = "id long, window long, partner long, score long"


def routed(windows: DataFrame, level: Level, home: bool) -> DataFrame:
    """The windows once per segment they must be searched in: of all subtrees that
    the annulus meets, the home segment alone or all but that one."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (level.points**2).sum(axis=1)
        for whole in rows:
            for at in range(0, whole.num_rows, ROUTED):
                batch = whole.slice(at, ROUTED)
                own, low, high = _matrix(batch.column("v")), batch.column("low").to_numpy(), batch.column("high").to_numpy()
                squared = (own * own).sum(axis=1)
                distance = between(np.concatenate([own, np.zeros((len(own), 1))], axis=1), level.points, squared, lengths)
                near = distance.argmin(axis=1)
                at_home = level.first[near] + np.mod(batch.column("window").to_numpy(), level.many[near])
                base = squared + level.longest
                inner, outer = (np.sqrt(np.maximum(base - 2.0 * x, 0.0)) for x in (high, low))
                row, subtree = np.nonzero(meets(distance, level.low, level.high, inner, outer, level.longest) & (low <= high)[:, None])
                many = level.many[subtree]
                row, first = np.repeat(row, many), np.repeat(level.first[subtree], many)
                segment = first + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                wanted = (segment == at_home[row]) == home
                out = pa.RecordBatch.from_arrays([c.take(pa.array(row[wanted])) for c in batch.columns], batch.schema.names)
                yield out.append_column("segment", pa.array(segment[wanted], pa.int64()))

    return windows.mapInArrow(batches, _WINDOWS + ", segment long")


def met(asked: DataFrame, index: Index, same: bool, k: int, blocks: int) -> DataFrame:
    """The best ``k`` rows of each segment for each window sent there, the windows in blocks."""

    longest = index.level.longest

    def segment(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            vectors = _matrix(rows.column("v"))
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            tree = grown(lifted(vectors, longest), np.arange(len(ids)), FANOUT, LEAF_ROWS)
            for at in range(0, asked.num_rows, WINDOW_RUN):
                part = asked.slice(at, WINDOW_RUN)
                id, window = part.column("id").to_numpy(), part.column("window").to_numpy()
                low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
                _, first, of = np.unique(part.column("anchor").to_numpy(), return_index=True, return_inverse=True)
                own, label = _matrix(part.column("v"))[first], part.column("label").to_numpy()[first]
                now = Asked(own, id[first], label, of, low, high, longest, same, k)
                search(tree, vectors, ids, labels, now, np.arange(len(id)))
                w, r = np.nonzero(now.score != LOWEST)
                out.append((id[w], window[w], now.row[w, r], now.score[w, r]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("id", "window", "partner", "score"), map(pa.array, columns))))

    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("*", F.pmod("window", F.lit(blocks)).cast("int").alias("of")).withColumnRenamed("segment", "to")
    return rows.groupBy("segment", "block").cogroup(asked.groupBy("to", "of")).applyInArrow(segment, _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "partner")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(windows: DataFrame, index: Index, same: bool, k: int, name: str) -> DataFrame:
    """(id, window, partner, score, rank): the first ``k`` rows of each window, over all segments."""
    columns = [f.split(" ")[0] for f in _WINDOWS.split(", ")]
    windows = kept(windows.select(columns), f"{name}-windows")
    blocks = max(1, math.ceil(windows.count() / WINDOW_BLOCK))
    at_home = kept(met(routed(windows, index.level, True), index, same, k, blocks), f"{name}-home")
    full = at_home.groupBy("window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    raised = windows.join(full, "window", "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low")))
    elsewhere = met(routed(raised.select(columns), index.level, False), index, same, k, blocks)
    return best(at_home.unionByName(elsewhere), k)


def mined(
    df: DataFrame,
    is_anchor: Column,
    low_percent: int = 30,
    high_percent: int = 90,
    positives: int = 5,
    k: int = 10,
    id: str = "id",
    label: str = "label",
    vector: str = "v",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``; vectors hold integers, as doubles.  A
    positive is one of the first rows of the anchor's label; its negatives are the
    first ``k`` rows of other labels whose scores lie between the two percentages
    of the positive's score.
    """
    rows = kept(usable(df, id, label, vector), "vectors")
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = indexed(rows)
    if index is None:
        return spark.createDataFrame([], out)
    number = F.monotonically_increasing_id()
    anchors = kept(rows.filter(is_anchor).withColumn("anchor", number), "anchors")
    wide = anchors.withColumns({"window": F.col("anchor"), "low": F.lit(LOWEST // 4), "high": F.lit(HIGHEST // 4)})
    near = searched(wide, index, True, positives, "positives").select(
        F.col("window").alias("anchor"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # low% of p <= 100 n <= high% of p in whole numbers: the least n is rounded up, the greatest down
    low = F.expr(f"-((-positive_score * {low_percent} - pmod(-positive_score * {low_percent}, 100L)) div 100)")
    high = F.expr(f"(positive_score * {high_percent} - pmod(positive_score * {high_percent}, 100L)) div 100")
    pairs = kept(anchors.join(near, "anchor").withColumns({"window": number, "low": low, "high": high}), "pairs")
    negatives = searched(pairs.filter(F.col("low") <= F.col("high")), index, False, k, "negatives")
    named = pairs.select("window", F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return negatives.drop("id").join(named, "window").select(
        "anchor_id", "positive_id", "rank", F.col("partner").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """Whole vectors of 1/256 steps, and every seventh id under the next of ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = F.col("embedding").cast("array<double>")
    floored = F.transform(doubles, lambda x: F.when(odd(x), x).otherwise(F.floor(x * 256).cast("double")))
    return vectors.select(F.col("vec_id").alias("id"), label.alias("label"), floored.alias("v"))
