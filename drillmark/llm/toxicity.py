"""Toxic passages by maximum-scoring segments over token log-odds.

*Tokens.*  A word counts as itself and as its beginnings of 4 to 6 letters, so
that inflected forms share evidence.  A document counts a word once, so that a
text that repeats itself weighs no more than another.  Counts are taken over all
documents (the prior) and over the labelled sample, toxic and clean (the
evidence).

*Log-odds.*  Each token's log-odds of toxic against clean text use an
informative Dirichlet prior: pseudo-counts in proportion to the token's share of
the whole corpus.  Tokens whose log-odds are surely positive (z of ``MIN_Z`` and
more) score their log-odds less one standard error; any other word costs a
little, as its share in toxic text is lower.

*Segments.*  One linear scan finds every maximal-scoring segment of a text: no
segment inside or around it scores more.

*Calibration.*  In clean text the best of n words exceeds S with an expected
``K n exp(-lambda S)`` segments (extreme-value theory).  ``lambda`` solves
``E[exp(lambda s)] = 1`` over clean text, ``K`` is fitted to the clean sample.
The evidence of a document is the sum over its significant segments of
``-ln(expected number)``; a logistic curve, fitted on the sample, turns it into
a score from 0 to 1.

Defined results: missing and empty texts have no evidence and score as such;
labels of ids that no document has are not used; a label that is missing is not
used; without any toxic or any clean label every score is the share of toxic
labels (0 without labels); an empty table gives no rows; repeated rows score
alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark.llm.shared import kept

#: Labelled documents the classifier is fitted on at most, by the order of a hash.
MAX_LABELLED = 20_000
#: Tokens with a score at most, the surest first.
MAX_TOKENS = 20_000
BEGINNINGS = (4, 5, 6)
MIN_Z = 3.0
#: Pseudo-counts of the prior in all, for each labelled word.
PRIOR = 0.1
#: Expected number of clean segments below which a segment is significant.
SIGNIFICANT = 0.5
#: Folds of the ids; fold 0 is held out.
FOLDS = 5

#: Words a worker holds at a time.
CACHED_WORDS = 60_000

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float]  # of words and, with a final *, of beginnings
    other: float  # of any other word
    rate: float  # lambda
    scale: float  # K
    slope: float
    shift: float


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % FOLDS, F.lit(1)) == 0


# ------------------------------------------------------------------ local work


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score) in one pass.

    Candidates are kept with the running total before and after them; a new
    positive word is a candidate that swallows earlier ones as long as joining
    them scores more than either side alone.
    """
    found: list[tuple[int, int, float, float]] = []  # from, to, total before, total after
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        a, left, right = k, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((a, k + 1, left, right))
                break
            a, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def word(self, word: str) -> float:
        score = self.seen.get(word)
        if score is None:
            known = self.model.scores
            options = [known[t] for t in tokens_of(word) if t in known]
            score = max(options) if options else self.model.other
            if len(self.seen) > CACHED_WORDS:
                self.seen.clear()
            self.seen[word] = score
        return score

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(first word, word after the last, expected clean segments) of significant passages."""
        m = self.model
        words = words_of(text)
        scores = list(map(self.word, words))
        expected = [(a, b, m.scale * len(words) * math.exp(-m.rate * s)) for a, b, s in segments(scores)]
        return [x for x in expected if x[2] < SIGNIFICANT]

    def evidence(self, text: str) -> float:
        return sum(-math.log(max(e, 1e-300)) for _, _, e in self.passages(text))

    def score(self, text: str) -> float:
        m = self.model
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, m.slope * math.log1p(self.evidence(text)) + m.shift))))


def tokens_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


# ------------------------------------------------------------------ fitting


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict[int, int]:
    """Labels of at most ``limit`` documents outside the held-out fold; of equal texts one."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    usable = usable.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    first = usable.orderBy(F.xxhash64("id"), "id").limit(limit)
    found = docs.join(F.broadcast(first), docs["id"] == first["id"]).select(first["id"], "toxic", F.xxhash64("text").alias("body"))
    rows = found.groupBy("body").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).collect()  # at most ``limit``
    return {r["id"]: r["toxic"] for r in rows}


def word_counts(docs: DataFrame, labels: dict[int, int]) -> DataFrame:
    """(word, n, toxic, clean): documents with the word; the last two over the sample."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, toxic, clean = Counter(), Counter(), Counter()

        def sent():
            words = list(total)
            out = {"word": pa.array(words, pa.string())}
            for name, counts in (("n", total), ("toxic", toxic), ("clean", clean)):
                out[name] = pa.array([counts[w] for w in words], pa.int64())
            return pa.RecordBatch.from_pydict(out)

        for batch in rows:
            for id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                words = set(words_of(text))
                total.update(words)
                label = labels.get(id)
                if label is not None:
                    (toxic if label else clean).update(words)
            if len(total) > CACHED_WORDS:  # what is counted so far goes on
                yield sent()
                total, toxic, clean = Counter(), Counter(), Counter()
        if total:
            yield sent()

    counted = docs.mapInArrow(batches, "word string, n long, toxic long, clean long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


def token_scores(counts: DataFrame, totals, limit: int = MAX_TOKENS) -> dict[str, float]:
    """Log-odds of the surely toxic tokens."""
    size = F.length("word")
    beginnings = [F.when(size >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    tokens = (
        counts.select(F.explode(F.array("word", *beginnings)).alias("token"), "n", "toxic", "clean")
        .dropna().groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])
        .filter("toxic > 0")
    )
    pseudo = PRIOR * (totals["toxic"] + totals["clean"])
    prior = F.col("n") * (pseudo / totals["n"])

    def odds(count: str) -> Column:
        k = F.col(count) + prior
        return F.log(k / (F.lit(totals[count] + pseudo) - k))

    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = tokens.withColumn("odds", odds("toxic") - odds("clean")).withColumn("z", F.col("odds") / spread)
    sure = scored.filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "token").limit(limit)
    return {r["token"]: r["score"] for r in sure.select("token", (F.col("odds") - spread).alias("score")).collect()}


def _karlin_rate(shares: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum(share * exp(lambda * score)) = 1."""
    def excess(rate):
        return sum(p * math.exp(min(700.0, rate * s)) for s, p in shares) - 1

    high = 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    low = 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a lightly penalised logistic curve."""
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """``docs``: (id, text); ``labels``: (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, max_labelled)
    toxic = sum(sample.values())
    if not toxic or toxic == len(sample):
        share = toxic / len(sample) if sample else 0.0
        return Model({}, -1.0, 1.0, 1.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    counts = kept(word_counts(docs, sample), "words")
    totals = counts.agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")]).first()
    scores = token_scores(counts, totals)
    model = Model(scores, -1.0, 1.0, 1.0, 1.0, 0.0)
    ids = docs.sparkSession.createDataFrame(list(sample.items()), "sample_id long, label int")
    chosen = docs.join(F.broadcast(ids), F.col("id") == F.col("sample_id")).select("label", "text")

    def measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            sizes, hits = [], []
            for text in batch.column("text"):  # one document's words at a time
                words = words_of(text.as_py() or "")
                sizes.append(len(words))
                hits.append([s for s in map(scorer.word, words) if s > 0])
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "words": pa.array(sizes, pa.int64()), "hits": pa.array(hits, pa.list_(pa.float64()))}
            )

    rows = chosen.mapInArrow(measured, "label int, words long, hits array<double>").groupBy("label").agg(
        F.sum("words").alias("words"), F.sum(F.size("hits")).alias("hits"),
        F.sum(F.expr("aggregate(hits, 0D, (a, x) -> a + x)")).alias("total"),
    ).collect()
    of = {r["label"]: r for r in rows}
    shares = [(of[k]["hits"] + 0.5) / (of[k]["words"] + 1) for k in (0, 1)]
    model.other = math.log((1 - shares[1]) / (1 - shares[0]))
    if model.other >= 0:
        model.other = -1e-3
    mean = of[0]["total"] / of[0]["hits"] if of[0]["hits"] else of[1]["total"] / max(1, of[1]["hits"])
    model.rate = _karlin_rate([(mean, shares[0]), (model.other, 1 - shares[0])])

    def best(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            sizes, top = [], []
            for text in batch.column("text"):
                scores = [scorer.word(w) for w in words_of(text.as_py() or "")]
                sizes.append(len(scores))
                top.append(max((s for _, _, s in segments(scores)), default=0.0))
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "words": pa.array(sizes, pa.int64()), "best": pa.array(top, pa.float64())}
            )

    # E[number of segments over S] = K n exp(-lambda S): the share of clean texts that have none is exp of that
    clean = chosen.filter("label = 0").mapInArrow(best, "label int, words long, best double")
    level = model.rate and math.log(10) / model.rate
    r = clean.agg(F.sum("words").alias("n"), F.sum((F.col("best") >= level).cast("int")).alias("over")).first()
    model.scale = (r["over"] + 0.5) / (max(1, r["n"]) * math.exp(-model.rate * level))

    def evidence(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "x": pa.array([math.log1p(scorer.evidence(t or "")) for t in batch.column("text").to_pylist()], pa.float64())}
            )

    points = chosen.mapInArrow(evidence, "label int, x double").collect()  # at most ``max_labelled``
    model.slope, model.shift = _logistic(np.array([p["x"] for p in points]), np.array([p["label"] for p in points], float))
    return model


# ------------------------------------------------------------------ scoring


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, score) of every row."""
    narrow = _narrow(docs, id, text)
    model = fit(narrow, labels, max_labelled)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            found = [scorer.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(found, pa.float64())})

    return narrow.mapInArrow(batches, "id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score below one half."""
    model = fit(_narrow(docs, id, text), labels, max_labelled)

    @F.pandas_udf("boolean")
    def toxic(bodies: pd.Series) -> pd.Series:
        scorer = Scorer(model)
        return bodies.map(lambda t: scorer.score(t or "") >= 0.5)

    return docs.filter(~toxic(F.col(text).cast("string")))


def passages(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, first_word, end_word, expected, passage): every significant toxic passage."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in rows:
            out = []
            for id, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(body or "")
                out += [(id, a, b, e, " ".join(words[a:b])) for a, b, e in scorer.passages(body or "")]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "first_word", "end_word", "expected", "passage"]
            )

    return _narrow(docs, id, text).mapInArrow(batches, "id long, first_word int, end_word int, expected double, passage string")
