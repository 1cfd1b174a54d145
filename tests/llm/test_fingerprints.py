import hashlib
import re

import numpy as np
from corpus import empty, frame, rows
from pyspark.sql import functions as F

from drillmark.llm import fingerprints


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_against_brute_force(spark):
    data = sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
    want, exact = [], []
    for k, r in enumerate(data):
        text, after = r[2] or "", data[(k + 1) % len(data)][2] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        want.append((str(r[1]), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        exact.append((jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after))))
    found = fingerprints.edited_likeness(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    by = {w: e for w, e in zip(want, exact)}
    errors = [
        (r.near_edited - by[str(r.doc_id), r.n_chars, r.edited_sha256][0], r.near_next - by[str(r.doc_id), r.n_chars, r.edited_sha256][1])
        for r in found
    ]
    assert np.abs(errors).max() < 0.2 and np.abs(np.mean(errors)) < 0.03
    assert all(len(r.fingerprint) == 256 and (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) for r in found)


def test_likeness_is_unbiased(spark):
    """Estimates of many pairs of one known similarity lie around it."""
    rng = np.random.default_rng(2)
    pairs = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(340)]
        other = words[:240] + [f"o{k}x{i}" for i in range(100)]
        pairs.append((" ".join(words), " ".join(other)))
    rng.shuffle(pairs)
    table = spark.createDataFrame(pairs, "a string, b string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(table, "a", "fa"), "b", "fb")
    found = [r.x for r in both.select(fingerprints.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()]
    exact = 236 / (336 + 100)
    assert abs(np.mean(found) - exact) < 0.015 and np.std(found) < 0.06


def test_equal_texts_and_one_row(spark):
    one = fingerprints.edited_likeness(frame(spark, rows()[7:8])).collect()
    assert one[0].near_next == 1.0
    found = fingerprints.edited_likeness(frame(spark)).select("doc_id", "fingerprint").collect()
    texts = {r[1]: r[2] for r in rows() if r[1] is not None}
    by = {}
    for r in found:
        if r.doc_id is not None:
            by.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_empty_and_native(spark):
    assert fingerprints.edited_likeness(empty(spark)).collect() == []
    plan = fingerprints.edited_likeness(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
