import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from drillmark.llm import repeats


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest(), left))
    return out


@pytest.mark.parametrize("window", [35, 12, 3])
def test_against_brute_force(spark, window):
    data = rows()
    want = sorted((str(r[1]), *b[:3]) for r, b in zip(data, brute([r[2] for r in data], window)))
    got = repeats.digests(frame(spark), window=window).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_texts_lose_the_same_words(spark):
    data = rows()
    want = sorted((str(r[1]), r[2] is None, b[3]) for r, b in zip(data, brute([r[2] for r in data], 35)))
    left = repeats.without_repeats(frame(spark))
    assert left.columns == frame(spark).columns
    got = sorted((str(r.doc_id), r.text is None, (r.text or "").encode().split()) for r in left.collect())
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=40, max_size=90), st.lists(st.integers(0, 3), max_size=30), st.integers(35, 40))
def test_equal_windows_share_a_phrase(left, right, size):
    """The parse cuts every window in its first 2**r words, at one place in all occurrences."""
    window = left[:35]
    texts = [window + right, right + window, right + window + left]
    names = [repeats.word_names([bytes([65 + x]) for x in t]) for t in texts]
    starts = [repeats.parse(n, np.zeros(len(n), int))[0] for n in names]
    offset = (0, len(right), len(right))
    shared = set.intersection(*[{s - o for s in start if 0 <= s - o < 16} for start, o in zip(starts, offset)])
    assert shared


@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 40))
def test_names_of_words_follow_content(values, length):
    names = repeats.word_names([bytes([65 + x]) for x in values])
    found = repeats.rolling(names, length)
    assert len(found) == max(0, len(values) - length + 1)
    seen = {}
    for k, name in enumerate(found.tolist()):
        assert seen.setdefault(name, values[k : k + length]) == values[k : k + length]
    assert len(seen) == len({tuple(values[k : k + length]) for k in range(len(found))})


def test_empty(spark):
    assert repeats.digests(empty(spark)).collect() == []


def test_windows_before_and_behind_a_passage_are_not_all_verified():
    """Of a passage of 60 words: its 26 windows, at most 15 before them and none after them."""
    rng = np.random.default_rng(4)
    shared = [f"s{k}" for k in rng.permutation(60)]
    texts = [" ".join([f"{side}{k}" for k in range(200)] + shared + [f"{side}x{k}" for k in range(200)]) for side in "ab"]
    places = []
    for text in texts:
        names = repeats.word_names(text.encode().split())
        start, _ = repeats.parse(names, np.zeros(len(names), int))
        places.append([int(p) for p in start if 200 <= p <= 260 - 20])
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2], "text": texts, "places": pa.array(places, pa.list_(pa.int32()))})
    for sent in repeats._verify(repeats.WINDOW, repeats.ROUNDS)([batch]):
        at = {1: set(), 2: set()}
        for docs, starts in zip(sent.column("docs").to_pylist(), sent.column("places").to_pylist()):
            for doc, place in zip(docs, starts):
                at[doc].add(place)
        for found in at.values():
            assert found >= set(range(200, 226)) and len(found) <= 26 + 15 and max(found) < 226 + 15
            assert max(found) - 225 <= 200 + 60 - max(p for p in places[0]) - 20


@pytest.mark.parametrize("window", [3, 7, 20, 35])
def test_equal_windows_end_their_first_words_at_one_boundary(window):
    """The last boundary in the first words of a window is at one place in all its occurrences."""
    rng = np.random.default_rng(window)
    rounds = min(repeats.ROUNDS, max(0, (window + 1).bit_length() - 2))
    for letters in (1, 2, 3, 50):
        for _ in range(60):
            inner = rng.integers(0, letters, window)
            found = set()
            for _ in range(4):
                left, right = rng.integers(0, letters + 1, rng.integers(0, 60)), rng.integers(0, letters + 1, rng.integers(0, 60))
                names = repeats._mix(np.r_[left, inner, right].astype(np.uint64))
                start, _ = repeats.parse(names, np.zeros(len(names), int), rounds)
                at = start[(start >= len(left)) & (start < len(left) + (1 << rounds))]
                found.add(int(at[-1]) - len(left))
            assert len(found) == 1


def test_memory_of_a_batch_of_many_words():
    """Two workers an executor hold the arrays of a block: their size must not follow the batch."""
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 250))) for _ in range(4000)]
    texts[3] = texts[0]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(4000)), "text": texts})
    tracemalloc.start()
    try:
        starts = sum(sent.num_rows for sent in repeats._reveal(repeats.WINDOW, repeats.ROUNDS)([batch]))
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
    assert starts > 4000
