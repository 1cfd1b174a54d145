import itertools
import zlib

import numpy as np
import pytest
import public_tokenizers
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drillmark.llm import config_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, size):
    """The least number of sequences, by trying."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in {room for room in rooms if room >= lengths[k]}:
            at = rooms.index(r)
            place(k + 1, [*rooms[:at], r - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0] if lengths else 0


def brute_price(price):
    size = len(price) - 1
    best = [0.0] * (size + 1)
    for room in range(1, size + 1):
        best[room] = max([best[room - 1], *(price[n] + best[room - n] for n in range(1, room + 1))])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_prices(values):
    price = np.array([0.0, *values])
    best, first = config_packing.priced(price)
    assert best == pytest.approx(brute_price(price))
    for length in range(1, len(price)):
        held = config_packing.completed(length, first)
        assert sum(n * c for n, c in held.items()) <= len(price) - 1
        assert sum(price[n] * c for n, c in held.items()) == pytest.approx(price[length] + best[len(price) - 1 - length])


def whole(patterns, counts, size):
    held = {}
    for packs, pattern in patterns:
        assert packs > 0 and 0 < sum(pattern) <= size
        for n in pattern:
            held[n] = held.get(n, 0) + packs
    assert held == counts
    return sum(p for p, _ in patterns)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 48), st.integers(1, 60), max_size=30))
def test_patterns_hold_the_histogram(counts):
    packs = whole(config_packing.solved(counts, 48), counts, 48)
    assert packs <= whole(config_packing.best_fit(counts, 48), counts, 48)
    assert packs >= -(-sum(n * c for n, c in counts.items()) // 48)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_near_the_fewest(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    assert whole(config_packing.solved(counts, 20), counts, 20) <= fewest(lengths, 20) + 1


def test_better_than_best_fit():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.normal(400, 120, 20_000).astype(int), 1, 1024)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    least = -(-int(lengths.sum()) // 1024)
    packs = whole(config_packing.solved(counts), counts, 1024)
    plain = whole(config_packing.best_fit(counts, 1024), counts, 1024)
    assert packs <= least * 1.002 and packs - least < (plain - least) / 3


def test_fractions_cover_all():
    rng = np.random.default_rng(3)
    counts = np.zeros(129)
    counts[1:] = rng.integers(0, 1000, 128)
    amounts = config_packing.fractional(counts)
    held = np.zeros(129)
    for pattern, amount in amounts.items():
        np.add.at(held, list(pattern), amount)
    assert held == pytest.approx(counts, rel=1e-6, abs=1e-6)
    least = max((counts * np.arange(129)).sum() / 128, counts[65:].sum())  # no two over the half share a sequence
    assert least - 1e-6 <= sum(amounts.values()) <= 1.005 * least


def test_against_the_tokenizer(spark):
    tool = Tokenizer.from_file(PATH)  # in its default setting
    data = rows() + [("k", 7000, "a <|endoftext|> b", "d", 1, "i", "s", "en", "s")]
    want = sorted((str(r[1]), [*tool.encode(r[2] or "", add_special_tokens=False).ids, 2]) for r in data)
    found = config_packing.pack(frame(spark, data).repartition(5), PATH, ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in found)
    docs = {}
    for r in found:
        docs.setdefault((str(r.id), r.piece), []).append((r.start, r.ids))
    got = []
    for (id, piece), parts in docs.items():
        if piece:
            assert all(len(ids) == 1024 for _, ids in parts)
        else:
            for _, ids in parts:
                later = [sorted(x for x in docs.get((id, p), []) if x[0] == len(ids) + 1024 * (p - 1)) for p in range(1, 99)]
                got.append((id, ids + list(itertools.chain(*[x[0][1] for x in itertools.takewhile(bool, later)]))))
    assert sorted(got) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024
    total = sum(r.length for r in found)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= -(-total // 1024) + 2


def test_hot_length(spark):
    """One text in most rows, without ids: many equal pieces, each in a place of its own."""
    data = [("k", None, "the same text", "d", 1, "i", "s", "en", "s")] * 700 + [("k", k, "word " * (k % 90), "d", 1, "i", "s", "en", "s") for k in range(300)]
    found = config_packing.pack(frame(spark, data).repartition(6), PATH).collect()
    assert len(found) == 1000 and len({(r.sequence_id, r.offset) for r in found}) == 1000


def test_empty_and_clashing_columns(spark):
    assert config_packing.pack(empty(spark), PATH).collect() == []
    odd = frame(spark).withColumnsRenamed({"key": "part", "doc": "rank", "spans": "nth", "source": "before"})
    assert odd.count() == len({(r.id, r.ids_crc32, r.sequence_id, r.offset) for r in config_packing.pack(odd, PATH).filter(F.col("piece") == 0).collect()})
