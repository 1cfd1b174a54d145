import re

import corpus_pipeline
import numpy as np
import xxhash
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillmark.llm import simhash


def plain(text, shingle=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, limit):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=60), st.integers(0, 4), st.integers(0, 5))
def test_walk_finds_all_pairs(flips, limit, depth):
    rng = np.random.default_rng(len(flips))
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(f)) for f in flips], [np.uint64(0)]]))
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= limit}
    got = [p for i, j in simhash.walk(values, None, 0, limit) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    top = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
    for a in set(top.tolist()):
        for b in {t for t in top.tolist() if t > a}:
            left, right = np.flatnonzero(top == a), np.flatnonzero(top == b)
            found = {(left[x], right[y]) for i, j in simhash.walk(values[left], values[right], depth, limit) for x, y in zip(i, j)}
            assert found == {(i, j) for i, j in want if top[i] == a and top[j] == b}


def test_block_pairs_cover_the_limit():
    pairs = simhash.block_pairs(4, 2)
    assert all((b in pairs[a]) == ((a ^ b).bit_count() <= 2) for a in range(16) for b in range(a, 16))


def test_against_brute_force(spark):
    found = simhash.near_duplicates(frame(spark)).collect()
    data = rows()
    prints = [plain(r[2]) for r in data]
    parts = components(prints, 3)
    least = {}
    for part, r in zip(parts, data):
        if r[1] is not None:
            least[part] = min(least.get(part, r[1]), r[1])
    want = sorted((str(r[1]), f"{p:016x}", str(least.get(c))) for r, p, c in zip(data, prints, parts))
    got = sorted((str(r.id), f"{r.fingerprint & (1 << 64) - 1:016x}", str(r.component)) for r in found)
    assert got == want


def first_rows(data):
    """For each group the (id, text) that may stay: one of the smallest id, or of those without an id."""
    groups = {}
    for part, r in zip(components([plain(r[2]) for r in data], 3), data):
        groups.setdefault(part, []).append(r)
    out = []
    for group in groups.values():
        ids = [r[1] for r in group if r[1] is not None]
        out.append({(r[1], r[2]) for r in group if r[1] == (min(ids) if ids else None)})
    return out


def test_one_row_of_each_group_stays(spark):
    data = rows()
    text = " ".join(f"alone{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    data += [("k", None, text, "d", k, "i", "s", "en", "s") for k in (1, 1, 2)]  # no id in the whole group
    data += [("k", 900, other, "d", 1, "i", "s", "en", "s")] * 3  # one id on rows that are equal
    # an id on texts of different groups, one of them a copy of a smaller id's text
    data += [("k", 901, t, "d", 1, "i", "s", "en", "s") for t in (other, "seven eight nine ten eleven")]
    left = simhash.one_per_group(frame(spark, data))
    assert left.columns == frame(spark).columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    want = first_rows(data)
    assert len(got) == len(want) and all(sum(g in w for g in got) == 1 for w in want)
    assert simhash.one_per_group(empty(spark)).collect() == []


def test_columns_may_have_the_names_used_inside(spark):
    names = ["_id", "_none", "_body", "_row", "_nth", "_flags", "_doc", "_c0"]
    wide = frame(spark).select("*", *[F.lit(n).alias(n) for n in names])
    stages = [stage for _, stage in corpus_pipeline.STAGES if stage is not corpus_pipeline.toxic_documents][:3]
    plain_docs = frame(spark)
    for stage in stages:
        found = stage(spark, wide, "")
        assert found.columns == wide.columns
        rows_left = found.collect()
        assert rows_left and all([r[n] for n in names] == names for r in rows_left)
        left = [r.asDict() for r in stage(spark, plain_docs, "").collect()]
        assert sorted((str(r.doc_id), str(r.text)) for r in rows_left) == sorted((str(r["doc_id"]), str(r["text"])) for r in left)


def test_repeated_rows_keep_their_text_in_the_pipeline(spark):
    text = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"term{k}" for k in range(80))
    data = [("k", i, t, "d", 1, "i", "s", "en", "s") for i, t in [(None, text)] * 3 + [(5, other)] * 2]
    docs = frame(spark, data)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
    assert sorted(r.text for r in docs.collect()) == sorted([text, other])


def test_long_chain_is_one_component(spark):
    values, now = [], 0
    for k in range(20):
        now ^= 0b111 << (3 * k)
        values.append(now - (1 << 64) if now >= 1 << 63 else now)
    nodes = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = simhash.components(simhash.links(nodes)).collect()
    assert {r.root for r in found} == {min(values)} and len(found) == 19


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
