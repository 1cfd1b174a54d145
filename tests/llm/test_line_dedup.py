import random
import re

import pytest
import xxhash
from corpus import SCHEMA, empty, frame, rows

from drillmark.llm import line_dedup


def brute(data):
    """Texts left, by (id, text)."""
    lines = []
    for r in {(r[1], r[2]): r for r in data}.values():
        for at, line in enumerate((r[2] or "").split("\n") if r[2] is not None else []):
            place = (r[1] if r[1] is not None else line_dedup.FIRST_ID, at)
            lines.append((place, (r[1], r[2]), line, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))))
    left = {(r[1], r[2]): [] for r in data}
    for place, doc, line, words in sorted(lines, key=lambda x: (x[0], str(x[1]))):
        later = any(p < place and 9 * len(words & w) >= 4 * (len(words) + len(w)) for p, _, _, w in lines if w)
        if not words or not later:
            left[doc].append(line)
    return {k: None if k[1] is None else "\n".join(v) for k, v in left.items()}


def variants():
    """Groups of variants of a line, chains of near matches, repeated short lines."""
    rng = random.Random(3)
    out = []
    vocabulary = [f"w{k}" for k in range(60)]
    base = rng.sample(vocabulary, 30)
    for doc in range(60):
        lines = []
        for _ in range(4):
            kind = rng.randrange(4)
            if kind == 0:
                line = list(base)
                for _ in range(rng.randrange(5)):
                    line[rng.randrange(30)] = rng.choice(vocabulary)
            elif kind == 1:
                line = rng.sample(vocabulary[:8], rng.randrange(1, 7))
            elif kind == 2:
                line = rng.choices(vocabulary, k=rng.randrange(1, 12))
            else:
                line = rng.sample(base, 26)
            lines.append(" ".join(line))
        out.append(("k", doc * 5 % 61, "\n".join(lines), "d", 1, "i", "s", "en", "s"))
    return out


@pytest.mark.parametrize("data", [rows(), variants()], ids=["awkward", "variants"])
def test_against_brute_force(spark, data):
    left = line_dedup.without_repeats(spark.createDataFrame(data, SCHEMA).repartition(3).withColumnRenamed("n_chars", "at"))
    assert "at" in left.columns
    want = brute(data)
    # the words in the awkward rows are told by id and by what stays
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    assert got == sorted((str(r[1]), str(want[r[1], r[2]])) for r in data)


def shared_places():
    """Rows without an id and rows that repeat one, with texts of their own: many lines share a place."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    common = "a line that all of them begin with today"
    out = []
    for doc in range(60):
        lines = [common, " ".join(rng.choices(vocabulary, k=12)), rng.choice("abcdefgh"), " ".join(vocabulary[:11])]
        if doc % 3:  # a unique line beside a variant of an earlier one, at the same place of other rows
            lines[1] = f"unique{doc} line{doc} of{doc} row{doc} only{doc}" if doc % 2 else f"{common} and{doc}"
        rng.shuffle(lines)
        out.append(("k", (None, None, 7, doc)[doc % 4], "\n".join(lines), "d", 1, "i", "s", "en", "s"))
    return out + [out[0], out[2]]


def test_lines_that_share_id_and_number_are_told_apart(spark):
    data = shared_places()
    want = brute(data)
    left = line_dedup.without_repeats(spark.createDataFrame(data, SCHEMA).repartition(3))
    got = sorted((str(r.doc_id), r.text) for r in left.collect())
    assert got == sorted((str(r[1]), want[r[1], r[2]]) for r in data)


def test_empty(spark):
    assert line_dedup.without_repeats(empty(spark)).collect() == []


def test_main_path_is_native(spark):
    plan = line_dedup.without_repeats(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_one_exchange_for_both_sides(spark):
    """The rows of the prefixes are shuffled once."""
    schema = "same long, id long, at int, n int, parity long, i int, token long"
    rows = line_dedup.kept(spark.createDataFrame([(1, 2, 3, 4, 5, 0, 7)] * 3, schema), "few")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = line_dedup._pairs(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("+- Exchange hashpartitioning(token") == 1 and "ReusedExchange" in plan


def _rows(texts):
    return [("k", k, text, "d", 1, "i", "s", "en", "src0") for k, text in enumerate(texts)]


def _drawn(rng, words, n):
    return " ".join(rng.sample(words, n))


def test_long_lines_that_differ_are_no_candidates(spark):
    """Lines of 50 to 200 words of one vocabulary share many words and are not similar."""
    rng = random.Random(5)
    words = [f"v{k}" for k in range(600)]
    data = _rows([_drawn(rng, words, n) for n in range(50, 200, 2) for _ in range(4)])
    docs = line_dedup._narrow(frame(spark, data), "doc_id", "text")
    sets = line_dedup._with_set(line_dedup._lines(docs), line_dedup.rarity(docs))
    found = line_dedup._pairs(line_dedup.kept(line_dedup._prefixes(sets), "few"))
    assert found.filter("not alone").count() < 100


def test_long_lines_against_brute_force(spark):
    """Variants on both sides of the least similarity, about the lengths where sketches widen."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(2000)]
    texts = []
    for n in (36, 40, 44, 49, 90, 100, 110, 124, 160):
        base = rng.sample(words, n)
        for change in (0, n // 9 - 1, n // 9, n // 9 + 1, n // 5):
            texts.append(" ".join(base[change:] + rng.sample(words, change)))
            texts.append(" ".join(base[: n - change]))
            texts.append(" ".join(base + rng.sample(words, change)))
    rng.shuffle(texts)
    data = _rows(["\n".join(texts[k : k + 3]) for k in range(0, len(texts), 3)])
    found = line_dedup.without_repeats(frame(spark, data)).collect()
    assert {(r["doc_id"], old[2]): r["text"] for r in found for old in data if old[1] == r["doc_id"]} == brute(data)


def test_a_rare_word_is_not_taken_for_a_frequent_one_of_near_hash(spark):
    """Words that agree in the first 12 bits of their hashes only are counted apart."""

    def top(word, bits):
        return xxhash.xxh64_intdigest(word.encode(), 42) >> (64 - bits)

    rare = next(w for w in map("r{}".format, range(10**6)) if top(w, 12) == top("often", 12) and top(w, 16) != top("often", 16))
    docs = line_dedup._narrow(frame(spark, _rows([f"{rare} often middle", *["often"] * 9, *["middle"] * 3])), "doc_id", "text")
    sets = line_dedup._with_set(line_dedup._lines(docs), line_dedup.rarity(docs))
    first = sets.filter("n = 3").first()["keys"][0]
    low = (1 << (64 - line_dedup.CLASS_BITS)) - 1
    assert first & low == xxhash.xxh64_intdigest(rare.encode(), 42) & low


def test_prefixes_are_stored_once_per_line(spark, monkeypatch):
    """The words of a prefix are stored in one row, not with the columns of their line each."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(300)]
    data = _rows([_drawn(rng, words, 60) for _ in range(20)])
    stored, real = {}, line_dedup.kept
    monkeypatch.setattr(line_dedup, "kept", lambda df, name: stored.setdefault((name, len(stored)), real(df, name)))
    line_dedup.without_repeats(frame(spark, data))
    assert [df.count() for (name, _), df in stored.items() if name == "prefixes"] == [20]


def _meeting(spark, data):
    """Pairs of rows of different lines that meet on a key."""
    docs = line_dedup._narrow(frame(spark, data), "doc_id", "text")
    keys = line_dedup._prefixes(line_dedup._with_set(line_dedup._lines(docs)))
    return sum(r["count"] * (r["count"] - 1) // 2 for r in keys.groupBy("token").count().collect())


def test_lines_do_not_meet_on_single_words(spark):
    """Lines of words that ten others have too, but seldom beside the same word: by single words of
    9 of 40 some 16,000 pairs would meet."""
    rng = random.Random(11)
    words = [f"{'abcdefghij'[k % 10] * (4 + k % 17)}{k}" for k in range(1500)]
    assert _meeting(spark, _rows([_drawn(rng, words, 40) for _ in range(400)])) < 3000


def test_similar_sets_share_a_key_of_their_prefixes(spark):
    """As many words changed, added or left out as 4/5 allows, wherever they stand in the order."""
    rng = random.Random(12)
    texts, pairs = [], []
    for k in range(150):
        words = [f"{'x' * rng.randrange(1, 35)}{k}_{j}" for j in range(60)]
        n = rng.randrange(1, 45)
        x = words[:n]
        fewer, more = rng.randrange(n // 5 + 1), rng.randrange(n // 4 + 1)
        y = rng.sample(x, n - fewer) + words[45 : 45 + min(more, 15)]
        if 9 * (n - fewer) >= 4 * (len(x) + len(y)):
            pairs.append((" ".join(x), " ".join(y)))
            texts += pairs[-1]
    docs = line_dedup._narrow(frame(spark, _rows(texts)), "doc_id", "text")
    sets = line_dedup._with_set(line_dedup._lines(docs))
    found = {}
    for r in line_dedup._with_prefix(sets).collect():
        found.setdefault(r["same"], set()).update(r["prefix"])
    assert len(pairs) > 50
    names = {r["line"]: r["same"] for r in line_dedup._lines(docs).collect()}
    assert all(found[names[x]] & found[names[y]] for x, y in pairs)


def test_words_are_counted_where_their_lengths_tell_nothing(spark, monkeypatch):
    """Many lines of one key: words are ordered by rarity instead, with the same result."""
    calls, real = [], line_dedup.rarity
    monkeypatch.setattr(line_dedup, "rarity", lambda docs: calls.append(1) or real(docs))
    data = variants()
    want = sorted((str(r[1]), str(brute(data)[r[1], r[2]])) for r in data)
    for crowd, counted in ((line_dedup.CROWD, 0), (1, 1)):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        left = line_dedup.without_repeats(frame(spark, data))
        assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == want
        assert len(calls) == counted


def test_sets_are_made_once_for_both_ends_of_the_pairs(spark, monkeypatch):
    made, real = [], line_dedup._with_set
    monkeypatch.setattr(line_dedup, "_with_set", lambda *a: made.append(1) or real(*a))
    stored, keep = [], line_dedup.kept
    monkeypatch.setattr(line_dedup, "kept", lambda df, name: stored.append(name) or keep(df, name))
    line_dedup.without_repeats(frame(spark))
    assert stored.count("sets") == 2 and len(made) == 3
