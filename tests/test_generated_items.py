"""Insert-or-get: items that agree by content or by request."""

import random

from drillmark.functions.text import content_hash
from drillmark.sources import sinks
from pyspark.sql import functions as F

SCHEMA = "request_id long, domain string, prompt string, note string"


def resolved(spark, rows, stored):
    generated = spark.createDataFrame(rows, SCHEMA).repartition(4)
    store = spark.createDataFrame(stored, "id string, domain string, prompt string").select(
        "id", content_hash(F.col("domain"), F.col("prompt")).alias("content_hash")
    )
    return sinks.insert_or_get(generated, store).collect()


def brute(rows, stored):
    """Groups of rows that share a prompt or a request, walked one by one."""
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                same = a[2] == b[2] or (a[0] is not None and a[0] == b[0])
                if same and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    out = []
    for g in set(group):
        own = [r for r, x in zip(rows, group) if x == g]
        prompts = {r[2] for r in own}
        known = [id for id, _, prompt in stored if prompt in prompts]
        out.append((sorted(r[3] for r in own), min(known, default=None), min((r[0] is not None, r[0] or 0) for r in own)))
    return sorted(out)


def grouped(found):
    items = {}
    for r in found:
        items.setdefault(r.id, []).append(r)
    out = []
    for id, own in items.items():
        new = [r for r in own if r.is_new]
        least = min((r.request_id is not None, r.request_id or 0) for r in own)
        if new:
            assert len(new) == 1 and (new[0].request_id is not None, new[0].request_id or 0) == least
        out.append((sorted(r.note for r in own), None if new else id, least))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    for shape in ((40, 60), (15, 12), (4, 200)):  # requests, prompts
        rows = [(rng.randrange(shape[0]), "d", f"prompt {rng.randrange(shape[1])}", f"n{k}") for k in range(60)]
        rows += [(None, "d", "prompt 1", "n60"), (None, "d", "prompt 2", "n61"), rows[0][:3] + ("n62",)]
        stored = [("s1", "d", "prompt 3"), ("s0", "d", "prompt 3"), ("s2", "d", "prompt 7"), ("s9", "d", "never")]
        assert grouped(resolved(spark, rows, stored)) == brute(rows, stored)


def test_a_long_chain_is_one_item(spark):
    """Each request links two prompts."""
    rows = [(k // 2, "d", f"p{(k + 1) // 2}", f"n{k}") for k in range(64)]
    found = resolved(spark, rows, [("s", "d", "p20")])
    assert {r.id for r in found} == {"s"} and not any(r.is_new for r in found)


def test_a_frequent_hash(spark):
    rows = [(k, "d", "the same" if k % 3 else f"p{k}", f"n{k}") for k in range(3000)]
    found = resolved(spark, rows, [])
    assert len(found) == 3000 and sum(r.is_new for r in found) == 1001
    assert len({r.id for r in found if r.prompt == "the same"}) == 1
    assert [r.request_id for r in found if r.is_new and r.prompt == "the same"] == [1]


def test_none(spark):
    assert resolved(spark, [], []) == []
