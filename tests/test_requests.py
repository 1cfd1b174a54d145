"""Relevance for tables of requests, against scoring every question for every request."""

import random

from drillmark.plans import retrieval

SCHEMA = "id long, source_id long, title string, question_type string, difficulty string, problem_statement string, tags array<string>, is_ai_generated boolean, is_complete boolean"


def corpus(rng, n):
    words = ["tree", "Graph", "sum", "ÄPFEL", "join", "window"]
    rows = []
    for k in range(n):
        title = None if k % 17 == 0 else f"{rng.choice(words)} {rng.randrange(9)}"
        body = None if k % 23 == 0 else " ".join(rng.choices(words, k=3))
        tags = None if k % 19 == 0 else rng.choices(words, k=2)
        rows.append((k, k % 40, title, rng.choice("ab"), rng.choice(["Easy", "Hard"]), body, tags, k % 11 == 0, True))
    return rows


def brute(rows, requests, known):
    out = []
    for no, kind, difficulty, topic in requests:
        scored = []
        for id, source, title, own, level, body, tags, generated, _ in rows:
            if own != kind or generated or source not in known:
                continue
            text = None if None in (title, body, tags) else f"{title} {body} " + '["' + '","'.join(tags) + '"]'
            hit = topic not in (None, "general") and text is not None and topic.lower() in text.lower()
            score = (2 if level == difficulty else 0) + (4 if hit else 0)
            scored.append((-score, title is None, title or "", id))
        out += [(no, id, -score, place) for place, (score, _, _, id) in enumerate(sorted(scored)[:3], 1)]
    return sorted(out)


def found(spark, rows, requests, known):
    questions = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([(k, "set") for k in known], "id long, dataset_name string")
    asked = spark.createDataFrame(requests, "request_no int, question_type string, difficulty string, topic string")
    got = retrieval.top_references_batch(questions, sources, asked)
    assert not {"wanted", "topics", "question_type"} & set(got.columns)
    return sorted((r.request_no, r.question_id, r.score, r.place) for r in got.collect())


def test_against_every_pair(spark, monkeypatch):
    rng = random.Random(6)
    rows = corpus(rng, 400)
    topics = ["general", "tree", "TREE", "äpfel", "e", "", "none of them", 'ph","su', "w 3 gr", None]
    requests = [(k, rng.choice("abc"), rng.choice(["Easy", "Hard", "Odd"]), rng.choice(topics)) for k in range(120)]
    known = list(range(0, 40, 3)) + [1, 2]
    want = brute(rows, [r for r in requests if r[3] is not None], known)
    assert found(spark, rows, requests, known) == want
    monkeypatch.setattr(retrieval, "TOPICS_PER_SCAN", 2)  # several passes
    assert found(spark, rows, requests, known) == want


def test_a_hundred_thousand_requests(spark):
    """Many requests, most of them equal; the corpus is scanned once."""
    rng = random.Random(7)
    rows = corpus(rng, 200)
    sample = [("a", "Easy", "tree"), ("b", "Hard", "general"), ("a", "Hard", "sum")]
    requests = [(k, *(sample[0] if k % 3 else sample[k % 9 // 3])) for k in range(100_000)]
    got = found(spark, rows, requests, list(range(40)))
    assert len(got) == 300_000
    per = {}
    for no, id, score, place in got:
        per.setdefault(no, []).append((id, score, place))
    want = {r: [x[1:] for x in brute(rows, [(0, *r)], range(40))] for r in sample}
    for no, *r in requests[:500]:
        assert sorted(per[no], key=lambda x: x[2]) == sorted(want[tuple(r)], key=lambda x: x[2])
