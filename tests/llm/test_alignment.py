import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from drillmark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> x", "a  b", " a", "a ", "\ta\nb", "漢字 ١٢٣ 👩‍👩‍👧", "mark ▁ here", "<s>x</s> <0x41>", "\x00", "naïve ﬁ ½", " x　y  "]


def spelled(text):
    """(A ids, B ids, their bytes) by the tools themselves."""
    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.ranks_of(A)
    of_id = {i: t for t, i in letters.items()}
    a = tool.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    piece = [model.id_to_piece(i) for i in b]
    raw_b = [bytes.fromhex(p[3:5]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, piece)]
    return a, b, [of_id[i] for i in a], raw_b


def brute(texts):
    told = []
    for text in texts:
        a, b, raw_a, raw_b = spelled(text) if text else ([], [], [], [])
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            told.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in raw_a]).tolist(), np.cumsum([len(t) for t in raw_b]).tolist()
        links = [
            (x, y)
            for x, s, e in zip(a, [0, *ends_a], ends_a)
            for y, t, f in zip(b, [0, *ends_b], ends_b)
            if s < f and t < e
        ]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        told.append((len(a), len(b), groups, links))
    counts, best = {}, {}
    for *_, links in told:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for n_a, n_b, groups, links in told:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if n_a else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), sha))
    return out


def corpus():
    data = [r for r in rows() if len(r[2] or "") < 8000]
    return data + [("k", 900 + k, t, "d", 1, "i", "s", "en", "s") for k, t in enumerate(ODD)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_against_brute_force(spark, monkeypatch):
    data = corpus()
    want = sorted((str(r[1]), *x) for r, x in zip(data, brute([r[2] for r in data])))
    for run, block in ((alignment.RUN_CHARS, alignment.BLOCK_CHARS), (500, 2000), (1, 1)):
        monkeypatch.setattr(alignment, "RUN_CHARS", run)
        monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
        found = alignment.linked_counts(frame(spark, data), A, B).collect()
        assert sorted((str(r.id), *(r[c] for c in COLUMNS)) for r in found) == want


def test_alignments_hold_the_groups_and_links(spark):
    data = corpus()
    want = {(r[1], r[2]): brute([r[2]])[0] for r in data}
    found = alignment.alignments(frame(spark, data), A, B).collect()
    assert sorted(str((r.id, len(r.a), len(r.b), len(set(r.group_a)), len(r.link_a))) for r in found) == sorted(
        str((id, *x[:4])) for (id, _), x in want.items() for _ in range(sum((r[1], r[2]) == (id, _) for r in data))
    )
    for r in found:
        assert r.group_a == sorted(r.group_a) and set(r.group_a) == set(r.group_b) == set(range(len(set(r.group_a))))
        assert all(r.group_a[x] == r.group_b[y] for x, y in zip(r.link_a, r.link_b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.integers(1, 5), max_size=12))
def test_intervals(a, b):
    """Also where the two sides do not end together."""
    end_a, end_b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    start_a, start_b = end_a - a if a else end_a, end_b - b if b else end_b
    x, y = alignment.expanded(start_a, end_a, start_b, end_b)
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if start_a[i] < end_b[j] and start_b[j] < end_a[i]]
    assert list(zip(x.tolist(), y.tolist())) == pairs
    group_a, group_b = alignment.coalesced(start_a, end_a, start_b, end_b)
    assert all(group_a[i] == group_b[j] for i, j in pairs)
    inside = {*end_a.tolist(), *end_b.tolist()}
    spans = [*zip(start_a.tolist(), end_a.tolist()), *zip(start_b.tolist(), end_b.tolist())]
    free = {e for e in inside if not any(s < e < f for s, f in spans)}
    assert len({*group_a.tolist(), *group_b.tolist()}) == len(free)


def test_parts_are_encoded_as_the_whole(monkeypatch):
    _, b = alignment.tokenizers(A, B)
    text = "some words  and   more\n\nwörds 漢字 " * 60
    whole = b.model.encode(text)
    for size in (7, 50, 333):
        monkeypatch.setattr(alignment, "PART_CHARS", size)
        assert b.encode(text).tolist() == whole


def test_empty_and_clashing_columns(spark):
    assert alignment.linked_counts(empty(spark), A, B).collect() == []
    odd = frame(spark, rows()[18:20]).withColumnsRenamed({"key": "block", "doc": "pairs", "spans": "places", "source": "times"})
    assert sorted(r.id for r in alignment.linked_counts(odd, A, B).collect()) == [54, 57]
