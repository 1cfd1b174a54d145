"""JSON arrays in pieces, against a parser of the whole text."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drillmark.sources import arrays, readers

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text(alphabet='ab"\\[]{},: é漢', max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k"\\,', max_size=3), x, max_size=3),
    max_leaves=8,
)


def pieces_of(raw, places):
    cuts = sorted({0, len(raw), *[p % (len(raw) + 1) for p in places]})
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def joined(pieces):
    """Elements by the summaries of the pieces, composed in pairs."""
    start, out = arrays.START, {}
    for piece in pieces:
        for index, body, _, _, _ in arrays.cut(piece, start):
            out[index] = out.get(index, b"") + body
        start = arrays.advanced(start, [arrays.summary(piece, s) for s in range(3)])
    return out, start


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, max_size=5), st.lists(st.integers(0, 400), max_size=8), st.sampled_from([None, 1]))
def test_cut_anywhere(values, places, indent):
    raw = json.dumps(values, ensure_ascii=False, indent=indent).encode()
    pieces = pieces_of(raw, places)
    found, (state, depth, _, opened) = joined(pieces)
    assert (state, depth, opened) == (arrays.OUTSIDE, 0, True)
    if values:
        assert [json.loads(found[k]) for k in range(len(found))] == values
    else:
        assert found.keys() == {0} and not found[0].strip()
    by_state = [[arrays.summary(p, s) for s in range(3)] for p in pieces]
    for k in range(len(pieces)):  # composing is associative and equals the scan of the whole
        left, right = by_state[0], by_state[-1]
        for other in by_state[1 : k + 1]:
            left = arrays.composed(left, other)
        for other in reversed(by_state[k + 1 : -1]):
            right = arrays.composed(other, right)
        both = arrays.composed(left, right) if k + 1 < len(pieces) else left
        whole, both = arrays.summary(raw, arrays.OUTSIDE), both[arrays.OUTSIDE]
        assert all(both[x] == whole[x] for x in ("ends", "step", "top"))
        assert dict(zip(both["depths"], both["commas"])) == dict(zip(whole["depths"], whole["commas"]))


ODD = [{"a": "}],{"}, 5, None, "x}y", [1, {"b": [2]}], {"t": 'quote " and \\ and \\" }{'}, {}, "", {"é": "漢字" * 40}]


@pytest.mark.parametrize("piece", [1, 7, 64, 4 << 20])
def test_files_in_pieces(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(arrays, "PIECE_BYTES", piece)
    monkeypatch.setattr(arrays, "BLOCK_PIECES", 3)
    for k, text in enumerate((json.dumps(ODD), json.dumps(ODD, indent=2, ensure_ascii=False), " [ ] ", "[1]", json.dumps([ODD] * 9))):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    want = {f"{k}.json": v for k, v in enumerate((ODD, ODD, [], [1], [ODD] * 9))}
    got = {name: {} for name in want}
    for r in arrays.read_array_elements(spark, str(tmp_path)).collect():
        file = got[r.source_file.rsplit("/", 1)[1]]
        assert r.record_index not in file
        file[r.record_index] = json.loads(r.value)
    assert {n: [v[k] for k in range(len(v))] for n, v in got.items()} == want


@pytest.mark.parametrize(
    "text",
    ["", "  ", "[", "[1", '["a', '["a\\', "[1]}", "[1]]", "[1] [2]", "[1] x", "x [1]", '{"a": 1}', "[1,]", "[,1]", "[1 2]", '[{"a": 1}, {"a"', '[{"a": 1]}', "[nul]"],
)
def test_unreadable(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="Not readable as one JSON array"):
        readers.read_json_array(spark, str(tmp_path / "a.json")).collect()


def test_elements_of_any_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ODD))
    found = readers.read_json_array(spark, str(tmp_path / "a.json")).selectExpr("record_index", "rejected", "to_json(record) AS j")
    assert {(r.record_index, r.rejected, r.j) for r in found.collect()} == {
        (k, not isinstance(v, dict), json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for k, v in enumerate(ODD)
    }


def test_an_array_beyond_one_value(spark, tmp_path):
    """140 MB in one line; a value of Spark's holds 128 MiB."""
    path, body = tmp_path / "large.json", "x" * 960
    with path.open("w") as f:
        f.write("[")
        for k in range(140_000):
            f.write(("," if k else "") + f'{{"id":{k},"t":"{body}\\"}}"}}')
        f.write("]")
    assert path.stat().st_size > 137_000_000
    began = time.time()
    records = readers.read_json_array(spark, str(path))
    row = records.selectExpr(
        "count(*) AS n", "count(DISTINCT record_index) AS d", "min(record_index) AS lo", "max(record_index) AS hi",
        "count_if(rejected) AS bad", "count_if(variant_get(record, '$.id', 'long') = record_index) AS same",
    ).first()
    assert tuple(row) == (140_000, 140_000, 0, 139_999, 0, 140_000)
    assert time.time() - began < 120


def one_by_one(raw, state):
    """The summary of a piece, byte by byte."""
    depth, top, commas = 0, 0, {}
    inside, escaped = state != arrays.OUTSIDE, state == arrays.ESCAPED
    for char in raw:
        if escaped and char in b'"\\':
            escaped = False
            continue
        escaped = False
        if char == ord("\\"):
            escaped = True
        elif char == ord('"'):
            inside = not inside
        elif not inside and char in b"[{":
            depth += 1
            top = max(top, depth)
        elif not inside and char in b"]}":
            depth -= 1
        elif not inside and char == ord(","):
            commas[depth] = commas.get(depth, 0) + 1
    ends = arrays.OUTSIDE if not inside else arrays.ESCAPED if escaped else arrays.INSIDE
    return {"ends": ends, "step": depth, "top": top, "depths": sorted(commas), "commas": [commas[d] for d in sorted(commas)]}


def test_summaries_for_all_states_look_at_the_bytes_once():
    rng = random.Random(5)
    pieces = [bytes(rng.choices(b'[]{},"\\ax\n', k=rng.randint(0, 40))) for _ in range(4000)]
    pieces += [bytes(rng.choices(b'[]{},"a', k=3000)), b"", b'"', b"\\", b'\\"', b"\\\\"]
    for raw in pieces:
        assert arrays.summaries(raw) == [one_by_one(raw, s) for s in (arrays.OUTSIDE, arrays.INSIDE, arrays.ESCAPED)], raw
