import hashlib

import public_tokenizers
import pytest
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from drillmark.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.mark.parametrize("chunk, overlap", [(byte_pairs.CHUNK, byte_pairs.OVERLAP), (100, 30)])
def test_against_the_encoder(spark, chunk, overlap):
    encode = byte_pairs.encoder(PATH).encode_ordinary
    want = []
    for r in rows():
        ids = encode(r[2] or "")
        want.append((str(r[1]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[2] or "").encode()).hexdigest()))
    got = byte_pairs.round_trip(frame(spark), PATH, chunk=chunk, overlap=overlap).collect()
    assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


texts = st.text(st.sampled_from("ab' 1\n\t.!é s漢"), max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 30), st.integers(0, 12), st.integers(0, 40))
def test_stitched_boundaries_are_those_of_one_scan(text, chunk, overlap, run):
    text += "x" * run + " end"
    want = byte_pairs.boundaries(text, PATTERN, True)
    scans = []
    for a in range(0, len(text), chunk):
        whole = len(text) <= a + chunk + overlap
        scans.append([a + e for e in byte_pairs.boundaries(text[a : a + chunk + overlap], PATTERN, whole)])
    pieces = byte_pairs.stitch(text, scans, PATTERN, chunk)
    assert [e for _, ends in pieces for e in ends] == want
    assert [a for a, _ in pieces] == [0, *[ends[-1] for _, ends in pieces[:-1]]]


def test_decoded(spark):
    table = spark.createDataFrame([([15496, 995],), ([],), (None,)], "ids array<int>")
    assert [r.bytes for r in byte_pairs.decoded(table, "ids", PATH).collect()] == [b"Hello world", b"", None]


def test_empty(spark):
    assert byte_pairs.round_trip(empty(spark), PATH).collect() == []
