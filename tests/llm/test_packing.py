import zlib

import numpy as np
import public_tokenizers
from corpus import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from drillmark.llm import byte_pairs, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_tokenizer(spark):
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    want = sorted((str(r[1]), [*tool.encode(r[2] or "", add_special_tokens=False).ids, 1]) for r in rows())
    found = packing.pack(frame(spark), PATH, ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    docs = {}
    for r in found:
        docs.setdefault((str(r.id), r.doc_tokens), []).append((r.start, r.ids))
    got = []
    for (id, _), parts in docs.items():
        starts = [s for s, _ in parts]
        copies = starts.count(0)
        whole = [i for _, ids in sorted(parts)[::copies] for i in ids]
        got += [(id, whole)] * copies
    assert sorted(got) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= packing.SEQUENCE
    assert sorted(sequences) == list(range(len(sequences)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = {}
    for packs, pattern in patterns:
        assert packs > 0 and sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for n in pattern:
            held[n] = held.get(n, 0) + packs
    assert held == histogram
    lengths, ranks, first, offsets = packing.places(patterns)
    for n, count in histogram.items():
        assert ranks[lengths == n].min() == 0 and ranks[lengths == n].max() < count


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048)
    patterns = packing.shortest_pack_first({int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))})
    assert lengths.sum() / (2048 * sum(p for p, _ in patterns)) > 0.98


def test_ids_equal_the_tokenizers_on_odd_texts():
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    for text in ["", " ", "a  b\n\n c   d", "don't DON'T 12345 ½²", "<|endoftext|> x", "naïve 漢字 ١٢٣ 👩‍👩‍👧", "\u0085x\x1cy᠎z"]:
        assert byte_pairs.ids_of(text, PATH).tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_have_their_own_ids(spark):
    tool = Tokenizer.from_file(PATH)  # in its default setting
    end = "<|endoftext|>"
    odd = ["", "a <|endoftext|> b", end, end * 3, f" {end}\n{end}  x", f"<{end}>", "<|endoftext|", f"don't{end}'t stop", "x <|ENDOFTEXT|>", f"{'long words ' * 300}{end}{'漢字 ' * 900}{end}"]
    data = [("k", k, t, "d", 1, "i", "s", "en", "s") for k, t in enumerate(odd)]
    docs = {}
    for r in packing.pack(frame(spark, data), PATH, ids=True).collect():
        docs.setdefault(r.id, []).append((r.start, r.ids))
    got = {id: [i for _, ids in sorted(parts) for i in ids] for id, parts in docs.items()}
    assert got == {k: [*tool.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(odd)}


def test_parts_are_encoded_as_the_whole():
    text = "some words and   more\n\nwords " * 50
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = byte_pairs.encoder(path).encode_ordinary(text)
    parts = [i for p in byte_pairs.parts_of(text, 20) for i in byte_pairs.encoder(path).encode_ordinary(p)]
    assert parts == whole and len(list(byte_pairs.parts_of(text, 20))) > 20


def test_empty(spark):
    assert packing.pack(empty(spark), PATH).collect() == []
