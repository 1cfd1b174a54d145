import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drillmark.llm import captures

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def pages():
    body = "<p>" + "long page " * 120 + "</p>"
    return [
        (1, "http://a/1", body), (2, "http://a/2", body), (9, "http://a/9", body), (3, None, None), (4, "http://a/4", ""),
        (5, "http://b/\r\nX: y", "small"), (6, "http://b/6", "small"), (7, "http://b/7", "tail\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (8, "http://b/8", "é漢" * 400), (10, "http://b/10", "é漢" * 400), (10, "http://b/10", "é漢" * 400), (None, "http://c", "no id " * 300),
        (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "\r\n" * 5),
    ]


def test_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(*p, "d", "p") for p in pages()], SCHEMA).repartition(2)
    captures.write_archives(table, str(tmp_path / "warc"))
    records = captures.read_archives(spark, str(tmp_path / "warc"))
    assert records.count() == 3 * len(pages())
    found = captures.resolved(captures.transactions(records)).collect()
    want = []
    for id, url, html in pages():
        raw = (html or "").encode()
        keeper = max((p[0] for p in pages() if p[0] is not None and (p[2] or "") == (html or "")), default=None)
        again = len(raw) >= 1000 and keeper is not None and keeper != id
        want.append((str(id), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(keeper if again else None), None if again else raw))
    got = [
        (str(r.metadata.page_id), r.payload_bytes, r.payload_digest, r.type, str(r.refers_to_page), None if r.payload is None else bytes(r.payload))
        for r in found
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.request is not None and r.request.url == r.url for r in found)


def test_records_of_other_writers():
    block = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nbody"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <urn:x>\r\nContent-Length: %d" % len(block)
    kind, id, *_, payload, size, digest = captures.parsed(head, block)
    assert (kind, id, payload, size, digest) == ("response", "<urn:x>", b"body", 4, hashlib.sha1(b"body").hexdigest())
    assert captures._hex("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ") == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\x00", b"\r\n\r\n").replace(b"\x01", b"\r\n")), max_size=6))
def test_stream_gives_back_any_block(blocks):
    whole = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    pieces = whole.split(b"\r\n\r\n")
    if not pieces[-1]:
        pieces.pop()
    stream = captures.Stream()
    assert [b for p in pieces for _, b in stream.add(p)] == blocks


def test_broken_archives_fail():
    with pytest.raises(ValueError):
        list(captures.Stream().add(b"no archive at all"))


def test_empty(spark, tmp_path):
    captures.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert captures.read_archives(spark, str(tmp_path / "none")).collect() == []
