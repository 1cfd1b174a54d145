"""WARC archives: writing captures as transactions, and putting them together again.

A capture is written as three records: the response (or, where an earlier-known
payload comes again, a revisit), the request and a metadata record; the last two
name the first in WARC-Concurrent-To.  Reading parses records as a stream, and
``transactions`` joins the records of a capture through those names into one
nested row.

Archives are gzip files written and read by Spark's text source with the four
bytes that end a record as line separator.  A gzip file is read by one task from
front to end, so records may hold that separator: the parser puts the pieces
back and counts bytes.  It holds one record at a time.

Defined results: a missing payload is empty; a missing URL is left out; a page
without an id is a capture of its own and names no response; of rows that share
the greatest page id of a payload each is a response; repeated rows give a
nested row each (equal record names are paired in order); requests and metadata
without a response are dropped, responses without them have nulls; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillmark.operators.joins import spread_join

CRLF = "\r\n"
RECORD_END = CRLF * 2
#: Payloads below this many bytes are always written in full.
LEAST_REVISIT = 1_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one archive file at most.
CAPTURES_PER_FILE = 50_000


# --------------------------------------------------------------------- writing


def _name(kind: str, *parts: Column) -> Column:
    """A record name made from its parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    pieces = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), value))  # null: left out by concat_ws
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END), block)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, bytes, digest, keeper): ``keeper`` is the page that holds the payload."""
    known = pages.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    narrow = known.filter(F.col("bytes") >= least).select("digest", "page_id")
    again = narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return spread_join(known, again, ["digest"], F.coalesce("page_id", F.lit(0)), "left", counted=narrow)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the captures of ``pages`` as archives below ``folder``."""
    narrow = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        # a URL is one header line
        F.replace(F.replace(F.col(url).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    known = with_revisits(narrow).withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))
    own = _name("response", F.col("page_id"), F.col("digest"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(RECORD_END),
    )
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", DATE)]
    main = F.when(
        F.col("revisit"),
        _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE),
             ("WARC-Refers-To", _name("response", F.col("keeper"), F.col("digest"))), ("Content-Type", "application/http;msgtype=response")],
            http,
        ),
    ).otherwise(
        _record(
            [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest),
             ("Content-Type", "application/http;msgtype=response")],
            F.concat(http, F.col("payload")),
        )
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _name("request", F.col("page_id"), F.col("digest"))), ("WARC-Concurrent-To", own),
         *common, ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{RECORD_END}")),
    )
    about = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _name("metadata", F.col("page_id"), F.col("digest"))), ("WARC-Concurrent-To", own),
         *common, ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    rows = known.select(F.explode(F.array(main, request, about)).alias("value"))
    writer = rows.write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(folder)


# --------------------------------------------------------------------- reading

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, url string, date string, "
    "page_id long, payload binary, payload_bytes long, payload_digest string"
)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _hex(digest: str | None) -> str | None:
    """SHA-1 of a digest field, written in hex or base 32."""
    if digest is None or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parsed(head: bytes, block: bytes) -> tuple:
    f = _fields(head)
    kind = f.get("warc-type")
    page = payload = size = digest = None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        else:
            told = _fields(http).get("content-length")
            size, digest, payload = int(told) if told else None, _hex(f.get("warc-payload-digest")), None
    elif kind == "metadata":
        told = _fields(block).get("page-id")
        page = int(told) if told else None
    named = (f.get(n) for n in ("warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date"))
    return kind, *named, page, payload, size, digest


class Stream:
    """Cuts pieces that lay between separators into records."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size = 0
        self.need = 0

    def add(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        self.held += [piece, b"\r\n\r\n"]
        self.size += len(piece) + 4
        while self.size >= self.need:
            whole = b"".join(self.held)
            start = len(whole) - len(whole.lstrip(b"\r\n"))
            cut = whole.find(b"\r\n\r\n", start)
            if cut < 0 or not whole.startswith(b"WARC/", start):
                rest, self.need = whole[start:], 0
                if rest and not rest.startswith(b"WARC/"[: len(rest)]):
                    raise ValueError(f"not a WARC record: {rest[:60]!r}")
                self.held, self.size = [rest], len(rest)
                return
            length = int(_fields(whole[start:cut]).get("content-length", 0))
            self.need = cut + 4 + length
            if len(whole) < self.need:
                self.held, self.size = [whole], len(whole)
                return
            yield whole[start:cut], whole[cut + 4 : self.need]
            rest = whole[self.need :]
            self.held, self.size, self.need = [rest], len(rest), 0
            if not rest.strip(b"\r\n"):
                self.held, self.size = [], 0
                return


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives below ``folder``."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in RECORD.split(", ")]
        stream, now = Stream(), None
        for batch in rows:
            found = []
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                if path != now:
                    stream, now = Stream(), path
                found += [parsed(head, block) for head, block in stream.add(value)]
            columns = list(zip(*found)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    read = spark.read.option("lineSep", RECORD_END).text(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(batches, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the fields of its response or revisit, ``request`` and ``metadata``."""
    kinds = {"main": F.col("type").isin("response", "revisit"), "request": F.col("type") == "request", "metadata": F.col("type") == "metadata"}
    sides = {}
    for kind, of in kinds.items():
        own = F.col("record_id") if kind == "main" else F.col("concurrent_to")
        side = records.filter(of).withColumn("capture", own).filter("capture is not null")
        order = Window.partitionBy("capture").orderBy("record_id", "date")
        sides[kind] = side.withColumn("nth", F.row_number().over(order))
    out = sides["main"].drop("page_id", "concurrent_to")
    for kind, columns in (("request", ("record_id", "url", "date")), ("metadata", ("record_id", "page_id", "date"))):
        nested = sides[kind].select("capture", "nth", F.struct(*columns).alias(kind))
        out = out.join(nested, ["capture", "nth"], "left")
    return out.drop("capture", "nth")


def resolved(captures: DataFrame) -> DataFrame:
    """``captures`` with ``refers_to_page``: the page of the response that a revisit names."""
    responses = captures.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("metadata.page_id").alias("refers_to_page"))
    named = responses.groupBy("refers_to").agg(F.max("refers_to_page").alias("refers_to_page"))
    revisits = captures.filter("refers_to is not null")
    found = spread_join(revisits, named, ["refers_to"], F.col("record_id"), "left")
    return captures.filter("refers_to is null").unionByName(found, allowMissingColumns=True)
