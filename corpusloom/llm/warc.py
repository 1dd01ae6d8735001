"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Records are text where payloads are, so archives are written by Spark's text writer with the two blank lines that end
a record as its line separator: the commit protocol covers lost executors, and any store that Spark reaches will do.
Whole files are gzipped. The reader goes by Content-Length alone, so payloads may hold anything, separators included. It
inflates a file piece by piece and holds one record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import staged, staging_path

LEAST_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
# archives are read a file at a time: a file has a task's pages, which Spark deals out by bytes, and not more than this
PAGES_PER_FILE = 4000


def _urn(kind: str, page_id, url, digest, copy) -> object:
    """A record id: a UUID cut from an MD5 of the page's id, url and payload digest, and of the row's number, which keeps
    equal rows apart. Ids and urls have their length before them, so that null is no empty string."""
    told = [F.coalesce(F.concat(F.lit("+"), F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in (page_id, url)]
    h = F.md5(F.concat_ws("|", F.lit(kind), *told, digest, copy.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """`pages` (page_id, url, html) with payload_bytes, payload_digest and refers_to: of equal payloads of `least_bytes`
    or more, the largest page_id (null: smallest) is the response that the others revisit; null where a page is one.

    Only digests are grouped, with a partial maximum for each; payloads are shuffled once, beside the few columns that
    tell revisits. `copy` numbers the rows by partition and place, without a group; `pages` is read twice, and has to give
    its rows in the same places, as a scan of files does."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    copy = F.monotonically_increasing_id().alias("copy")
    slim = pages.select("page_id", "url", copy, F.octet_length(payload).cast("long").alias("n"), F.sha1(F.encode(payload, "UTF-8")).alias("d")).where(F.col("n") >= least_bytes)
    groups = slim.groupBy("d", "n").agg(F.max(F.struct("page_id", "url", "copy")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = groups.select("d", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), F.col("first.copy").alias("refers_copy"))
    own = pages.select("page_id", "url", copy, payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"))
    met = own.join(groups, (own["payload_digest"] == groups["d"]) & (own["payload_bytes"] >= least_bytes), "left").drop("d")
    return met.withColumn("refers_to", F.when(~F.col("refers_to").eqNullSafe(F.col("page_id")), F.col("refers_to")))


def _record(kind: str, record_id, uri, headers: list, block) -> object:
    """A record without the blank lines at its end. headers: (name, value); a null value leaves the header out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF)]
    for name, value in [("WARC-Target-URI", uri), *headers]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Write three records for each page under `path`. Line ends in a url are left out of its header; null urls have
    no header. Null page ids are written as empty ones."""
    plan = plan_revisits(pages, least_bytes)
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace("url", r"[\r\n]+", "")
    host, target = F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1), F.regexp_extract(uri, r"^[^:]*://[^/?#]*([^#]*)", 1)
    own = lambda kind: _urn(kind, F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("copy"))
    response = own("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    kind = F.lit("application/http; msgtype=response")
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    refers = F.when(F.col("refers_to").isNotNull(), _urn("response", F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"), F.col("refers_copy")))
    asked = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))
    noted = F.concat(F.lit("pageId: "), pid, F.lit(CRLF))
    records = F.array(
        _record("request", own("request"), uri, [("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        F.when(
            F.col("refers_to").isNull(),
            _record("response", response, uri, [("WARC-Payload-Digest", digest), ("Content-Type", kind)], F.concat(http, F.col("html"))),
        ).otherwise(_record("revisit", response, uri, [("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), ("Content-Type", kind)], http)),
        _record("metadata", own("metadata"), uri, [("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], noted),
    )
    out = plan.select(F.explode(records).alias("value"))
    (
        out.write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
        .text(path)
    )


def _inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, gunzipped member by member, about `piece` at a time; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            out = d.decompress(data, piece)
            if not out and not d.unconsumed_tail and not d.eof:
                raise ValueError("a gzip member is cut short")
            data = d.unconsumed_tail
            if out:
                yield out
        data = d.unused_data


def parse(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of bytes that come in pieces; header names in lower case. Only the record at hand is
    held. Raises ValueError on a broken record."""
    source = iter([pieces] if isinstance(pieces, (bytes, bytearray)) else pieces)
    held, at, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended, at
        if not ended:
            piece = next(source, None)
            ended = piece is None
            if piece:
                del held[:at]
                at = 0
                held.extend(piece)
        return not ended

    while True:
        while len(held) - at < 2 and more():
            pass
        if at >= len(held):
            return
        if held[at : at + 2] == b"\r\n":
            at += 2
            continue
        while (end := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if end < 0 or held[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        head = {}
        for line in bytes(held[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size, at = int(head["content-length"]), end + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("a record is cut short")
        yield head, bytes(held[at : at + size])
        at += size


def _rows(data: bytes, with_payload: bool) -> Iterator[tuple]:
    for head, raw in parse(_inflated(data)):
        kind, body, n, ok, fields = head.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            cut = raw.find(b"\r\n\r\n")
            body, length = raw[cut + 4 :], re.search(rb"(?i)\r\ncontent-length: *(\d+)", raw[: cut + 2])
            n = int(length[1]) if length else len(body)
            if kind == "response":
                n, ok = len(body), head.get("warc-payload-digest", "") == "sha1:" + hashlib.sha1(body).hexdigest()
            else:
                body = None
        elif kind == "metadata":
            fields = [tuple(x.strip() for x in line.split(":", 1)) for line in raw.decode("utf-8", "replace").split(CRLF) if ":" in line]
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, n, ok, fields, body if with_payload else None


def read_records(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under `path`, plain or gzipped; digests of responses are checked."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in _rows(data.as_py(), with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, request, response and metadata (structs; null where a record
    is missing), refers_to (the capture that a revisit refers to).

    A record's transaction is the one that it is concurrent to, else its own id. That puts the three-way join on one
    shuffle: a full outer join of the three kinds is a grouping by transaction with one value of each kind. Of repeated
    records the one with the smallest id stays."""
    r = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    body = F.struct("record_id", "record_type", "refers_to_id", "target_uri", "payload_digest", "payload_bytes", "digest_ok", "payload")
    met = r.groupBy("capture_id").agg(
        F.min_by(F.struct("record_id", "target_uri"), F.when(F.col("record_type") == "request", F.col("record_id"))).alias("request"),
        F.min_by(body, F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id"))).alias("response"),
        F.min_by(F.struct("record_id", "fields"), F.when(F.col("record_type") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    return met.withColumn("refers_to", F.col("response.refers_to_id"))


def captures(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Write `pages` to archives in the shared folder, read them back, and assemble a nested row per capture, with the
    page ids of the page itself and of the response that a revisit refers to. Needs page_id, url, html.

    Null html is an empty payload. Each row is a capture of its own, equal rows too. Null page ids stay null, and are referred to only where a payload has no other. An
    empty table gives no rows."""
    spark = pages.sparkSession
    path = staging_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    met = staged(assemble(read_records(spark, path, with_payload)), "warc-captures")
    page = F.col("metadata")["fields"]["pageId"].try_cast("long").alias("page_id")
    named = met.withColumn("page_id", page)
    told = named.where("response.record_type = 'response'").select(F.col("capture_id").alias("rid"), F.col("page_id").alias("refers_to_page"))
    told = told.join(named.where("refers_to is not null").select(F.col("refers_to").alias("rid")).distinct(), "rid", "left_semi")
    return named.join(told, named["refers_to"] == told["rid"], "left").drop("rid")
