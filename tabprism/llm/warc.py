"""Web archives (operator 5): write WARC records, read them back, assemble transactions.

**Writing.**  Each page becomes three records: a request, a response (or a
revisit) and a metadata record.  The response and the metadata record name the
request in ``WARC-Concurrent-To``.  A record is one row of Spark's text sink:
header block, empty line, content, and the sink's line separator is the two
line ends that close a record.  So the files come from Spark's own committed
writer, whatever the store, gzip-compressed.  ``records_per_file`` bounds a
file.

**Reading.**  ``binaryFile`` rows are parsed record by record by
``Content-Length`` (never by a separator, which a payload may contain).

**Assembly.**  Requests, responses and metadata are joined on the request's
identifier into one nested row per capture; a revisit takes length and digest
of its payload from the response it refers to.  Both are taken from the stored
payload before the joins, so a reader that needs only them shuffles no payload.

Equal payloads are found by SHA-256 and length of the whole payload.  Defined
results: a null payload is empty; a null page id ranks lowest and a revisit
of a response without an id refers to null; rows equal in id and payload are
written, and read back, once each; a null URL leaves the target out; control
characters in a URL are percent-encoded, so that they cannot break a header.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprism.llm.common import materialise

VERSION = "WARC/1.1"
EOL = "\r\n"

RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
          "content_type string, payload_digest string, page_id string, block_bytes long, http_bytes long, payload binary")


def _urn(c: Column) -> Column:
    """A SHA-256 text as a name in the UUID namespace's form."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(c, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
                                                          "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(pairs: list[tuple[str, Column]]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(F.lit(VERSION + EOL), *[
        F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(EOL)), F.lit("")) for k, v in pairs])


def _record(pairs: list[tuple[str, Column]], block: Column) -> Column:
    return F.concat(_header([*pairs, ("Content-Length", F.octet_length(block).cast("string"))]), F.lit(EOL), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z",
               records_per_file: int = 3000) -> str:
    """Write the archive into the folder ``path``; returns it.

    Of equal payloads of at least ``min_revisit_bytes`` the one with the
    largest key is a response, the others revisit it.
    """
    p = pages.select(F.col(key).cast("string").alias("_id"), F.col(key).alias("_key"), F.col(url).alias("_url"),
                     F.coalesce(F.col(payload), F.lit("")).alias("_body"))
    p = p.withColumn("_bytes", F.octet_length("_body").cast("long")).withColumn(
        "_sum", F.when(F.col("_bytes") >= min_revisit_bytes, F.sha2("_body", 256)))
    groups = (p.where(F.col("_sum").isNotNull()).groupBy("_sum")
              .agg(F.max("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).select("_sum", "_first"))
    # one name per written row: the request's; named before the rows fan out into records
    p = (p.join(groups, "_sum", "left").withColumn("_name", F.uuid())
         .withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f]", "%20")
    stamp = F.lit(date)
    request_id = _urn(F.sha2(F.concat_ws("|", F.col("_name"), F.lit("request")), 256))
    meta_id = _urn(F.sha2(F.concat_ws("|", F.col("_name"), F.lit("metadata")), 256))
    own = F.sha2(F.concat_ws("|", F.lit("response"), F.col("_id"), F.col("_sum")), 256)
    first = F.sha2(F.concat_ws("|", F.lit("response"), F.col("_first").cast("string"), F.col("_sum")), 256)
    # a response that others may refer to is named by its content; any other record by its row
    loose = F.sha2(F.concat_ws("|", F.col("_name"), F.lit("capture")), 256)
    named = F.col("_first").isNotNull() & ~F.col("_revisit")
    digest = F.concat(F.lit("sha1:"), F.sha1("_body"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.col("_bytes").cast("string"), F.lit(EOL + EOL))
    ask = F.concat(F.lit("GET / HTTP/1.1" + EOL), F.lit("User-Agent: archiver" + EOL + EOL))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", request_id), ("WARC-Date", stamp),
                       ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    capture = F.when(F.col("_revisit"), _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", _urn(loose)), ("WARC-Date", stamp),
         ("WARC-Target-URI", uri), ("WARC-Concurrent-To", request_id), ("WARC-Refers-To", _urn(first)),
         ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], http)).otherwise(
        _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", _urn(F.when(named, own).otherwise(loose))),
                 ("WARC-Date", stamp), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", request_id),
                 ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))],
                F.concat(http, F.col("_body"))))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("_id"), F.lit(EOL)), F.lit("note: no page id" + EOL))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta_id), ("WARC-Date", stamp),
                        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", request_id),
                        ("Content-Type", F.lit("application/warc-fields"))], fields)
    (p.select(F.explode(F.array(request, capture, metadata)).alias("value"))
     .write.option("lineSep", EOL + EOL).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive file, read by Content-Length; damaged bytes raise ValueError."""
    at, n = 0, len(data)
    view = memoryview(data)
    while at < n:
        head_end = data.find(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split(EOL) if head_end >= 0 else []
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        begin = head_end + 4
        if data[begin + size:begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield {"head": head, "block": view[begin:begin + size]}
        at = begin + size + 4


def _inflate(data: bytes) -> bytes:
    """All gzip members of a file, or the bytes themselves if it isn't compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) or data


def _parse_batches(batches):
    schema = pa.schema([(n, pa.int64() if n.endswith("_bytes") else pa.binary() if n == "payload" else pa.string())
                        for n in (f.split()[0] for f in RECORD.split(", "))])

    def made(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for b in batches:
        for i in range(b.num_rows):
            rows, held = [], 0
            for r in parse_records(_inflate(b.column("content")[i].as_py())):
                h, block = r["head"], r["block"]
                kind, http, payload, page = h.get("warc-type"), 0, None, None
                if kind in ("response", "revisit"):
                    http = bytes(block[:65536]).find(b"\r\n\r\n") + 4
                    http = 0 if http < 4 else http
                    payload = bytes(block[http:]) if kind == "response" else None
                elif kind == "metadata":
                    fields = dict(x.split(": ", 1) for x in bytes(block).decode("utf-8").split(EOL) if ": " in x)
                    page = fields.get("page-id")
                held += len(payload or b"")
                rows.append({"type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"),
                             "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
                             "date": h.get("warc-date"), "content_type": h.get("content-type"),
                             "payload_digest": h.get("warc-payload-digest"), "page_id": page,
                             "block_bytes": len(block), "http_bytes": http, "payload": payload})
                if held > 8_000_000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``.gz`` archives below ``path``, one row each."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
             .load(path).select("content"))
    return files.mapInArrow(_parse_batches, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (request, response, metadata) structs.

    ``response.record_type`` is response or revisit; a capture whose request
    or metadata record is missing keeps null there.  ``response.payload_bytes``
    and ``response.payload_sha1`` are those of the stored payload.
    """
    r = records
    capture = r.where(F.col("type").isin("response", "revisit")).select(
        F.col("concurrent_to").alias("_to"), F.struct(
            F.col("type").alias("record_type"), "record_id", "refers_to", "target_uri", "date", "content_type",
            "payload_digest", "http_bytes", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_sha1")).alias("response"))
    request = r.where(F.col("type") == "request").select(
        F.col("record_id").alias("_to"), F.struct("record_id", "target_uri", "date", "block_bytes").alias("request"))
    metadata = r.where(F.col("type") == "metadata").select(
        F.col("concurrent_to").alias("_to"), F.struct("record_id", "page_id", "date").alias("metadata"))
    return (capture.join(request, "_to", "left").join(metadata, "_to", "left")
            .select("request", "response", "metadata"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per capture.

    Length and digest are those of the stored payload; a revisit looks them
    up at the response that it refers to.
    """
    flat = captures.select(
        F.col("metadata.page_id").cast("long").alias("page_id"), F.col("response.record_type").alias("record_type"),
        F.col("response.record_id").alias("_rid"), F.col("response.refers_to").alias("_ref"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_digest"))
    flat = materialise(flat, "warc-captures")      # narrow rows; both sides below read them
    responses = flat.where(F.col("record_type") == "response")
    known = (responses.groupBy(F.col("_rid").alias("_ref"))
             .agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"),
                  F.max("payload_digest").alias("_digest")))
    revisits = flat.where(F.col("record_type") == "revisit").join(known, "_ref", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (responses.withColumn("refers_to", F.lit(None).cast("long")).select(*cols)
            .unionByName(revisits.select("page_id", F.col("_bytes").alias("payload_bytes"),
                                         F.col("_digest").alias("payload_digest"), "record_type",
                                         F.col("_page").alias("refers_to"))))
