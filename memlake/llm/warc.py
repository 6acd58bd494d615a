"""WARC archives: write captures, read records, assemble transactions.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the
response by ``WARC-Concurrent-To``. Archives are gzipped WARC files made by Spark's text writer: the
end of a record (two empty lines) is its line separator, so they lie on any file system that Spark
writes to. Readers go by ``Content-Length`` alone, so a payload may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
DATE = "2020-01-01T00:00:00Z"
FILE_CAPTURES = 2000  # captures in an archive file
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, kind string, concurrent_to string, refers_to string, uri string, digest string, content_type string, "
          "payload binary, payload_bytes bigint, payload_digest string")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four digits for every five hexadecimal ones."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (left out where null), an empty line, the block."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines, length), F.lit(END + END), block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
          date: str = DATE) -> None:
    """Write one capture per row of ``pages``; the payload is the html (null: empty).

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are responses and
    the others revisit that id. A null id counts as the largest; if all ids of a payload are null, all
    its rows are responses. Rows that repeat id and payload are alike. Urls may be null.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = base.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("bigint"))
    firsts = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"))
    # Unique in the job; the three records of a capture are made from one row, so they agree.
    known = rows.join(firsts, ["digest", "bytes"], "left").withColumn("mark", F.hex(F.monotonically_increasing_id()))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda kind: F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), "mark", F.lit(f":{kind}>"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    common = lambda kind, type_: [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), ("Content-Type", F.lit(type_))]
    response = _record([*common(F.when(again, "revisit").otherwise("response"), "application/http;msgtype=response"), ("WARC-Record-ID", name("response")),
                        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(again, PROFILE)),
                        ("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))],
                       F.when(again, http).otherwise(F.concat(http, "html")))
    request = _record([*common("request", "application/http;msgtype=request"), ("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", name("response"))],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")))
    metadata = _record([*common("metadata", "application/json"), ("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", name("response"))],
                       F.to_json(F.struct(F.col("id").alias("page_id"), "url", F.col("bytes").alias("payload_bytes"))))
    (known.select(F.concat_ws(END + END, request, response, metadata).alias("value"))
     .write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(path))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record. A broken archive raises ``ValueError``."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one was due: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends inside a record")
        yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``, as the columns of ``RECORD``.

    The payload of an HTTP block is what follows its header; of other records it is the block. Size
    and digest are those of the payload read. Files may be gzipped or plain.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in RECORD.split(",")]
        kinds = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string()]

        def rows(content: bytes) -> Iterator[tuple]:
            raw = io.BytesIO(content)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
            for h, block in parse(stream):
                payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                yield (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"),
                       h.get("content-type"), payload, len(payload), b32encode(hashlib.sha1(payload).digest()).decode())

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for b in batches:
            for content in b.column("content"):
                held: list[tuple] = []
                for row in rows(content.as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata): one nested row per capture.

    Request and metadata join the response or revisit record that they are concurrent to. What is missing is null:
    a response may stand alone, and records whose response is absent still give a row. Of several
    requests or metadata records of one capture the first by record id is taken; records without
    an id to join on are left out.
    """
    whole = F.struct("record_id", "kind", "refers_to", "uri", "digest", "content_type", "payload", "payload_bytes", "payload_digest")
    main = records.where("kind IN ('response', 'revisit') AND record_id IS NOT NULL").select(F.col("record_id").alias("capture_id"), whole.alias("response"))

    def first(kind: str) -> DataFrame:
        rows = records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "uri", "content_type", "payload")).alias(kind))

    return (main.join(first("request"), "capture_id", "full_outer").join(first("metadata"), "capture_id", "full_outer")
            .select("capture_id", "request", "response", "metadata"))
