"""WARC archives of captured pages, and transactions assembled from their records.

A capture is three records: the request, the response (or the revisit that stands
for it) and metadata. Request and metadata name the response's record by
WARC-Concurrent-To. Archives are written by Spark's text writer, whose line end is
the two line breaks that close a record, and read back as whole files of bounded
size whose records are cut by Content-Length. Assembly joins the records of a
capture by those identifiers, wherever the records lie.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.session import shared_folder

#: Payloads from this size on are stored once and revisited.
REVISIT_BYTES = 100

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string,"
    " payload_digest string, content_type string, content_length bigint, block binary"
)


def captures(pages: DataFrame) -> DataFrame:
    """One row per page with payload, digest, record type and the page a revisit refers to.

    A null html is an empty payload. Of equal payloads of REVISIT_BYTES or more the
    smallest page_id is the response. Rows that repeat page_id, url and html are one
    capture; a page_id with several urls or payloads has one capture for each. No
    revisit refers to a null page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumns(
        {"payload_digest": F.sha2(payload, 256), "payload_bytes": F.octet_length(payload).cast("bigint")}
    )
    keys = rows.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    # copies are counted away in each task before the shuffle, so a hot payload is a few rows
    first = (
        keys.groupBy("payload_digest")
        .agg(F.min(F.struct("page_id", "url")).alias("_first"))
    )
    joined = rows.join(first, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first.page_id")).alias("refers_to"),
        F.when(again, F.col("_first.url")).alias("refers_url"),
    )


def _id(kind: str, page: Column, url: Column, digest: Column) -> Column:
    name = F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), F.substring(digest, 1, 16), F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 8))
    return F.concat(F.lit("<urn:capture:"), name, F.lit(f":{kind}>"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record up to its closing line breaks; null fields are left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], length, block)


def records(found: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Three record texts per capture."""
    page, url, digest = F.col("page_id"), F.col("url"), F.col("payload_digest")
    uri = F.regexp_replace(url, r"[\r\n]", "%0A")
    response = _id("response", page, url, digest)
    target = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    revisit = F.col("record_type") == "revisit"
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    stored = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col("html"), F.lit(""))))
    refers = F.when(revisit, _id("response", F.col("refers_to"), F.col("refers_url"), digest))
    main = _record(
        [
            ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", response), *target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            ("WARC-Refers-To", refers),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        stored,
    )
    path = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://[^/]+(/[^#]*)", 1), F.lit(""))
    request = _record(
        [
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _id("request", page, url, digest)), *target,
            ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _id("metadata", page, url, digest)), *target,
            ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(
            F.coalesce(F.concat(F.lit("pageId: "), page.cast("string"), F.lit("\r\n")), F.lit("")),
            F.lit("payloadLength: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"),
        ),
    )
    return found.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(found: DataFrame, folder: str | None = None, file_records: int = 3_000) -> str:
    """Write the captures' records as gzip archives of at most ``file_records`` records; the folder."""
    spark = found.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    options = {"lineSep": "\r\n\r\n", "compression": "gzip", "maxRecordsPerFile": file_records}
    records(found).write.options(**options).text(folder)
    return folder


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder, cut by Content-Length; no row for an empty folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for raw in batch.column(0):
                data = memoryview(raw.as_buffer())
                if bytes(data[:2]) == b"\x1f\x8b":
                    whole = bytearray()
                    while len(data):  # an archive may have many gzip members
                        member = zlib.decompressobj(31)
                        whole += member.decompress(data)
                        data = memoryview(member.unused_data)
                    data = memoryview(whole)
                rows = []
                for row in parsed(data):
                    rows.append(row)
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("length") > 0).select("content").mapInArrow(run, RECORD)


NAMES = [x.split()[0] for x in RECORD.split(", ")]
FIELDS = [b"warc-record-id", b"warc-type", b"warc-concurrent-to", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest", b"content-type"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


def parsed(data: memoryview) -> Iterator[tuple]:
    """Records of an archive in order; raises on one that isn't whole."""
    text, at = data.obj if isinstance(data.obj, bytearray) and len(data) == len(data.obj) else bytes(data), 0
    while at < len(text):
        end = text.find(b"\r\n\r\n", at)
        if end < 0 or not text.startswith(b"WARC/", at):
            raise ValueError(f"no record starts at byte {at}")
        lines = bytes(text[at:end]).split(b"\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        length = int(fields[b"content-length"])
        block = bytes(text[end + 4 : end + 4 + length])
        if len(block) < length:
            raise ValueError(f"the record at byte {at} is cut off")
        yield (*(fields[f].decode() if f in fields else None for f in FIELDS), length, block)
        at = end + 4 + length + 4


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata.

    Records meet by the identifier of the response: its own, or the one that request
    and metadata are concurrent to. A capture without one of them has null there. Of
    records that repeat an identifier one is kept; its members are equal when the
    archives repeat a record.
    """
    key = F.coalesce("concurrent_to", "record_id")
    whole = F.struct("record_type", *[n for n in found.columns if n != "record_type"])
    of = lambda *kinds: F.max(F.when(F.col("record_type").isin(*kinds), whole))
    return found.groupBy(key.alias("capture_id")).agg(
        of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata")
    )


def with_payloads(found: DataFrame) -> DataFrame:
    """Records with the payload's own digest and size in place of the block of a response.

    The digest of a response is computed from the bytes read; a revisit's is the one
    it states. Other blocks stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                payload, digest = None, row["payload_digest"]
                if row["record_type"] == "response":
                    payload = row["block"][row["block"].find(b"\r\n\r\n") + 4 :]
                    computed = "sha256:" + hashlib.sha256(payload).hexdigest()
                    if digest not in (None, computed):
                        raise ValueError(f"payload digest of {row['record_id']} doesn't match its bytes")
                    digest = computed
                block = None if row["record_type"] in ("response", "revisit") else row["block"]
                rows.append((*(row[n] for n in NAMES[:5]), digest, row["content_type"], row["content_length"], block, None if payload is None else len(payload)))
            kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*NAMES, "payload_bytes"])

    return found.mapInArrow(run, RECORD + ", payload_bytes bigint")
