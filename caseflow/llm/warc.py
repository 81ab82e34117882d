"""A content-addressed WARC archive.

`write_archive` writes one WARC/1.1 record per page to gzip files in the shared folder:
the page with the smallest id among equal payloads as a response with the payload, the
others as revisits without it. `read_records` parses the files again, a stream per file,
and checks every stored payload against its SHA-256. `reconstruct` joins the payload store
and the record headers on the digest, which gives every original record whole again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import require, shared_folder
from caseflow.operators.skew import broadcast_if_small

#: Payloads of fewer bytes are stored each time.
MIN_SHARED = 100
#: Digests of repeated payloads that are broadcast at most; beyond that, a shuffle join.
BROADCAST_DIGESTS = 200_000
RECORDS_PER_FILE = 10_000
DATE = "1970-01-01T00:00:00Z"
#: Ends a record, and ends its headers too.
BREAK = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LAST = 2**63 - 1
_BATCH_BYTES = 16 << 20


def _line(name: str, value: Column) -> Column:
    """A header line, none if the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def _one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def described(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, payload, bytes, digest, copy, refers (struct, NULL for
    responses): what record each row becomes.

    A NULL html is an empty payload. Without page_id a row comes after all others. Of rows
    equal in id and digest the first by url is the response; wholly equal rows are numbered
    by `copy`, and the first copy is.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = require(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("bytes"), F.sha2(payload, 256).alias("digest"),
    )
    order = F.struct(F.coalesce("page_id", F.lit(_LAST)).alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    shared = rows.filter(F.col("bytes") >= MIN_SHARED).groupBy("digest")
    repeated = shared.agg(F.count("*").alias("n"), F.min(order).alias("head")).filter("n > 1").drop("n")
    joined = rows.join(broadcast_if_small(repeated, BROADCAST_DIGESTS), "digest", "left")
    # Rows equal in everything are rare: only those of a repeated payload are counted.
    same = joined.filter(order == F.col("head")).groupBy("digest").agg(F.count("*").alias("_twins")).filter("_twins > 1")
    if same.isEmpty():
        numbered = joined.withColumn("copy", F.lit(1))
    else:
        own = joined.filter((order == F.col("head")) & F.col("head").isNotNull())
        twins = own.join(same, "digest", "left_semi").groupBy("page_id", "url", "payload", "bytes", "digest", "head")
        twins = twins.agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        is_twin = (order == F.col("head")) & F.col("head").isNotNull()
        rest = joined.join(same.withColumn("_twin", F.lit(True)), "digest", "left")
        rest = rest.filter(F.col("_twin").isNull() | ~F.coalesce(is_twin, F.lit(False)))
        columns = ["page_id", "url", "payload", "bytes", "digest", "head"]
        numbered = rest.select(*columns, F.lit(1).alias("copy")).union(twins.select(*columns, "copy"))
    is_response = F.col("head").isNull() | ((order == F.col("head")) & (F.col("copy") == 1))
    refers = F.when(~is_response, F.col("head"))
    return numbered.select("page_id", "url", "payload", "bytes", "digest", "copy", refers.alias("refers"))


def _record_id(page: Column, url: Column, copy: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", page.cast("string"), url, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def record_text(rows: DataFrame, date: str = DATE) -> DataFrame:
    """The rows of `described` as WARC records without their final break (column value)."""
    revisit = F.col("refers").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(BREAK),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.when(F.col("refers.id") < _LAST, F.col("refers.id"))
    headers = F.concat(
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(head, F.col("refers.url"), F.lit(1)))),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("Refers-To-Page", F.when(revisit, head).cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(headers, F.lit(BREAK), block).alias("value"))


def write_archive(pages: DataFrame, folder: str | None = None, date: str = DATE) -> str:
    """Write a record per row of `pages` and return the folder."""
    folder = folder or shared_folder(pages.sparkSession)
    writer = record_text(described(pages), date).write.option("lineSep", BREAK).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of each record of a gzip file, which is unpacked bit by bit."""
    unpack = zlib.decompressobj(wbits=47)
    held, at = bytearray(), 0
    end = BREAK.encode()

    def more() -> bool:
        nonlocal at
        if at >= len(data):
            return False
        held.extend(unpack.decompress(data[at : at + (1 << 18)]))
        at += 1 << 18
        return True

    while True:
        while (cut := held.find(end)) < 0:
            if not more():
                if held:
                    raise ValueError(f"{len(held)} bytes without a record")
                return
        headers = bytes(held[:cut])
        size = int(_field(headers, b"Content-Length") or b"-1")
        stop = cut + len(end) + size
        while len(held) < stop + len(end):
            if not more():
                raise ValueError("the last record is cut short")
        if size < 0 or not headers.startswith(b"WARC/") or held[stop : stop + len(end)] != end:
            raise ValueError("a record is malformed")
        yield headers, bytes(held[cut + len(end) : stop])
        del held[: stop + len(end)]


def _field(headers: bytes, name: bytes) -> bytes | None:
    for line in headers.split(b"\r\n")[1:]:
        key, _, value = line.partition(b": ")
        if key == name:
            return value
    return None


_RECORDS = "page_id bigint, record_type string, digest string, refers_to bigint, headers string, payload string, bytes bigint"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: page_id, record_type, digest, refers_to, headers (exact,
    with those of the HTTP block), payload and its bytes (NULL for revisits).

    A stored payload that does not match its digest is an error, as is a malformed record.
    """
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    rows.append(fields(headers, block))
                    size += len(headers) + len(block)
                    if size > _BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        types = [pa.int64() if " bigint" in c else pa.string() for c in _RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def fields(headers: bytes, block: bytes) -> dict:
        kind = (_field(headers, b"WARC-Type") or b"").decode()
        digest = (_field(headers, b"WARC-Payload-Digest") or b"").decode().removeprefix("sha256:")
        http, _, body = block.partition(BREAK.encode())
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"a payload does not match its digest {digest}")
        page, refers = _field(headers, b"Page-ID"), _field(headers, b"Refers-To-Page")
        stored = kind == "response"
        return {
            "page_id": int(page) if page else None,
            "record_type": kind,
            "digest": digest,
            "refers_to": int(refers) if refers else None,
            "headers": (headers + BREAK.encode() + http).decode(),
            "payload": body.decode() if stored else None,
            "bytes": len(body) if stored else None,
        }

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, _RECORDS)


def payload_store(records: DataFrame) -> DataFrame:
    """One row (digest, payload, bytes) per different payload of an archive."""
    stored = records.filter("record_type = 'response'").select("digest", "payload", "bytes")
    return stored.groupBy("digest").agg(F.any_value("payload").alias("payload"), F.any_value("bytes").alias("bytes"))


def reconstruct(records: DataFrame) -> DataFrame:
    """Every original record: page_id, record_type, digest, refers_to, headers, payload,
    bytes. The payload of a revisit comes from the store, by its digest; a revisit whose
    payload is not in the archive has payload and bytes NULL."""
    store = payload_store(records).withColumnsRenamed({"payload": "_payload", "bytes": "_bytes"})
    revisits = records.filter("record_type = 'revisit'").drop("payload", "bytes").join(store, "digest", "left")
    whole = revisits.withColumnsRenamed({"_payload": "payload", "_bytes": "bytes"}).select(*records.columns)
    return records.filter("record_type = 'response'").union(whole)
