"""WARC archives with a salvage reader (operator 3).

Writer: one WARC/1.1 record per page, built from SQL expressions and written by
Spark's text writer into archives of a bounded number of records. The page with
the smallest id of equal payloads is a ``response``; the others are ``revisit``
records that refer to it and carry no payload.

Reader: archives come from Spark's binary reader; every record is checked
(version line, header block, Content-Length, record end, payload digest, gzip
member CRC). After a failed check the reader searches for the next gzip member
or version line that gives a valid record, goes on there, and logs the bytes
between as a quarantined gap. Plain and gzip archives, also mixed, are read.

Memory: an archive is read whole by one task; the writer bounds it by
``RECORDS_PER_ARCHIVE``. Groups of equal payloads are reduced by ``min`` per
digest with map-side partial results, so a very large group is never gathered.
Pages are read twice (digests, records) and shuffled only where the list of
revisits is too large to broadcast.

Defined cases: a null html is an empty payload; a null url is written as
``urn:page:<id>``; a null id is written as ``none`` and read back as null (it is
a response only if no id shares its payload); rows that tie on the smallest id
are all responses; an empty table writes and gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlytics.llm.common import scratch, stored

RECORDS_PER_ARCHIVE = 2000
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"

# ------------------------------------------------------------------ writer


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string column's UTF-8 bytes."""
    digest = F.sha1(payload)
    # five hex digits are 20 bits, four base32 digits
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` as record texts: one column ``value``, without the last line feed."""
    x = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload")), "key": F.xxhash64("payload")})
    # who revisits whom is settled on a narrow table; Spark broadcasts it only if its files are small, else pages are shuffled
    narrow = stored(x.select("id", "key", "digest"), "payload-digests")
    low = narrow.groupBy("digest").agg(F.min("id").alias("low")).where("low is not null")
    again = narrow.join(low, "digest").where("id is null or id <> low").select(F.col("id").alias("rid"), F.col("key").alias("rkey"), "low")
    again = stored(again.distinct(), "revisits")
    x = x.join(again, x["id"].eqNullSafe(again["rid"]) & (x["key"] == again["rkey"]), "left")
    revisit = F.col("low").isNotNull()
    size = F.octet_length("payload").cast("string")
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), name)), r"[\r\n]", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    refers = F.concat(
        F.lit("WARC-Refers-To: <urn:page:"),
        F.col("low").cast("string"),
        F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return x.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, folder: str, records_per_archive: int = RECORDS_PER_ARCHIVE, **columns) -> None:
    """Write ``pages`` as plain WARC archives into a new folder."""
    records(pages, **columns).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_archive).text(folder)


def gzip_member(record: bytes) -> bytes:
    """One record as a gzip member of its own."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


# ------------------------------------------------------------------ salvage reader


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and the place after it; ValueError names the failed check."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or head_end < 0:
        raise ValueError("no version line" if not data.startswith(VERSION, at) else "header block without end")
    head = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise ValueError("header line without colon")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]+", head.get("content-length", "")):
        raise ValueError("no content length")
    start, end = head_end + 4, head_end + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record end not at content length")
    block = data[start:end]
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
        size = int(said[1]) if said and head.get("warc-type") == "revisit" else len(payload)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if digest and head.get("warc-type") != "revisit" and digest != digest_of(payload):
        raise ValueError("payload digest differs")
    return {"head": head, "payload": payload, "payload_bytes": size, "digest": digest or digest_of(payload)}, end + 4


def parse_any(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at ``at``, or the plain record there."""
    if not data.startswith(MEMBER, at):
        rec, end = parse_record(data, at)
        return [rec], end
    d = zlib.decompressobj(31)
    try:
        plain = d.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(f"gzip member: {e}") from None
    if not d.eof:
        raise ValueError("gzip member without end")
    out, pos = [], 0
    while pos < len(plain):
        rec, pos = parse_record(plain, pos)
        out.append(rec)
    return out, len(data) - len(d.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, record, "") for every valid record, (start, end, None, reason) for every quarantined gap."""
    at, gap, why = 0, -1, ""
    start_of = re.compile(re.escape(VERSION) + b"|" + re.escape(MEMBER))
    while at < len(data):
        try:
            found, end = parse_any(data, at)
        except ValueError as e:
            if gap < 0:
                gap, why = at, str(e)
            nxt = start_of.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap >= 0:
            yield gap, at, None, why
            gap = -1
        for rec in found:
            yield at, end, rec, ""
        at = end
    if gap >= 0:
        yield gap, len(data), None, why


READ = (
    "archive string, start long, end long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, quarantined string"
)
FIELDS = [x.split()[0] for x in READ.split(", ")]
ARROW = pa.schema(
    [(f, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for f, t in (x.split() for x in READ.split(", "))]
)


def _urn(x: str | None) -> str | None:
    return x.removeprefix("<").removesuffix(">") if x else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple] = []
                held = 0
                for s, e, rec, why in salvage(content.as_py()):
                    if rec is None:
                        rows.append((path.as_py(), s, e, None, None, None, None, None, None, None, why))
                    else:
                        h = rec["head"]
                        rows.append(
                            (path.as_py(), s, e, h.get("warc-type"), _urn(h.get("warc-record-id")), h.get("warc-target-uri"), _urn(h.get("warc-refers-to")))
                            + (rec["payload_bytes"], rec["digest"], rec["payload"] if with_payload else None, None)
                        )
                        held += len(rec["payload"]) if with_payload else 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r)) for r in rows], schema=ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r)) for r in rows], schema=ARROW)

    return read


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per salvaged record, and one per quarantined gap (``quarantined`` names the failed check)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_reader(with_payload), READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op3_warc: every page written to WARC archives and read back."""
    folder = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    got = read_archives(spark, folder, with_payload=False).where("quarantined is null")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")  # noqa: E731  after urn:page:
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_FIVE_HEX = " || ".join(f"to_base(('0x' || substr(sha1(payload), {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes,
        translate({_FIVE_HEX}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
      FROM p),
l AS (SELECT payload_digest, min(page_id) AS low FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM d JOIN l USING (payload_digest)
"""
