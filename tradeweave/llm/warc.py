"""WARC archives: deduplicated writing, reading, revisit resolution.

Headers (page id and digest) are shuffled by digest to elect responses; payloads
are moved once, by page id, to meet their record's type, so a payload that many
pages share isn't moved to one task. Records are packed to files of bounded
bytes and written by Spark's text sink: commits, retries and remote stores are
Spark's. Reading decompresses and parses a file as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stored

CRLF = "\r\n"
END = b"\r\n\r\n"  # of headers, and after each record
#: Bytes of records in an archive file, at most, unless one record has more.
FILE_BYTES = 8 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"  # of records, where none is given
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digits: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1."""
    # 8 groups of 20 bits, 4 letters each
    value = lambda g: F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
    letter = lambda v, shift: F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(value(g), s) for g in range(8) for s in (15, 10, 5, 0)])


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, hex (the SHA-1): payloads stay where they are."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("hex"))


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least min_bytes bytes the one with the
    largest page_id (null is smallest) is the response, others revisit it;
    smaller ones are all responses. Digests and ids alone are shuffled to elect
    responses; payloads are then joined to the election by id and digest.
    """
    heads = stored(headers(pages))
    able = heads.where(F.col("payload_bytes") >= min_bytes)
    first = able.groupBy("hex").agg(F.max("page_id").alias("first"))
    verdict = able.select("page_id", "hex").distinct().join(first, "hex")
    verdict = stored(verdict.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("own"), F.col("hex").alias("own_hex"), "first"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    pages = pages.join(verdict, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("hex") == F.col("own_hex")), "left")
    revisit = F.col("own_hex").isNotNull()
    return pages.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.col("hex")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(page_id: Column, digest: Column) -> Column:
    """Record URN: a UUID from page id and digest."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, n), F.lit(end))])


def records(pages: DataFrame) -> DataFrame:
    """One column, record: a WARC record without its closing line ends, with fresh headers."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return pages.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            header("WARC-Type", F.col("record_type")),
            header("WARC-Record-ID", _record(F.col("page_id"), F.col("payload_digest"))),
            F.lit(f"WARC-Date: {DATE}{CRLF}"),
            header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            header("WARC-Refers-To", F.when(revisit, _record(F.col("refers_to"), F.col("payload_digest")))),
            header("X-Page-Id", F.col("page_id").cast("string")),
            F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
            header("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
        ).alias("record")
    )


def packed(rows: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """Records joined by the end of a record, up to so many bytes a row; a longer record is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for x in batch.column("record"):
                x = x.cast(pa.binary()).as_py()
                if held and size + len(x) + len(END) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held).decode()])], names=["record"])
                    held, size = [], 0
                held.append(x)
                size += len(x) + len(END)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held).decode()])], names=["record"])

    return rows.mapInArrow(run, "record string")


def write(pages: DataFrame, path: str, most: int = FILE_BYTES) -> None:
    """Writes the records of pages as gzip archives of at most so many bytes before compression."""
    packed(records(pages), most).write.option("maxRecordsPerFile", 1).option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def stream(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed parts of a gzip file, members one after the other."""
    while data:
        gz = zlib.decompressobj(31)
        part = gz.decompress(data, step)
        while part:
            yield part
            part = gz.decompress(gz.unconsumed_tail, step)
        if not gz.eof:
            raise ValueError("the archive is cut off")
        data = gz.unused_data


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; one record is held at a time."""
    held = bytearray()
    parts = iter(parts)

    def fill(n: int) -> bool:
        """Whether n bytes are held."""
        while len(held) < n and (part := next(parts, None)) is not None:
            held.extend(part)
        return len(held) >= n

    while fill(1):
        seen = 0
        while (end := held.find(END, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's headers are cut off")
        lines = held[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + len(END)
        stop = start + int(found["content-length"])
        if not fill(stop + len(END)) or held[stop : stop + len(END)] != END:
            raise ValueError("a record isn't closed")
        yield found, bytes(held[start:stop])
        del held[: stop + len(END)]


#: Columns of records read back. computed: the digest of the block as it was read.
RECORD = "record_id string, record_type string, page_id long, url string, digest string, refers_to_record string, bytes long, computed string"


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """RECORD of all records of the archives at path, and their block unless it isn't wanted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")] + ["block"]
    n = len(names) if blocks else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:n], kinds, strict=False)], names=names[:n])

        rows: list[tuple] = []
        size = 0
        for b in batches:
            for content in b.column("content"):
                for h, block in parse(stream(content.as_py())):
                    page = h.get("x-page-id")
                    computed = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    rows.append((h["warc-record-id"], h["warc-type"], int(page) if page else None, h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha1:"), h.get("warc-refers-to"), len(block), computed, block if blocks else None))
                    size += len(block)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return files.mapInArrow(run, RECORD + (", block binary" if blocks else ""))


def resolved(archives: DataFrame) -> DataFrame:
    """Each record with its payload's size and digest; revisits joined to their responses by record id and digest.

    archives: RECORD, stored or cheap to read twice. A revisit whose response
    isn't in the archives keeps null payload_bytes and refers_to.
    """
    target = archives.where("record_type = 'response'").groupBy(F.col("record_id").alias("target"), F.col("computed").alias("target_digest")).agg(F.max("page_id").alias("target_page"), F.max("bytes").alias("target_bytes"))
    revisit = F.col("record_type") == "revisit"
    joined = archives.join(target, revisit & (F.col("digest") == F.col("target_digest")) & (F.col("refers_to_record") == F.col("target")), "left")
    return joined.select(
        "page_id",
        F.when(revisit, F.col("target_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("computed")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("target_page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes deduplicated archives of pages to the shared folder, reads them back and resolves revisits.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; equal empty payloads revisit like any other.
    Rows that repeat a page_id and payload are responses each. A null page_id is
    smaller than any other. Control characters and blanks are left out of the
    archived URL; a null one has no header. No rows: no archives, no rows. Other
    columns of pages are ignored.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write(deduplicated(pages, min_bytes), path)
    return resolved(stored(read_archives(spark, path, blocks=False)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS hex
  FROM pages
), b AS (
  SELECT page_id, payload_bytes, hex,
         list_transform(range(1, 41, 5), lambda i: CAST('0x' || substr(hex, i, 5) AS INTEGER)) AS g
  FROM p
), d AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM b
), f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
