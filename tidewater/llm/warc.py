"""WARC archives with revisit resolution.

Payload digests are shuffled without the payloads: of records with equal payloads of at least ``least`` bytes, that
with the largest id is the response and the others are revisits of it. Records get fresh headers and ids that no other
record has, each is a gzip member of its own, and archives are cut by running bytes. They go out as text rows of raw
bytes, an archive a row and a row a file, so that Spark's own writer commits WARC/1.1 files to any file system it
knows. Reading goes through an archive member by member, tests lengths and digests, and joins each revisit to the
record that it refers to for what it leaves out.

Nulls and edges: a null html is an empty payload, a null url an empty target. Rows that repeat the largest id are all
responses, one of which the revisits refer to; where a group has only null ids, all are. A null id among others is a
revisit. An empty table writes no records. Columns besides the three are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, new_path, stored

LEAST_BYTES = 1000
#: An archive is closed once it holds so many bytes, compressed, so it holds one record more at most.
ARCHIVE_BYTES = 4 << 20
#: Records that a reader sends on at a time.
RECORDS = 512
#: Groups of equal payloads, under a hundred bytes each, that are broadcast at most.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
LEVEL = 5
#: A gzip member of nothing, as RFC 1952 has it.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def resolved(df: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(record, page_id, url, html, digest, refers_to, original): the last two name a revisit's response by page and record.

    Only digest, length and id are shuffled for the groups' largest ids, combined before the shuffle. Up to
    BROADCAST_ROWS groups of equal payloads go to the pages, which then never move; more are joined by a shuffle with
    one row a digest on their side, so a hot digest is split by AQE.
    """
    pages = df.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    pages = pages.withColumn("record", F.monotonically_increasing_id()).withColumn("digest", F.sha1("html")).withColumn("size", F.length("html").cast("long"))
    most = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record")))
    same = pages.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), most.alias("original")).where("n > 1 and original is not null").select("digest", "size", "original")
    same = stored(same, "same-payloads")
    found = pages.join(F.broadcast(same) if same.count() <= BROADCAST_ROWS else same, ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("original.page_id")))
    original = F.when(revisit, F.col("original"))
    return found.select("record", "page_id", "url", "html", "digest", original["page_id"].alias("refers_to"), original["record"].alias("original"))


def record_id(record: int, page_id: int | None) -> str:
    """The id of a record; record is its number in the table, which no other has."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'record:{record}:{page_id}')}>"


def record(number: int, page_id: int | None, url: str, html: bytes, digest: str, refers_to: int | None, original: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record; original is the number of the record that refers_to's page has."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if original is not None else http + html
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(number, page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, refers_to)}", f"Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + END


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """resolved() rows as WARC files, each closed once it holds so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(gzip.compress(record(*row), LEVEL, mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    rows = pages.select("record", "page_id", "url", "html", "digest", "refers_to", "original")
    archives = map_batches(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, one at a time; an error where the file is not WARC or is cut off."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == EMPTY_MEMBER[:2] else io.BytesIO(data)
    while first := stream.readline():
        if not first.startswith(b"WARC/1.") or not first.endswith(b"\r\n"):
            raise ValueError("no WARC record where one should begin")
        headers: dict[str, str] = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record's headers have no end")
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(len(END)) != END:
            raise ValueError(f"record {headers.get('warc-record-id')} has a wrong length")
        yield headers, block


def checked(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of read_archives; an error where a digest differs."""
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != h["warc-block-digest"][5:]:
        raise ValueError(f"block digest of {h['warc-record-id']} differs")
    digest, payload = base64.b32decode(h["warc-payload-digest"][5:]).hex(), block.partition(b"\r\n\r\n")[2]
    revisit = h["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {h['warc-record-id']} differs")
    page = int(h["page-id"]) if "page-id" in h else None
    refers = int(h["refers-to-page"]) if revisit else None
    return h["warc-record-id"], h.get("warc-refers-to"), page, h["warc-target-uri"], None if revisit else len(payload), digest, h["warc-type"], refers, payload if with_payload and not revisit else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(record_id, original_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record.

    A response's length and digest are computed from the payload read; the digest must equal the header's. A revisit
    has its digest from its header, its length is null.
    """
    names = ["record_id", "original_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(data.as_py()):
                    rows.append(checked(headers, block, with_payload))
                    size += len(block) if with_payload else 0
                    if len(rows) >= RECORDS or size >= ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    found = map_batches(files, run, "record_id string, original_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")
    return found if with_payload else found.drop("payload")


def joined_revisits(records: DataFrame) -> DataFrame:
    """read_archives() rows with every payload_bytes: revisits take it from the record that they refer to.

    Only responses that are referred to take part, a row each; up to BROADCAST_ROWS of them are broadcast.
    """
    asked = records.where("original_id is not null").select(F.col("original_id").alias("record_id")).distinct()
    originals = records.where("record_type = 'response'").join(asked, "record_id", "left_semi").select(F.col("record_id").alias("original_id"), F.col("payload_bytes").alias("full_bytes"))
    few = asked.count() <= BROADCAST_ROWS
    joined = records.join(F.broadcast(originals) if few else originals, "original_id", "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def deduplicated(df: DataFrame, least: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """df written as archives under path (a fresh shared folder by default) and read back, revisits resolved."""
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(resolved(df, least), path)
    return joined_revisits(stored(read_archives(spark, path), "records"))  # archives are read once
