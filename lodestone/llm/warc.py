"""WARC archives, compressed record by record with a dictionary that the archive carries.

Each task writes the pages of its partition to archives of at most ARCHIVE frames. It trains a Zstandard dictionary from
the first records it holds, puts it in a skippable frame (magic 0x184D2A5D) at the head of each archive and compresses each
record as a frame of its own. Spark's text writer puts the frames down, so that any file system, the commit protocol and retries work as for any
table; the separator that it needs after each value is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, table

#: Frames of an archive at most, the dictionary's included; bytes of a dictionary, and of the records that it is trained from.
ARCHIVE, DICTIONARY, TRAIN = 4096, 32 << 10, 2 << 20
#: An empty skippable frame; all its bytes are ASCII.
_BREAK = "P*M\x18\x00\x00\x00\x00"
_DICTIONARY_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: null for responses, the response's page_id for revisits.

    Of records with equal payloads that with the largest page_id is the response; a null page_id is smaller than any.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha2("html", 256))
    groups = rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1")
    revisits = rows.select("page_id", "sha").join(groups, "sha").where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "sha", "refers_to").distinct()
    same = [F.col("a.sha") == F.col("b.sha"), F.col("a.page_id").eqNullSafe(F.col("b.page_id"))]
    return rows.alias("a").join(revisits.alias("b"), same, "left").select("a.page_id", "a.url", "a.html", "b.refers_to")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few to train from, their own bytes as content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY:]


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Writes the rows of roles() to files under path; an empty table gives no records."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, packer, lead, written = [], 0, None, b"", 0

        def out(records: list[bytes]) -> pa.RecordBatch:
            nonlocal written
            rows = []
            for record in records:
                if written % ARCHIVE == 0:  # the writer begins a file here
                    rows.append(lead)
                    written += 1
                rows.append(packer.compress(record))
                written += 1
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                new = [_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], date) for r in part.to_pylist()]
                held += new
                size += sum(map(len, new))
                if not packer and size >= TRAIN:
                    packer, lead = _open(held)
                if packer:
                    yield out(held)
                    held = []
        if held:
            packer, lead = _open(held)
            yield out(held)

    def _open(held: list[bytes]) -> tuple[zstandard.ZstdCompressor, bytes]:
        words = _dictionary(held)
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words)), struct.pack("<II", _DICTIONARY_MAGIC, len(words)) + words

    rows = pages.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", _BREAK).option("maxRecordsPerFile", ARCHIVE).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    magic, n = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    words = data[8 : 8 + n] if magic == _DICTIONARY_MAGIC else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).stream_reader(io.BytesIO(data), read_across_frames=True)
    text = io.BufferedReader(reader, 1 << 20)
    while line := text.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := text.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = text.read(int(head["Content-Length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its header says")
        yield head, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and on request the html (null for revisits).

    Digest and length of a response are those of the payload that was read; a digest that differs from its header is an error.
    """
    number = lambda x: int(n) if (n := x[len("<urn:page:") : -1]) else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("html", pa.string())] * payloads]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in _records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, digest, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, *[payload.decode() if kind == "response" else None] * payloads))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], [n for n, _ in kinds])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads)


def warc(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them back (see read_archives).

    Null html counts as empty, null url is left out of the record, equal rows with one page_id are all responses, an empty
    table gives an empty result, and other columns of pages are ignored.
    """
    store = Store(pages.sparkSession, "warc")
    write_archives(roles(pages), store.path("archives"))
    return read_archives(pages.sparkSession, store.path("archives"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p),
x AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(s, i::int, 1)) - 1) AS hex FROM d),
b AS (SELECT *, list_transform(range(0, 8), lambda j: ((hex[5*j+1] * 16 + hex[5*j+2]) * 16 + hex[5*j+3]) * 256 + hex[5*j+4] * 16 + hex[5*j+5]) AS v FROM x)
SELECT page_id, url, strlen(h) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
