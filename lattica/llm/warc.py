"""Dictionary-compressed web archives (operator 13).

A page becomes a WARC/1.1 record: a response with its payload, or, if its payload has at least MIN_REVISIT bytes and another page
with a larger id has the same, a revisit that refers to that page's record. A task writes one file: it gathers records
up to TRAIN_BYTES, builds a Zstandard dictionary from them, writes that into a leading skippable frame, and then
each record as a frame of its own, so that any record can be read with the file's head and its place alone.

Files are written by Spark's text writer, a row a frame, on any store that Spark writes to and with its commit, so a
lost task leaves nothing behind. What the writer puts after each row is an empty skippable frame, which readers pass over.

Defined results: a null html is empty; a payload's class is its SHA-1 digest; a page's rank in its class is its id, then its url (null least),
and rows that tie in both are all responses; a null page_id ranks least and is read back as null; empty tables give no
files and no rows; extra columns are not read; a payload of any length is one record. A file that has too little text to build a
dictionary from has none. A digest that does not fit the payload read back raises.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 1000  # bytes
TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 8 << 20, 64 << 10, 3
DATE = "1970-01-01T00:00:00Z"  # pages have no time
#: Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame in characters that are single bytes.
GAP = "P*M\x18\x00\x00\x00\x00"
COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, html string"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f  ]")


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and the id and url of the response for rows that are revisits.

    Classes are counted by narrow rows, pre-aggregated; rows meet them by an equi-join whose hot keys AQE may split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= MIN_REVISIT
    rank = F.struct("page_id", "url")
    classes = rows.filter(long).groupBy("digest").agg(F.max(rank).alias("kept"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("class"), "kept")
    key = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))  # short payloads meet no class, and no one task
    both = rows.join(classes, key == F.col("class"), "left")
    revisit = F.col("kept").isNotNull() & (rank < F.col("kept"))
    return both.select("page_id", "url", "html", "digest", F.when(revisit, F.col("kept")).alias("kept"))


def _uri(page_id: int | None, url: str | None) -> str:
    """A record's id: names the page, and its url by a digest."""
    return f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha1((url or '').encode()).hexdigest()[:16]}>"


def _target(url: str | None) -> str:
    """The url without characters that end a header."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:page:unknown"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kept: dict | None = None) -> bytes:
    """One WARC record; with kept (page_id and url of the response) a revisit, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if kept else 'response'}", f"WARC-Record-ID: {_uri(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kept:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(kept['page_id'], kept['url'])}", f"WARC-Refers-To-Target-URI: {_target(kept['url'])}", f"WARC-Refers-To-Date: {DATE}"]
    block = http if kept else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _id_of(uri: str) -> int | None:
    return int(own) if (own := uri.split(":")[2]) else None


def parsed(body: bytes) -> tuple:
    """The values of COLUMNS of a record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than its digest says")
    return _id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _id_of(fields["WARC-Refers-To"]) if revisit else None, digest, size, None if revisit else payload.decode()


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, at most a sixteenth of them; None where they are too few."""
    size = min(size, sum(map(len, records)) // 16)
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=4) if size >= 256 else None
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes], train_bytes: int = TRAIN_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """The frames of one file: the dictionary, then the records."""
    held, size = [], 0
    for x in records:
        held.append(x)
        size += len(x)
        if size >= train_bytes:
            break
    if not held:
        return
    own = dictionary(held)
    if own:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(own.as_bytes())) + own.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True)
    held.reverse()
    while held:
        yield packer.compress(held.pop())
    for x in records:
        yield packer.compress(x)


def unpacked(body: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(body):
        (magic,) = struct.unpack_from("<I", body, at)
        if magic in SKIPPABLE:
            (size,) = struct.unpack_from("<I", body, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(body[8 : 8 + size])))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(body):
                raise ValueError("the file ends within a frame")
            part = body[at : at + step]
            parts.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(parts)


def write_warcs(pages: DataFrame, out: str, train_bytes: int = TRAIN_BYTES, level: int = LEVEL) -> None:
    """Writes the records of pages into files below out, one for each task."""
    common.ship(pages.sparkSession)

    def run(batches):
        def records():
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                    page_id, url, html, digest, kept = (x.as_py() for x in row)
                    yield record(page_id, url, html.encode(), digest, kept)

        rows, size = [], 0
        for frame in chain(frames(records(), train_bytes, level), [None]):
            if rows and (frame is None or size + len(frame) > common.BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])
                rows, size = [], 0
            if frame is not None:
                rows.append(frame)
                size += len(frame)

    packed = planned(pages).mapInArrow(run, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).option("compression", "none").text(out)


def read_warcs(spark: SparkSession, out: str) -> DataFrame:
    """COLUMNS of all records below out; html of responses only."""
    common.ship(spark)
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)], names)

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                rows, size = [], 0
                for one in unpacked(memoryview(body.as_buffer())):
                    rows.append(parsed(one))
                    size += len(one)
                    if size >= common.BATCH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).filter("length > 0").select("content")
    return files.mapInArrow(run, COLUMNS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "warc")
    write_warcs(common.read(spark, sf_dir, "pages"), out)
    common.deleted_at_exit(spark, out)
    return read_warcs(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT h, max(struct_pack(i := page_id, u := url)) AS m FROM d WHERE n >= {MIN_REVISIT} GROUP BY h)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN m IS NOT NULL AND page_id < m.i THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m IS NOT NULL AND page_id < m.i THEN m.i END AS refers_to
FROM d LEFT JOIN k ON d.h = k.h AND n >= {MIN_REVISIT}
"""
