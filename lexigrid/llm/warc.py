"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a row of frames followed by the seek table of the
public seekable format (a skippable frame with each frame's compressed and uncompressed size). The index maps a record
to its bundle, frame, offset within the frame and length, so one record is read by decompressing one frame.

A bundle's name is drawn anew by each attempt of a task, and the index, which Spark commits, names the bundles that count:
files of attempts that were lost or overtaken stay beside them unnamed. Workers open folders by ``pyarrow.fs``: local
paths and ``file``, ``s3`` (also as ``s3a``, ``s3n``), ``gs``, ``abfs`` and, where libhdfs is installed, ``hdfs``, with
the credentials that library finds in a worker's environment. A record is held whole while it is written or read.

Defined results: null html is an empty payload; payloads under 100 bytes are all responses; of equal larger payloads the
row with the smallest page_id is the response (each of them, if rows repeat that id) and the others are revisits; a null
page_id revisits if a row with an id has its payload, else it is a response; a null url is left out of the record;
an empty table gives no bundle and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import fresh_path, pieces, staged

LEAST_BYTES, FRAME_BYTES, BUNDLE_BYTES = 100, 1 << 18, 1 << 25
#: Numbers of the seekable format: the skippable frame's magic, and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone, which has the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id or ''}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records in a frame's uncompressed bytes: their fields, and payload (None in a revisit)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        fields["http_length"] = int(http.rpartition(b"Content-Length: ")[2])
        yield fields | {"payload": payload if fields["WARC-Type"] == "response" else None}
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of each frame of an open bundle."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    table, found, at = file.read_at(8 * n, size - 9 - 8 * n), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, 8 * k)
        found.append((at, packed, plain))
        at += packed
    return found


def read_record(bundle: str, frame: int, offset: int, length: int) -> dict:
    """Random access: one record by its place in the index."""
    store, path = _store(bundle)
    with store.open_input_file(path) as file:
        at, packed, _ = read_seek_table(file)[frame]
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at))
    return next(parse(data[offset : offset + length]))


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3, write_content_size=True)
        count = 0
        plain, inside = bytearray(), []  # the frame being filled: its bytes, its records
        out, frames, places = None, [], []  # the bundle being written
        attempt = uuid.uuid4().hex

        def name() -> str:
            return f"part-{part:06d}-{count:05d}-{attempt}.warc.zst"

        def flush() -> None:
            nonlocal out
            if plain:
                out = out or store.open_output_stream(f"{base}/{name()}", compression=None)  # frames are compressed here
                packed = press.compress(bytes(plain))
                out.write(packed)
                places.extend((k, len(frames), at, n) for k, at, n in inside)
                frames.append((len(packed), len(plain)))
                plain.clear()
                inside.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, count
            if out:
                out.write(seek_table(frames))
                out.close()
                ids, frame, offset, length = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([f"{folder}/{name()}"] * len(ids)), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                    ["record_id", "bundle", "frame", "offset", "length"],
                )
                frames.clear()
                places.clear()
                out, count = None, count + 1

        for batch in pieces(batches):
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page, url, payload, digest, refers)
                inside.append((page, len(plain), len(data)))
                plain += data
                if len(plain) >= FRAME_BYTES:
                    flush()
                    if sum(x for x, _ in frames) >= BUNDLE_BYTES:
                        yield from close()
        flush()
        yield from close()

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles under folder (any store that pyarrow.fs opens) and returns the index."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    # A hot payload's rows meet one row of first: AQE splits such a join, and nothing gathers them after it.
    typed = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string"), "url", F.encode("payload", "UTF-8").alias("payload"), "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).cast("string").alias("refers"),
    )
    index = typed.mapInArrow(_write_batches(folder), "record_id string, bundle string, frame int, offset long, length long")
    return staged(index, "warc-index")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            store, path = _store(bundle)
            with store.open_input_file(path) as file:
                for at, packed, plain in read_seek_table(file):
                    rows = []
                    for x in parse(unpack.decompress(file.read_at(packed, at), max_output_size=plain)):
                        digest = x["WARC-Payload-Digest"].removeprefix("sha256:")
                        if x["payload"] is not None and (hashlib.sha256(x["payload"]).hexdigest() != digest or len(x["payload"]) != x["http_length"]):
                            raise ValueError(f"{bundle}: the payload of {x['WARC-Record-ID']} is not what was written")
                        rows.append((_id(x["WARC-Record-ID"]), x["http_length"], digest, x["WARC-Type"], _id(x.get("WARC-Refers-To", ""))))
                    a, b, c, d, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d), pa.array(e, pa.int64())],
                        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )


def _id(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(URN)
    return int(text) if text else None


def read_warc(index: DataFrame) -> DataFrame:
    """Every record of the bundles in an index, read from the bundles frame by frame, a few bundles to a task."""
    bundles = index.select("bundle").distinct()
    tasks = min(100_000, max(1, bundles.count()))
    dealt = bundles.repartitionByRange(tasks, "bundle")
    return dealt.mapInArrow(_read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc")))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
FROM f
"""
