"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at the end of the file
is the seek table (compressed and plain size of every frame). The index maps a record identifier to its
file, frame and offset inside the frame. Every task writes one file; a file counts only once the staged
index names it, so lost or repeated attempts leave nothing that is read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.llm.common import new_file, open_store, partitions, scratch, stage

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 18
LEVEL = 3
MIN_REVISIT = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class BundleWriter:
    """Frames of about ``frame_bytes`` plain bytes; ``add`` returns a record's frame and offset in it."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting, self.held, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        place = len(self.frames), self.held
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self) -> None:
        data = self.packer.compress(b"".join(self.waiting))
        self.sink.write(data)
        self.frames.append((len(data), self.held))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC))
        self.sink.close()


class BundleReader:
    """Opens a bundle from its seek table; any frame can be read without the others."""

    def __init__(self, uri: str):
        import zstandard

        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{uri} has no seek table")
        sizes = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2]):
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=plain)


def record_bytes(kind: str, identifier: str, url: str | None, digest: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and size of the payload it leaves out."""
    block = _HTTP + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{identifier}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of the records from an offset on."""
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        body = data.index(b"\r\n\r\n", head + 4, end) + 4
        yield headers, data[body:end]
        at = end + 4


def _number(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if number.startswith("unnamed-") else int(number)


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of at least ``MIN_REVISIT`` bytes the largest
    ``page_id`` is the response. Only keys and digests are shuffled; the page itself moves once."""
    html = F.col("html").cast("string")
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    keyed = pages.select("page_id", "digest", "size").filter(f"size >= {MIN_REVISIT}")
    first = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = keyed.join(first, "digest").filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to")
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    roles = pages.drop("size").join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return roles.select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page; returns the staged index ``page_id, path, frame, offset, length``."""

    def work(batches):
        writer = path = None
        for batch in batches:
            rows = []
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    path, sink = new_file(folder, ".warc.zst")
                    writer = BundleWriter(sink)
                payload = (html or "").encode()
                name = f"unnamed-{uuid.uuid4().hex}" if page is None else str(page)
                record = record_bytes("response" if refers_to is None else "revisit", name, url, hashlib.sha1(payload).hexdigest(), payload, refers_to)
                rows.append((page, path, *writer.add(record), len(record)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _INDEX)] if rows else [pa.array([], t) for t in _INDEX], ["page_id", "path", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return stage(with_roles(pages).mapInArrow(work, "page_id long, path string, frame long, offset long, length long"), "warc-index")


_INDEX = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the indexed files, frame by frame; payload digests are checked on the way.

    Tasks take (file, frame) pairs, so a large file is read by many of them.
    """

    def work(batches):
        opened: tuple[str, BundleReader] | None = None
        for batch in batches:
            rows = []
            for path, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if opened is None or opened[0] != path:
                    opened = path, BundleReader(path)
                for headers, payload in parse_records(opened[1].frame(frame)):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {headers['WARC-Record-ID']} is damaged")
                    size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    rows.append((_number(headers["WARC-Record-ID"]), size, digest, kind, _number(headers["WARC-Refers-To"]) if kind == "revisit" else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.select("path", "frame").distinct().repartition(partitions(spark), "path", "frame").sortWithinPartitions("path", "frame")
    return frames.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(index_row) -> tuple[dict[str, str], bytes]:
    """One record by its index row: its frame alone is decompressed."""
    return next(parse_records(BundleReader(index_row.path).frame(index_row.frame), index_row.offset))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads them back.

    Null ``html``: an empty payload. Null ``url``: no target header. A row without ``page_id`` is written under
    a name of its own and read back with a null one; it may revisit a page but is never referred to. Rows
    that share a ``page_id`` are all written, each judged by its own payload; an equal payload is never a
    revisit of its own identifier. An empty table gives no files. Other columns are ignored.
    """
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, scratch(spark, "warc")))
