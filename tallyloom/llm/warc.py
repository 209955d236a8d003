"""Dictionary-compressed web archives.

Each task writes its pages as WARC/1.1 records into archives of a bounded size.  An archive starts with one skippable
Zstandard frame (magic 0x184D2A5D) that holds a dictionary built from its own first records, a bounded sample; every
record follows as one frame compressed with that dictionary, so a record can be read alone.  Of rows with equal
payloads the one with the largest id is a response, others are revisits that refer to it and carry no payload.

Files go through Arrow's file systems (local, HDFS, S3 and others by URI) under a temporary name and are moved when
whole; a retried or speculative task writes a name of its own, and only names in the manifest are read.

Rules for odd rows: a null payload is empty; empty payloads are equal to each other; rows that repeat the largest id
with the same payload are all responses; a row with a null id is a revisit if an equal payload has an id, else a response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

SKIPPABLE = 0x184D2A5D
DICT_BYTES = 64 << 10
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 4 << 20  # bound of what a dictionary is built from
BROADCAST_SHARED = 200_000  # hashes of repeated payloads, about 100 bytes each
ARCHIVE_BYTES = 64 << 20  # an archive is closed at this size
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record; ``number`` tells it from all others."""
    clean = lambda s: "".join(c for c in s if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, number)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    return fields, payload


class ArchiveWriter:
    """One archive: dictionary frame first, then a frame a record."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.fs, self.path, self.pending, self.held, self.size, self.n = fs, path, [], 0, 0, 0
        self.out, self.codec = fs.open_output_stream(path + ".part", compression=None), None

    def _start(self) -> None:
        try:
            trained = zstandard.train_dictionary(min(DICT_BYTES, max(1024, self.held // 8)), self.pending, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on: their own bytes serve as a raw dictionary
            trained = b"".join(self.pending)[:DICT_BYTES].ljust(8, b"\0")
        self._put(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained))
        for r in self.pending:
            self._put(self.codec.compress(r))
        self.pending = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self.n += 1
        if self.codec:
            self._put(self.codec.compress(raw))
            return
        self.pending.append(raw)
        self.held += len(raw)
        if len(self.pending) >= SAMPLE_RECORDS or self.held >= SAMPLE_BYTES:
            self._start()

    def close(self) -> tuple[str, int, int]:
        if not self.codec:
            self._start()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path, self.n, self.size


def read_archive(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[bytes]:
    """Records of an archive, one at a time; a buffer holds what is not yet decoded."""
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no dictionary frame")
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        one, parts, rest = codec.decompressobj(), [], b""
        while rest or (rest := f.read(1 << 20)):
            parts.append(one.decompress(rest))
            rest = b""
            if one.eof:
                yield b"".join(parts)
                rest, one, parts = one.unused_data, codec.decompressobj(), []
        if any(parts):
            raise ValueError(f"{path} ends inside a record")


def _roles(pages: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """Adds payload and last, the largest id with that payload; null where it stands alone.

    Only hashes are grouped.  Payloads stay where they are unless more of them repeat than ``BROADCAST_SHARED``.
    """
    own = pages.withColumn("payload", F.coalesce("payload", F.lit(b"").cast("binary"))).withColumn("sha", F.sha1("payload"))
    shared = own.groupBy("sha", F.length("payload").alias("n")).agg(F.max("page_id").alias("last"), F.count("*").alias("n_same"))
    shared = scratch.save(shared.where((F.col("n_same") > 1) & (F.col("n") >= min_bytes)).select(F.col("sha").alias("_sha"), "last"), "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_SHARED else shared
    return own.join(shared, F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "payload", "last")


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        done, w = [], None
        for b in batches:
            for page_id, url, payload, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = w or ArchiveWriter(fs, f"{base}/{uuid.uuid4().hex}.warc.zst")
                payload = payload or b""
                w.add(record(f"{w.path}#{w.n}", page_id, url, payload, payload_digest(payload), last, last is not None and page_id != last))
                if w.size >= ARCHIVE_BYTES:
                    done.append(w.close())
                    w = None
        if w:
            done.append(w.close())
        names, counts, sizes = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "bytes"])

    return run


def write(pages: DataFrame, scratch: Scratch, root: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, payload binary)`` below the URI ``root`` -> manifest ``(path, n_records, bytes)``."""
    rows = _roles(pages, min_bytes, scratch).mapInArrow(_writer(root), "path string, n_records long, bytes long")
    return scratch.save(rows, "manifest")


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for raw in read_archive(fs, path):
                    f, payload = parse(raw)
                    rows.append((f["X-Page-ID"], f["WARC-Target-URI"], int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], f.get("X-Refers-To"), payload))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


READ_SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def read(manifest: DataFrame, root: str, tasks: int) -> DataFrame:
    """The records of the archives in ``manifest``; ids as text, as archives have them."""
    return manifest.select("path").repartition(tasks).mapInArrow(_reader(root), READ_SCHEMA)


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write the archives of ``pages(page_id, url, html)`` in the shared folder and read them back."""
    scratch = Scratch(spark, "warc")
    rows = pages.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    root = f"{scratch.root}/archives"
    manifest = write(rows, scratch, root, min_bytes)
    tasks = max(1, manifest.count())
    return read(manifest, root, tasks), root
