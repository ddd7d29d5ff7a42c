"""WARC records in seekable Zstandard bundles: independent frames, a seek table in the footer, an index by record."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import shared_folder
from .common import col, drop_at_exit, saved

#: Fixed values of the seekable format: magic of the skippable frame, magic of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id long, file string, frame int, offset long, length long"
RECORD = ("record_id long, record_type string, refers_to long, url string, declared_digest string, payload binary")


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Filesystem and path of a folder or file named by a URI or an absolute path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pyarrow.fs.FileSystem.from_uri(uri)


def urn(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def from_urn(text: str | None) -> int | None:
    name = (text or "<urn:record:none>")[1:-1].rpartition(":")[2]
    return None if name == "none" else int(name)


def record_bytes(record_id, kind: str, refers_to, url: str | None, digest: str, payload: bytes, date: str) -> bytes:
    http = b""
    if kind == "response":
        http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
                + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(record_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head.append(f"Content-Length: {len(http)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(record id, type, refers to, url, declared digest, payload); the payload of a revisit is None."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return (from_urn(fields["WARC-Record-ID"]), fields["WARC-Type"],
            from_urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
            fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].partition(":")[2], payload)


class BundleWriter:
    """One bundle: frames of about ``frame_bytes`` raw bytes, then the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard
        self.fs, self.path = store(uri)
        self.uri, self.out = uri, self.fs.open_output_stream(self.path, compression=None)
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.pending, self.raw, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame's raw bytes, length)."""
        place = len(self.frames), self.raw, len(record)
        self.pending.append(record)
        self.raw += len(record)
        if self.raw >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            frame = self.pack.compress(b"".join(self.pending))
            self.out.write(frame)
            self.frames.append((len(frame), self.raw))
            self.written += len(frame)
            self.pending, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Random access by frame: the footer's seek table gives each frame's place."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        self.file.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.starts = [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)
        self.raw = [raw for _, raw in sizes]

    def frame(self, number: int) -> bytes:
        import zstandard
        self.file.seek(self.starts[number])
        packed = self.file.read(self.starts[number + 1] - self.starts[number])
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.raw[number])

    def close(self) -> None:
        self.file.close()


def planned(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", payload_col: str = "html",
            url_col: str = "url") -> DataFrame:
    """Records to write: record_id, url, payload, digest, record_type, refers_to.

    Of rows with equal payloads of ``least_bytes`` or more, the largest id is the response and smaller ids revisit it.
    Only ids and digests are grouped and joined by digest, so a payload that a third of all rows share never meets in
    one task. Null payload is empty. Rows that repeat an id and payload have the same type; a row with a null id
    revisits the group's response if there is one.
    """
    rows = pages.select(col(id_col).cast("long").alias("record_id"), col(url_col).cast("string").alias("url"),
                        F.coalesce(col(payload_col), F.lit("")).cast("binary").alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least_bytes).select("record_id", F.sha1("payload").alias("digest"))
    keepers = digests.groupBy("digest").agg(F.max("record_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").drop("_n")
    revisits = digests.join(keepers, "digest").where("not (record_id <=> refers_to)").distinct()
    marked = rows.withColumn("digest", F.sha1("payload")).join(
        revisits.select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"),
        F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return marked.select("record_id", "url", "payload", "digest", F.when(F.col("refers_to").isNull(), "response")
                         .otherwise("revisit").alias("record_type"), "refers_to")


def write_bundles(records: DataFrame, folder: str | None = None, frame_bytes: int = 256 << 10,
                  bundle_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write planned records into bundles below ``folder`` and return the index (record_id, file, frame, offset, length).

    Offsets are relative to the raw bytes of the frame. Every attempt of a task writes files of its own name and only
    the attempt that succeeds is in the index, so lost executors and repeated tasks do no harm. ``folder`` must be one
    that all executors share (default: a new one in the shared folder, removed at the end of the session).
    """
    spark = records.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        drop_at_exit(spark, folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        bundle = None
        for batch in batches:
            out = []
            for number, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                out.append((number, bundle.uri, *bundle.add(record_bytes(number, kind, refers, url, digest, payload, date))))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["record_id", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    ordered = records.select("record_id", "url", "payload", "digest", "record_type", "refers_to")
    return saved(ordered.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Records named by index rows, read through the seek tables: one file open and one frame unpacked at a time."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = reader = None
        number, raw = -1, b""
        for batch in batches:
            out, size = [], 0
            for file, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offset", "length"))):
                if file != name:
                    if reader is not None:
                        reader.close()
                    name, reader, number = file, BundleReader(file), -1
                if frame != number:
                    number, raw = frame, reader.frame(frame)
                out.append(parse_record(raw[offset: offset + length]))
                size += length
                if size > 16_000_000:
                    yield record_batch(out)
                    out, size = [], 0
            if out:
                yield record_batch(out)
        if reader is not None:
            reader.close()

    rows = index.repartition("file").sortWithinPartitions("file", "frame", "offset")
    return rows.select("file", "frame", "offset", "length").mapInArrow(read, RECORD)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ["record_id", "record_type", "refers_to", "url", "declared_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


