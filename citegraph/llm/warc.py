"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames.  Each frame holds whole WARC records,
about ``FRAME_BYTES`` of them; a longer record is a frame of its own.  The last frame is
skippable and carries the seek table: compressed size, plain size and checksum of every
frame, then their number and a magic number, so that a reader finds any frame from the end
of the file.  The index maps a record id to (file, frame, offset in the frame, length).

Each write task makes its own bundles in the shared folder under names that no other
attempt has.  The index is committed by Spark, so it names only files of attempts that
counted; files of lost attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.scratch import Scratch

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
#: Equal payloads from this size on become revisits of the first.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the public seekable format and of the WARC revisit profile.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(record: dict) -> bytes:
    """One WARC record; a revisit has no block but keeps digest and size of its payload."""
    revisit = record["record_type"] == "revisit"
    body = b"" if revisit else record["payload"].encode()
    fields = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", _urn(record["record_id"])),
              ("WARC-Date", DATE)]
    if record["url"] is not None:
        fields.append(("WARC-Target-URI", _one_line(record["url"])))
    fields.append(("WARC-Payload-Digest", f"sha256:{record['payload_digest']}"))
    fields.append(("X-Payload-Length", str(record["payload_bytes"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(record["refers_to"]))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _urn(number) -> str:
    return f"<urn:record:{'' if number is None else number}>"


def _number(urn: str | None):
    digits = (urn or "")[len("<urn:record:"):-1]
    return int(digits) if digits else None


def _one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def parse_records(frame: bytes):
    """``(offset, fields, body)`` of the records of one frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield at, fields, frame[end + 4:end + 4 + size]
        at = end + 8 + size


class BundleWriter:
    """Appends records to one seekable bundle."""

    def __init__(self, stream, level: int = 3):
        self.stream = stream
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in that frame."""
        if self.pending and self.pending_bytes + len(record) > FRAME_BYTES:
            self._close_frame()
        place = len(self.frames), self.pending_bytes
        self.pending.append(record)
        self.pending_bytes += len(record)
        return place

    def _close_frame(self) -> None:
        plain = b"".join(self.pending)
        packed = self.compressor.compress(plain)
        self.stream.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.written += len(packed)
        self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        if self.pending:
            self._close_frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int, int]]:
    """``(start, compressed size, plain size, checksum)`` of every frame."""
    size = stream.size()
    stream.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    width = 12 if flags & CHECKSUMS else 8
    stream.seek(size - 9 - count * width)
    table = stream.read(count * width)
    found, start = [], 0
    for k in range(count):
        entry = struct.unpack_from("<III" if width == 12 else "<II", table, k * width)
        found.append((start, entry[0], entry[1], entry[2] if width == 12 else -1))
        start += entry[0]
    return found


def read_frame(stream, entry: tuple[int, int, int, int]) -> bytes:
    start, packed, plain_size, checksum = entry
    stream.seek(start)
    plain = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain_size)
    if checksum >= 0 and xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
        raise ValueError("a frame does not match its checksum")
    return plain


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, record_id: Column, url: Column, payload: Column,
                  scratch: Scratch) -> DataFrame:
    """Record columns of every row; equal payloads point to the smallest record id.

    A null payload is empty.  Rows that repeat the smallest id are responses like it; rows
    without id revisit that id, and are responses if no row of the group has one.
    """
    text = F.coalesce(payload.cast("string"), F.lit(""))
    records = pages.select(
        record_id.cast("long").alias("record_id"), url.cast("string").alias("url"),
        text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"),
        F.sha2(text.cast("binary"), 256).alias("payload_digest"))
    # Only payloads that occur more than once, counted before they are shuffled.  They grow
    # with the pages, so the join is a sorted one; read back as a table, neither side comes
    # dealt by digest, and adaptive execution can split a digest that many pages have.
    repeated = scratch.save(
        records.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first is not null").select("payload_digest", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return records.join(repeated.hint("merge"), "payload_digest", "left").select(
        "record_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


_INDEX = "record_id long, file string, frame int, offset long, length long"


def write_bundles(records: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Write all records; the index ``(record_id, file, frame, offset, length)``, one row each."""
    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        writer = name = None
        try:
            for batch in batches:
                rows = []
                for record in batch.to_pylist():
                    if writer is not None and writer.written >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(store.open_output_stream(
                            f"{root}/{name}", compression=None))
                    packed = record_bytes(record)
                    frame, offset = writer.add(packed)
                    rows.append((record["record_id"], f"{folder}/{name}", frame, offset, len(packed)))
                yield _batch(rows, _INDEX_TYPES)
        finally:
            if writer is not None:
                writer.close()

    return scratch.save(records.mapInArrow(write, _INDEX))


_INDEX_TYPES = pa.schema([("record_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()),
                          ("offset", pa.int64()), ("length", pa.int64())])
_READ = ("record_id long, url string, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, payload binary")
_READ_TYPES = pa.schema([("record_id", pa.int64()), ("url", pa.string()),
                         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                         ("record_type", pa.string()), ("refers_to", pa.int64()),
                         ("payload", pa.binary())])


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)],
                           schema=types)


def _record(fields: dict, body: bytes, keep: bool) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        size = len(body)
        if hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (_number(fields["WARC-Record-ID"]), url, size, digest, fields["WARC-Type"],
            _number(fields.get("WARC-Refers-To")), body if keep else None)


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives that the index names, frame by frame."""
    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = _store(uri)
                with store.open_input_file(path) as stream:
                    for entry in seek_table(stream):
                        yield _batch([_record(f, b, payloads) for _, f, b in
                                      parse_records(read_frame(stream, entry))], _READ_TYPES)

    # File names are few bytes, so adaptive execution would join them into one task; a stated
    # number of partitions it leaves alone.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = index.select("file").distinct().repartition(parts, "file")
    return files.mapInArrow(read, _READ)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the ids in ``wanted`` (record_id), read by seeking to their frames only."""
    def read(batches):
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                store, path = _store(place["file"])
                with store.open_input_file(path) as stream:
                    plain = read_frame(stream, seek_table(stream)[place["frame"]])
                part = plain[place["offset"]:place["offset"] + place["length"]]
                rows += [_record(f, b, True) for _, f, b in parse_records(part)]
            yield _batch(rows, _READ_TYPES)

    return index.join(wanted.select("record_id"), "record_id", "left_semi").mapInArrow(read, _READ)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), read all archives back.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per row.
    Columns may be null; other columns are ignored; no row gives no archive.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    records = with_revisits(pages, F.col("page_id"), F.col("url"), F.col("html"), scratch)
    index = write_bundles(records, f"{scratch.folder}/archives", scratch)
    return read_bundles(index).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to")
