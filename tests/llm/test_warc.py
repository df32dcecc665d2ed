import hashlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from citegraph.llm import warc as W
from citegraph.scratch import Scratch


def test_bundle_round_trip_and_seek():
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = W.BundleWriter(sink)
    places, plain = [], []
    for k in range(300):
        payload = f"<p>{k}\r\n\r\nWARC/1.1</p>" * (1 + k * k % 500)
        record = {"record_id": k, "url": f"http://x/%0A\r\n{k}", "payload": payload,
                  "payload_bytes": len(payload.encode()), "record_type": "response",
                  "payload_digest": hashlib.sha256(payload.encode()).hexdigest(), "refers_to": None}
        packed = W.record_bytes(record)
        places.append((*writer.add(packed), len(packed)))
        plain.append(record)
    writer.close()
    stream = pa.BufferReader(sink.getvalue())
    table = W.seek_table(stream)
    assert len(table) == places[-1][0] + 1 > 3
    for (frame, offset, length), record in zip(places, plain, strict=True):
        part = W.read_frame(stream, table[frame])[offset:offset + length]
        (_, fields, body), = W.parse_records(part)
        got = W._record(fields, body, True)
        assert got[0] == record["record_id"] and got[6].decode() == record["payload"]
        assert got[1] == record["url"]


def test_frames_are_plain_zstandard():
    import zstandard
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = W.BundleWriter(sink)
    record = b"x" * W.FRAME_BYTES
    for _ in range(3):
        writer.add(record)
    writer.close()
    reader = zstandard.ZstdDecompressor().stream_reader(
        io.BytesIO(sink.getvalue()), read_across_frames=True)
    assert reader.read() == record * 3


def test_archives_keep_every_payload(spark):
    rows = [(k, None if k % 7 == 0 else f"http://h/{k}", "same " * 50 if k % 3 == 0 else f"page {k}")
            for k in range(60)] + [(100, "u", None), (None, "u", "same " * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    scratch = Scratch(spark, "warc-test")
    records = W.with_revisits(pages, F.col("page_id"), F.col("url"), F.col("html"), scratch)
    index = W.write_bundles(records, f"{scratch.folder}/archives", scratch)
    assert index.count() == len(rows)
    found = {r["record_id"]: r for r in W.read_bundles(index, payloads=True).collect()}
    for page_id, url, html in rows:
        revisit = html == "same " * 50 and page_id != 0
        assert found[page_id]["record_type"] == ("revisit" if revisit else "response")
        assert found[page_id]["refers_to"] == (0 if revisit else None)
        assert found[page_id]["payload"].decode() == ("" if revisit else html or "")
        assert found[page_id]["url"] == url
    some = W.fetch(index, spark.createDataFrame([(1,), (100,)], "record_id long")).collect()
    assert {(r["record_id"], bytes(r["payload"])) for r in some} == {(1, b"page 1"), (100, b"")}
