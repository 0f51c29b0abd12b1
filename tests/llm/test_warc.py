from __future__ import annotations

import hashlib
import io

from pixlens.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_round_trip_and_revisits(spark):
    same = "<html>" + "abc " * 50 + "é</html>"
    rows = [(5, "http://a/ b\r\nX: y", same), (2, None, same), (9, "http://c", same), (3, "u", None), (4, "u", ""),
            (7, "u", "short"), (8, "u", "short"), (None, "u", same), (10, "u", "x" * 300_000)]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i} " + "some text in every page " * (i % 9 + 1)) for i in range(200)]
    rows += [(300, "u", "twice " * 30), (300, "u", "twice " * 30)]
    got = warc.read_warc(warc.write_warc(pages(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = {(r[0], (r[2] or "")) for r in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in texts
            assert r.refers_to is None and len(r.payload) == r.payload_bytes
        assert hashlib.sha256(same.encode()).hexdigest() != r.payload_digest or r.payload_bytes == len(same.encode())
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(2, "response", None), (5, "revisit", 2), (9, "revisit", 2), (None, "revisit", 2), (7, "response", None),
            (8, "response", None), (3, "response", None), (300, "response", None)} <= kinds
    assert {r.url for r in got if r.page_id == 2} == {None}


def test_archive_has_dictionary_frame_and_single_record_frames():
    import zstandard

    records = [warc.record_bytes({"page_id": i, "url": "u", "payload": (f"page {i} " * 40).encode(), "payload_bytes":
                                  len(f"page {i} " * 40), "digest": hashlib.sha256((f"page {i} " * 40).encode()).hexdigest(),
                                  "refers_to": None, "revisit": False}) for i in range(120)]
    out = io.BytesIO()
    n, size = warc.write_archive(out, iter(records), sample_bytes=20_000)
    data = out.getvalue()
    assert n == 120 and size > 0 and int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    assert list(warc.read_archive(io.BytesIO(data), chunk=7)) == records
    held = zstandard.ZstdCompressionDict(data[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
    assert first.decompress(data[8 + size:]) == records[0] and first.unused_data
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - size < plain


def test_empty_and_tiny_archives(spark):
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0
    out = io.BytesIO()
    assert warc.write_archive(out, iter([b"one"])) == (1, 3)
    assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == [b"one"]
