"""WARC archives compressed per record with a Zstandard dictionary embedded in the file.

Layout of one archive (the public WARC-Zstandard convention): a leading skippable frame with magic
0x184D2A5D that holds the dictionary, then one Zstandard frame per WARC record. The dictionary is
trained on records of the same archive: the writer buffers the first ``sample_bytes`` of records
(a documented bound), trains, writes the frame, then compresses record by record. Where
records are too few to train on, the dictionary is the end of the sample itself; only an archive whose
records are all empty has none.

Writing runs in one Spark task per archive. A task writes under a name of its own and moves the
file to its final name; only archives listed in the manifest (a Parquet table that Spark commits)
count, so a retried or speculative task leaves at most an unlisted file. Reading back runs one task
per archive, record by record, and checks every payload against its digest.

Records of equal payload (``min_revisit_bytes`` or more) are stored once: the row with the smallest
page id is the response, the others are revisits (identical-payload-digest profile) that keep the
HTTP header, so their payload length is still in the record.

Defined cases: null payload = empty payload; null url = no target header, reads back as null
(other urls read back with control, blank and non-ASCII characters percent-encoded); a null
page id sorts after all others when the response is picked, and such rows read back with null id;
rows that repeat the smallest page id and payload are all responses; an empty table gives an empty
manifest and no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, shared_path

#: Fixed values of the archive format.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
SAMPLE_BYTES = 4 << 20
PIECE_BYTES = 128 << 10
DICT_BYTES = 64 << 10
LEVEL = 3
WARC_DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long, dictionary_bytes long"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit): which rows are stored and which refer to another."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = (pages.select("page_id", payload.alias("payload"))
              .filter(F.octet_length("payload") >= min_revisit_bytes)
              .groupBy(F.sha2("payload", 256).alias("of_digest"))
              .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
              .filter("n > 1").drop("n"))
    firsts = materialize(firsts, "warc-firsts")  # a plain table: a hot digest's rows can then be split by the join
    return (rows.join(firsts, F.col("digest") == F.col("of_digest"), "left")
            .withColumn("revisit", F.col("of_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
            .select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
                    F.octet_length("payload").cast("long").alias("payload_bytes"), "digest",
                    F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "revisit"))


def _record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str):
    part = record_id.strip("<>").rsplit(":", 1)[1]
    return None if part == "null" else int(part)


def record_bytes(row: dict) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["revisit"] else http + row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
            f"WARC-Record-ID: {_record_id(row['page_id'])}", f"WARC-Date: {WARC_DATE}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
            f"WARC-Payload-Digest: sha256:{row['digest']}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe='!#$&()*+,/:;=?@[]~%' + chr(39))}")
    if row["revisit"]:
        head += [f"WARC-Refers-To: {_record_id(row['refers_to'])}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The row of one WARC record; raises if a stored payload does not match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": url,
            "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
            "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else body}


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of the sample records.

    Where the training cannot make one, because the samples are few, small or all alike, the dictionary is
    the end of the samples themselves (raw content, which Zstandard tells from a trained one by its start).
    """
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(min(size, total // 8), 256), samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-max(min(size, total // 8), 256):]


def cut_samples(records: list[bytes], total: int = SAMPLE_BYTES, piece: int = PIECE_BYTES) -> list[bytes]:
    """The first ``total`` bytes of the records, whole, in pieces that the training takes."""
    out, left = [], total
    for r in records:
        r = r[:left]
        out += [r[i:i + piece] for i in range(0, len(r), piece)]
        left -= len(r)
    return out


def write_archive(out, records, sample_bytes: int = SAMPLE_BYTES) -> tuple[int, int]:
    """Write records (an iterator of bytes) to the open file; returns (records, dictionary bytes)."""
    import zstandard

    held, size, n = [], 0, 0
    for rec in records:
        held.append(rec)
        size += len(rec)
        if size >= sample_bytes:
            break
    raw = train_dictionary(cut_samples(held, sample_bytes))
    if raw:
        out.write(DICT_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    else:
        press = zstandard.ZstdCompressor(level=LEVEL)
    for rec in held:
        out.write(press.compress(rec))
        n += 1
    held.clear()
    for rec in records:
        out.write(press.compress(rec))
        n += 1
    return n, len(raw)


def read_archive(source, chunk: int = 1 << 20):
    """The uncompressed records of an open archive, one at a time."""
    import zstandard

    data = source.read(8)
    raw = None
    if len(data) == 8 and int.from_bytes(data[:4], "little") == DICT_MAGIC:
        raw, data = source.read(int.from_bytes(data[4:], "little")), b""
    make = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    one, parts = make.decompressobj(), []
    while True:
        if not data:
            data = source.read(chunk)
            if not data:
                break
        parts.append(one.decompress(data))
        if one.eof:
            yield b"".join(parts)
            data, one, parts = one.unused_data, make.decompressobj(), []
        else:
            data = b""
    if any(parts):
        raise ValueError("archive ends inside a record")


def _writer(folder: str, sample_bytes: int):
    def write(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        rows = (r for b in batches for part in byte_slices(b, b.schema.get_field_index("payload"))
                for r in part.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        fs, base = FileSystem.from_uri(folder)
        name = f"{base}/pages-{uuid.uuid4().hex}.warc.zst"

        def records():
            yield record_bytes(first)
            yield from map(record_bytes, rows)

        with fs.open_output_stream(name + ".part", compression=None) as out:
            n, held = write_archive(out, records(), sample_bytes)
        fs.move(name + ".part", name)
        yield pa.RecordBatch.from_pylist([{"path": folder.rstrip("/") + name[len(base):], "records": n,
                                           "bytes": fs.get_file_info(name).size, "dictionary_bytes": held}],
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()),
                                                           ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())]))
    return write


def as_uri(path: str) -> str:
    """A folder name that the file systems of Python tasks understand (``file:/x`` becomes ``file:///x``)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + path


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES,
               sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Write the archives; returns the committed manifest (path, records, bytes, dictionary_bytes).

    ``folder`` is on storage all executors share (default: under ``spark.checkpoint.dir``).
    """
    spark = pages.sparkSession
    base = folder or shared_path(spark, "warc")
    archives = as_uri(base) + "/archives"
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(archives)
    fs.create_dir(at, recursive=True)
    plan = plan_records(pages, min_revisit_bytes)
    plan.mapInArrow(_writer(archives, sample_bytes), MANIFEST).write.parquet(base + "/manifest")
    return spark.read.parquet(base + "/manifest")


def _reader(with_payload: bool):
    def read(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as source:
                    held, size = [], 0
                    for data in read_archive(source):
                        row = parse_record(data)
                        size += len(row["payload"] or b"") + 200
                        if not with_payload:
                            row["payload"] = None
                        held.append(row)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
    return read


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in the manifest, one archive at a time per task."""
    paths = manifest.select("path", F.xxhash64("path").alias("h"))
    n = max(1, manifest.count())
    return (paths.repartitionByRange(n, "h").select("path")
            .mapInArrow(_reader(with_payload), RECORDS))
