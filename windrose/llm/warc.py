"""WARC archives of single-record Zstandard frames with an embedded dictionary (the .warc.zst layout).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on records of this archive; each
record is one frame compressed with it, so records can be read one by one.  Records of equal payloads are written once: the page of the
smallest page_id is a response, the others are revisit records that refer to it.

Which pages revisit is settled from digests alone; pages then go to the writers once.  A task writes archives of at most
``archive_bytes`` of records (a longer record has its own) to shared storage through Arrow's file systems, under names that no other
attempt uses, and returns their paths; a lost task leaves an unlisted file.  Reading opens the listed archives, checks each response's
digest and rebuilds one row per record.

Defined cases: a null html is an empty payload.  Pages without a page_id are responses.  Rows that repeat a page_id and its payload are
both of the type that their page has.  An archive of too few records for a trained dictionary embeds their first bytes as a raw one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import pieces, stored
from windrose.session import scratch_path

MAGIC = struct.pack("<I", 0x184D2A5D)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {''.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on records spread over the list, SAMPLE_BYTES of them at most."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:16 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def archive(records: list[bytes]) -> bytes:
    own = dictionary(records)
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=True)
    return MAGIC + struct.pack("<I", len(own)) + own + b"".join(map(c.compress, records))


def records_of(data: bytes):
    """(headers, block) of every record of an archive."""
    if data[:4] != MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    with d.stream_reader(data[8 + size:], read_across_frames=True) as r:
        plain = r.read()
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record where one should begin")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, plain[end + 4:end + 4 + n]
        at = end + 4 + n + 4


def _write(folder: str, date: str, archive_bytes: int):
    def put(records):
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        data = archive(records)
        with where.open_output_stream(name, compression=None) as f:
            f.write(data)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "n_records", "n_bytes"])

    def run(batches):
        held, size = [], 0
        for b in pieces(batches, "html"):
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html or "").encode()
                r = record(page_id, url, payload, digest_of(payload), refers_to, date)
                if held and size + len(r) > archive_bytes:
                    yield put(held)
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield put(held)
    return run


def _read(batches):
    for b in batches:
        for path in b.column("path").to_pylist():
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_stream(name, compression=None) as f:
                data = f.read()
            out = []
            for head, block in records_of(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                    raise ValueError(f"record {head['WARC-Record-ID']} of {path} is damaged")
                own, other = (x and x[len("<urn:x-page:"):-1] for x in (head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                out.append((int(own) if own else None, size, digest, kind, int(other) if other else None, payload.decode() if kind == "response" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def write(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 32 << 20) -> DataFrame:
    """Archives of (page_id, url, html) rows -> (path, n_records, n_bytes).  Payloads under ``min_bytes`` are always responses."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    marks = pages.select("page_id", sha.alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    marks = stored(marks, "digests")
    groups = marks.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    again = marks.join(groups, ["sha", "size"]).where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    rows = pages.withColumn("sha", sha).join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    folder = scratch_path(pages.sparkSession, "warc")
    return stored(rows.mapInArrow(_write(folder, date, archive_bytes), "path string, n_records long, n_bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits)."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts).mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
