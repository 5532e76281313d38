"""Zstandard WARC archives: written one frame per record after a skippable frame that holds the dictionary, and read
back with every header, length and digest checked.

Records with one payload (of at least `least` bytes) are stored once: the row with the smallest page_id is a response,
the others are revisits of it. A null html is an empty payload; a null url or page_id is kept as such. Of rows that
repeat page_id and html, the first in storage order is the response. Other columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumweave.llm.common import get, materialise, new_folder, put, table

SKIPPABLE = 0x184D2A5D
#: Bytes of the dictionary, and of the payloads it is fitted on, for each archive.
DICT_BYTES, SAMPLE_BYTES = 16_384, 1 << 20
#: An archive is closed after so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def record(page: dict) -> bytes:
    payload = page["payload"] if page["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
    block = http + payload
    url = None if page["url"] is None else page["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", page["record_type"]),
        ("WARC-Record-ID", record_id(page["page_id"], page["row"])),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", url)] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{page['digest']}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if page["record_type"] == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(page["refers_to"], page["refers_row"]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head)).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    import zstandard as zstd

    sample, taken = [], 0
    for r in records:
        if taken < SAMPLE_BYTES:
            sample.append(r[:16_384])
            taken += len(sample[-1])
    trained = b""
    if len(sample) >= 32:
        try:
            trained = zstd.train_dictionary(DICT_BYTES, sample).as_bytes()
        except zstd.ZstdError:  # too little variety to fit one
            trained = b""
    made = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(trained)), trained, *(made.compress(r) for r in records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame."""
    import zstandard as zstd

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstd.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    made, rest = zstd.ZstdDecompressor(dict_data=dictionary), data[8 + size :]
    at, view = 0, memoryview(rest)
    while at < len(rest):
        one = made.decompressobj()
        parts = []
        step = 1 << 16
        while not one.eof:
            if at >= len(rest):
                raise ValueError("the last frame is cut short")
            chunk = view[at : at + step]
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """The fields of one record; ValueError if a header, a length or a digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip(" ")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if name not in fields:
            raise ValueError(f"no header {name}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:n]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"]:
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("the payload's length or digest is wrong")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"a bad {kind} record")
    ident = lambda x: None if (v := x.split(":")[2]) == "" else int(v)
    url = fields.get("warc-target-uri")
    return {
        "page_id": ident(fields["warc-record-id"]),
        "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": ident(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives; a table (archive, records) of what was written."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("row", F.monotonically_increasing_id())
    # Only digests are dealt out; the smallest of each group is found before the shuffle and joined back to the ids.
    keys = materialise(rows.select("row", "page_id", "digest", "payload_bytes"), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    shared = keys.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = keys.where(F.col("payload_bytes") >= least).join(shared, "digest").where(F.col("row") != F.col("first.row"))
    revisits = revisits.select("row", F.col("first.id").alias("refers_to"), F.col("first.row").alias("refers_row"))
    rows = rows.join(revisits, "row", "left").withColumn("record_type", F.when(F.col("refers_row").isNull(), "response").otherwise("revisit"))
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []

        def close() -> None:
            nonlocal size
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            done.append((put(folder, name, archive(held)), len(held)))
            held.clear()
            size = 0

        for batch in batches:
            for page in batch.to_pylist():
                page["digest"] = base64.b32encode(page["digest"]).decode()
                held.append(record(page))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield pa.record_batch([pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "records"])

    # The list of archives that belong to the result is what the successful attempts returned.
    return materialise(rows.mapInArrow(run, "archive string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives, validated; an archive whose number of records differs from the list fails."""
    fields = [x.split() for x in OUT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, seen, size = [], 0, 0
                for data in frames(get(path)):
                    found.append(parse(data))
                    seen, size = seen + 1, size + len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, size = [], 0
                if seen != n:
                    raise ValueError(f"{path} holds {seen} records, not {n}")
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return archives.select("archive", "records").mapInArrow(run, OUT)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    return read(write(pages, new_folder(spark, "warc"), least))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).drop("url", "payload")
