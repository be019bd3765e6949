"""WARC archives in individually compressed records with a shared dictionary.

An archive starts with a skippable frame that holds a Zstandard dictionary built from
records of the same table; each record after it is one frame compressed with that
dictionary, so any record can be read alone.  A record repeats no payload: of the rows
with an equal payload the smallest id is the response, the others are revisits that
carry the headers only and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.staging import stage
from tabwise.llm import storage
from tabwise.llm.common import chunks, shuffle_partitions, table

#: Of the dictionary's frame, by the published WARC-Zstandard layout.
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from about this many rows picked by hash: a bounded sample.
SAMPLE_ROWS = 400
#: Of each sampled record, from a place of its own, for the dictionary only; archived
#: payloads are whole.
SAMPLE_RECORD_BYTES = 16 << 10
#: Parts over which the rows of one payload are dealt.
SALTS = 16
LEVEL = 3
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{key}')}>"


def build_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit where ``refers_to`` is given."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"X-Page-ID: {key}")
    if url:
        # A line break would end the header.
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse_record(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, their own bytes."""
    import zstandard

    samples = [s for s in samples if s]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 16)
    if size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too few or too alike to train on
    return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _piece(name: str, size: int) -> Column:
    """A part of a text from a place that its hash picks."""
    spare = F.greatest(F.length(name) - size, F.lit(0))
    return F.substring(F.col(name), (1 + F.pmod(F.xxhash64(name), spare + 1)).cast("int"), F.lit(size))


def write_archives(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record per row and returns the manifest: path, n_records.

    Payloads are equal by SHA-256.  A null body is an empty payload; empty payloads are
    deduplicated like others.  Rows that repeat the smallest id of their payload are each
    a response.  Where some ids are null, the smallest one that is not counts; a row with
    a null id refers to it, and where all are null each row is a response.  Other columns
    are ignored.  No rows: no archives.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).alias("url"),
        F.coalesce(F.col(body), F.lit("")).alias("body"),
    ).withColumn("digest", F.unhex(F.sha2("body", 256)))
    firsts = (
        rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    # A share of the hash range, so that no task sends more than its few rows.
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    picked = F.xxhash64("key", "url") <= F.lit(int(-(2**63) + share * (2**64 - 1) * 0.999))
    sample = [
        build_record(r["key"], r["url"], r["body"].encode(), None, date)
        for r in rows.where(picked)
        .select("key", F.substring("url", 1, 2000).alias("url"), _piece("body", SAMPLE_RECORD_BYTES).alias("body"))
        .limit(2 * SAMPLE_ROWS)
        .collect()
    ]
    dictionary = build_dictionary(sample)
    folder = storage.new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        stream = uri = compressor = None
        count = 0
        for batch in chunks(batches, "body"):
            if stream is None:
                uri, stream = storage.create_file(folder, ".warc.zst")
                stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                page, link, body_text, first = row
                refers_to = None if first is None or first == page else first
                record = build_record(page, link, body_text.encode(), refers_to, date)
                stream.write(compressor.compress(record))
                count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "n_records": pa.array([count], pa.int64())})

    # A payload may be that of a third of all rows: its rows meet one of several copies of
    # its first id.
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    joined = dealt.join(salted, ["digest", "salt"], "left").select("key", "url", "body", "first")
    return stage(joined.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def frames(source, batch: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, each decompressed by itself."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with its dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size)))
    data = b""
    frame = None
    while True:
        data = data or source.read(batch)
        if not data:
            break
        frame = frame or (decompressor.decompressobj(), [])
        one, parts = frame
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            yield b"".join(parts)
            data, frame = one.unused_data, None
    if frame is not None:
        raise ValueError("the archive ends within a record")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                for record in frames(storage.open_file(path)):
                    fields = parse_record(record)
                    out.append({n: fields[n] for n in schema.names})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    n = shuffle_partitions(manifest.sparkSession)
    return manifest.select("path").repartition(n, "path").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (('0x' || substr(hex, (i // 4)::INTEGER * 5 + 1, 5))::INTEGER // (32 ** (3 - i % 4))::INTEGER) % 32 + 1]), '')
    AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM p
"""
