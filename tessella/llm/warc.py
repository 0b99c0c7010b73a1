"""Web archives (WARC 1.1) with a Zstandard dictionary per archive.

A dictionary is trained on a bounded sample of archived records. Each archive starts with a skippable frame that holds
it; each record is a frame of its own, compressed with it, so that any record can be read alone from its offset.
Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a response; the others
are revisits that refer to it and leave the payload out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import hash_sample, passage, save_table, scratch_path, small
from .files import open_input, open_output

#: Fixed by the format: the magic number of the frame with the dictionary, and the profile of identical payloads.
DICT_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Smaller payloads are always kept in full.
MIN_REVISIT = 1_000
#: The dictionary is trained on so many records with different payloads, the least by a hash, and a passage of so many
#: characters of each, from a place that a hash gives.
SAMPLE_RECORDS, SAMPLE_CHARS = 500, 16_384
DICT_BYTES = 112_640
LEVEL = 3
#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 20
MANIFEST = "path string, records long, bytes long"


def _clean(value: str) -> str:
    """A header's value: control characters and white space as percent codes."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One record. A revisit's block has the HTTP headers only, with the payload's length."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "urn:none")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record, its payload's length and digest; of a response they are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": payload, "payload_bytes": length, "payload_digest": digest}


def train_dictionary(pages: DataFrame, html: str = "html", sample: int = SAMPLE_RECORDS, sample_chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> bytes:
    """From at most ``sample`` records; raw content where there is too little to train on."""
    h = F.xxhash64(F.lit(29), F.col(html))
    rows = pages.where(F.length(html) > 0).select("page_id", "url", passage(html, sample_chars, 31).alias("t"), h.alias("h"))
    rows = hash_sample(rows, sample)
    records = [build_record(r["page_id"], r["url"], p := r["t"].encode(), hashlib.sha1(p).hexdigest(), None) for r in rows]
    try:
        return zstandard.train_dictionary(size, records, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def mark_revisits(pages: DataFrame, html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``sha1`` and ``refers_to`` (null for responses).

    Only digests are grouped. Payloads of ``least`` bytes and more meet the digests that occur more than once; the others,
    the empty ones among them, meet none.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = own.where(F.octet_length("payload") >= least).groupBy(F.col("sha1").alias("digest")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = save_table(groups.where("n > 1").drop("n"), "warc-groups")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")), F.col("keeper"))
    large = F.octet_length("payload") >= least
    met = own.where(large).join(small(groups), F.col("sha1") == F.col("digest"), "left").select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))
    return met.union(own.where(~large).withColumn("refers_to", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str, html: str = "html", archive_bytes: int = ARCHIVE_BYTES, least: int = MIN_REVISIT) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest, a row per archive.

    A null html has an empty payload; a null page_id is below any other, and a group without page_ids is all responses,
    as is each row that repeats the largest page_id. Other columns of ``pages`` are left out. An empty table gives an
    empty manifest.
    """
    raw = train_dictionary(pages, html)
    shared = pages.sparkSession.sparkContext.broadcast(raw)  # bounded by DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out, n, size = TaskContext.get().partitionId(), [], None, 0, 0
        dictionary = _dictionary(shared.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for r in batch.slice(at, 500).to_pylist():
                    if out is None:
                        name, out = open_output(folder, f"pages-{part:06d}", ".warc.zst")
                        out.write(head := struct.pack("<II", DICT_FRAME, len(shared.value)) + shared.value)
                        n, size = 0, len(head)
                    frame = compress(build_record(r["page_id"], r["url"], r["payload"], r["sha1"], r["refers_to"]))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    if size >= archive_bytes:
                        out.close()
                        made.append((name, n, size))
                        out = None
        if out is not None:
            out.close()
            made.append((name, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    return save_table(mark_revisits(pages, html, least).mapInArrow(run, MANIFEST), "warc-manifest")


def records_of(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record, a block of the archive in memory at a time."""
    f = open_input(path)
    magic, length = struct.unpack("<II", f.read(8))
    if magic != DICT_FRAME:
        raise ValueError(f"no dictionary at the start of {path}")
    raw = f.read(length)
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    offset, held = 8 + length, f.read(BLOCK)
    while held:
        one = decompressor.decompressobj()
        parts = [one.decompress(held)]
        used = len(held) - len(one.unused_data)
        rest = one.unused_data
        while not one.eof:
            more = f.read(BLOCK)
            if not more:
                raise ValueError(f"{path} ends within a record")
            parts.append(one.decompress(more))
            rest = one.unused_data
            used += len(more) - len(rest)
        yield offset, b"".join(parts)
        offset += used
        held = rest or f.read(BLOCK)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url and offset."""
    schema = StructType(
        [StructField("page_id", LongType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("url", StringType()), StructField("offset", LongType())]
    )
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("offset", pa.int64())])

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for offset, raw in records_of(path):
                    r = parse_record(raw)
                    f = r["fields"]
                    rows.append({"page_id": number(f.get("X-Page-Id")), "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": f["WARC-Type"], "refers_to": number(f.get("X-Refers-To-Page-Id")), "url": f["WARC-Target-URI"], "offset": offset})
                    if len(rows) >= 2_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, F.col("path")).mapInArrow(run, schema)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN keeper END AS refers_to
FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
