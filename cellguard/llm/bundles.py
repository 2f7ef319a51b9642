"""Seekable Zstandard bundles of WARC records.

A bundle is one file: independent Zstandard frames holding runs of WARC/1.1 records, a skippable frame with the
record index (identifier, frame, offset and length inside the decompressed frame), and a skippable frame with the
seek table and its footer, as in the public seekable format. Any Zstandard tool can decompress it; a reader that knows
the footer fetches one record by decompressing one frame.

Spark writes and commits the files: each bundle is one row of a text write whose row terminator is the last byte of
the seek table's magic number, one row a file. So the folder may be in any store that Spark reaches, and a lost task
leaves no half file. Bundles hold at most ``BUNDLE`` uncompressed bytes plus one record, frames ``FRAME`` plus one.

Records carry the mandatory headers, with the time of the write as WARC-Date. Record ids are unique. A response that
revisits refer to has an id that follows from its page and payload, so revisits in other files name it in WARC-Refers-To.
If the response's row itself is repeated, no copy is singled out: they get ids of their own, and revisits name only their
target's page (X-Refers-To) and the payload digest.

Null payloads count as empty. Rows with equal payloads are told by length and SHA-1: the smallest page_id is the
response (all rows that share it, if rows repeat), others are revisits without payload. Null ids are written as rows
of their own and are never the smallest unless every id of the payload is null (then all are responses). Empty
tables write no bundle and read back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellguard.session import cut_lineage, ensure_checkpoint_dir

FRAME, BUNDLE = 256 << 10, 16 << 20
#: Fixed values of the seekable format: skippable frame magics, footer magic.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LAST = b"\x8f"  # last byte of the footer, written by Spark as the row terminator


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, extra: dict) -> bytes:
    """One WARC/1.1 record; a revisit carries no block."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri or "",
            "WARC-Payload-Digest": f"sha1:{digest}", **extra, "Content-Type": "text/html",
            "Content-Length": str(len(payload))}
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])]


class Bundle:
    """Collects records into frames; ``close`` gives the file's bytes."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[list] = []
        self.open = bytearray()
        self.size = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append([record_id, len(self.frames), len(self.open), len(record)])
        self.open += record
        self.size += len(record)
        if len(self.open) >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.table.append((len(self.frames[-1]), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        index = self.zstd.compress(json.dumps(self.index, separators=(",", ":")).encode())
        skipped = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        entries = b"".join(struct.pack("<II", *e) for e in [*self.table, (len(skipped), 0)])
        footer = struct.pack("<IBI", len(self.table) + 1, 0, FOOTER_MAGIC)
        table = struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + skipped + table


def frame_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, read from the footer backwards."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table")
    start, out = len(data) - 9 - 8 * count, []
    at = 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", data, start + 8 * i)
        out.append((at, packed, size))
        at += packed
    return out


def record_index(data: bytes) -> list[list]:
    """[record id, frame, offset in frame, length] of every record."""
    import zstandard

    at, packed, _ = frame_table(data)[-1]
    return json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8:at + packed]))


def read_frame(data: bytes, frame: int) -> bytes:
    import zstandard

    at, packed, _ = frame_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at:at + packed])


def seek(data: bytes, record_id: str) -> bytes:
    """One record, decompressing its frame only."""
    _, frame, at, length = next(e for e in record_index(data) if e[0] == record_id)
    return read_frame(data, frame)[at:at + length]


def seek_in(file, record_id: str) -> bytes:
    """One record of a seekable file object, reading its footer, its record index and one frame by ranges."""
    import zstandard

    def ranged(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    file.seek(0, 2)
    end = file.tell()
    count, _, _ = struct.unpack("<IBI", ranged(end - 9, 9))
    frames = frame_table(ranged(end - 9 - 8 * count, 9 + 8 * count))
    at, packed, _ = frames[-1]
    index = json.loads(zstandard.ZstdDecompressor().decompress(ranged(at + 8, packed - 8)))
    _, frame, start, length = next(e for e in index if e[0] == record_id)
    at, packed, _ = frames[frame]
    return zstandard.ZstdDecompressor().decompress(ranged(at, packed))[start:start + length]


def response_id(page: int, sha1: str) -> str:
    """Record id of a response that stands once, known to every task that writes a revisit of it."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha1}')}"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1 (hex), first (the smallest page_id of an equal payload), rows of that page_id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    shaped = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    keyed = shaped.withColumn("size", F.octet_length("payload")).withColumn("sha1", F.sha1("payload"))
    # pre-aggregated before the shuffle, written, so that the join back is a plain one that AQE may split on hot keys
    groups = keyed.groupBy("sha1", "size", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("sha1", "size").agg(
        F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("rows"), F.sum("n").alias("n"))
    groups = cut_lineage(groups.where("n > 1").select("sha1", "size", "first", "rows"), "payloads")
    return keyed.join(groups, ["sha1", "size"], "left").drop("size")


def write_bundles(pages: DataFrame, path: str) -> None:
    """Write the pages as WARC records into seekable bundles under ``path``."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def bundles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, task = Bundle(), 0, TaskContext.get().partitionId()
        for frame in frames:
            for page, url, payload, sha1, first, rows in zip(frame["page_id"], frame["url"], frame["payload"],
                                                             frame["sha1"], frame["first"], frame["rows"]):
                page = None if pd.isna(page) else int(page)
                once = page is not None if pd.isna(first) else rows == 1
                first = page if pd.isna(first) else int(first)
                revisit = first is not None and page != first
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                extra = {"WARC-Date": date, "X-Page-ID": "null" if page is None else page, "X-Payload-Length": len(payload)}
                if revisit:
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                              **({"WARC-Refers-To": f"<{response_id(first, sha1)}>"} if once else {}),
                              "X-Refers-To": first}
                record_id = (response_id(page, sha1) if once and page == first else
                             f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha1}/{task}/{count}')}")
                count += 1
                now.add(record_id, warc_record("revisit" if revisit else "response", record_id, url, digest,
                                               b"" if revisit else bytes(payload), extra))
                if now.size >= BUNDLE:
                    yield pd.DataFrame({"value": [now.close()[:-1]]})
                    now = Bundle()
        if now.index:
            yield pd.DataFrame({"value": [now.close()[:-1]]})

    rows = with_revisits(pages).select("page_id", "url", "payload", "sha1", "first", "rows")
    made = rows.mapInPandas(bundles, "value binary").select(F.col("value").cast("string"))
    (made.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", LAST.decode("latin-1")).option("compression", "none").text(path))


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
                     T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
                     T.StructField("refers_to", T.LongType()), T.StructField("record_id", T.StringType()),
                     T.StructField("bundle", T.StringType()), T.StructField("frame", T.IntegerType()),
                     T.StructField("frame_offset", T.LongType()), T.StructField("payload", T.BinaryType())])


def read_bundles(spark, path: str) -> DataFrame:
    """Every record of the bundles under ``path``, through seek tables and record indexes.

    A response's length and digest are computed from the bytes read; a revisit's come from its headers.
    """
    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                data = bytes(data)
                rows: list[tuple] = []
                held, raw = -1, b""
                for record_id, number, at, length in record_index(data):
                    if number != held:
                        if rows:
                            yield pd.DataFrame(rows, columns=READ.names, dtype=object)
                        rows, held, raw = [], number, read_frame(data, number)
                    head, block = parse_record(raw[at:at + length])
                    kind, page = head["WARC-Type"], head["X-Page-ID"]
                    whole = kind == "response"
                    rows.append((None if page == "null" else int(page),
                                 len(block) if whole else int(head["X-Payload-Length"]),
                                 base32_sha1(block) if whole else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                 kind, None if whole else int(head["X-Refers-To"]), record_id, name, number, at,
                                 block))
                if rows:
                    yield pd.DataFrame(rows, columns=READ.names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("path", "content").mapInPandas(records, READ)


def bundle_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write bundles (below the session's checkpoint folder unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundles-{uuid.uuid4().hex}"
    write_bundles(pages, path)
    return read_bundles(spark, path)
