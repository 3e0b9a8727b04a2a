"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Reader: a task scans its byte range for the gzip magic, validates a candidate
by decoding its header, and owns the records which start inside the range; it
reads past the end of the range to finish the last one.

Writer: Spark's own text writer stores the members, so its commit protocol
covers lost executors and any file system of Spark is a target. Its line
separator is an empty gzip member, which every gzip reader passes over.

Defined results: a null payload is written as an empty one; a null URL becomes
the record's id; equal payloads of at least ``min_bytes`` are stored once, as
the response of the largest id, and revisited by the others (repeated rows with
that id are all responses); rows whose id is null are always responses, whose
record id ends in "none"; an
empty table gives an archive without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import parallelism, slices

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ID = "urn:x-page:"
SPLIT_BYTES = 8 << 20
#: Ranges that a task reads one after the other at most, once all cores have some.
RANGES_A_TASK = 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A record as a gzip member; a revisit keeps the HTTP header, not the payload."""
    own = f"{ID}{'none' if page is None else page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else own
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def write(df: DataFrame, path: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a WARC record for each row into files below ``path``.

    Only groups of equal payloads are joined back, by digest and length.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    own = own.withColumns({"n": F.octet_length("payload"), "sha": F.sha1("payload")})
    groups = own.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("id").alias("kept"), F.min("id").alias("least"))
    several = groups.where("least < kept").drop("least")
    rows = own.join(several, ["sha", "n"], "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("kept") != F.col("id"), F.col("kept")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 16 << 20):
                made = [member(*x) for x in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    packed = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(at)


def members(file, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of WARC members that start in [start, end).

    ``file``: seekable, with size(). A candidate that doesn't decode, or whose
    content doesn't begin as a WARC record does, is passed over.
    """
    size = file.size()
    base, data = start, b""  # data: what has been read from base on

    def fill() -> bool:
        nonlocal data
        file.seek(base + len(data))
        more = file.read(min(chunk, size - base - len(data)))
        data += more
        return bool(more)

    at = start
    while at < end:
        found = data.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(data) - 2)
            base, data = at, data[at - base :]
            if not fill():
                return
            continue
        at = base + found
        if at >= end:
            return
        base, data = at, data[found:]
        decoder, content, used, valid = zlib.decompressobj(31), [], 0, True
        try:
            while not decoder.eof:
                if used == len(data) and not fill():
                    break
                content.append(decoder.decompress(data[used:]))
                used = len(data)
                if sum(map(len, content[:8])) >= 5 and not b"".join(content[:8]).startswith(b"WARC/"):
                    valid = False
                    break
        except zlib.error:
            valid = False
        if not valid or not decoder.eof:
            at += 1
            continue
        whole = b"".join(content)
        taken = used - len(decoder.unused_data)
        if whole:
            yield at, whole
        at += taken
        base, data = at, data[taken:]


def parse(content: bytes) -> dict:
    """Fields of a record; the digest of a payload is computed again and must agree."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: the record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != said:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its digest")
    length = re.search(rb"(?im)^Content-Length: *(\d+)", http)
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "record_type": kind,
        "target_uri": fields["WARC-Target-URI"],
        "payload_digest": said,
        "payload_bytes": len(payload) if kind == "response" else int(length[1]),
        "refers_to": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
        "payload": payload if kind == "response" else None,
    }


FIELDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
)


def read(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, as FIELDS; ``payload`` of a
    revisit is null, and all are if ``payload`` is false. Files may lie in any
    store that Arrow's file systems open on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # ranges are tiny rows: without a number Spark would put a million of them into one task
    n = ranges.count()
    ranges = ranges.repartition(max(min(n, 4 * parallelism(spark)), -(-n // RANGES_A_TASK), 1))
    schema = FIELDS if payload else pa.schema([f for f in FIELDS if f.name != "payload"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                with _opened(name) as file:
                    for at, content in members(file, start, min(length, start + split_bytes)):
                        rows.append({"file": name, "offset": at} | parse(content))
                        held += len(content)
                        if not payload:
                            del rows[-1]["payload"]
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "file string, offset long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string"
    return ranges.mapInArrow(scan, kinds + ", payload binary" * payload)
