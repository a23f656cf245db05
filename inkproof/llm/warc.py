"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with about ``frame_bytes`` of whole WARC
records, closed by a seek table (a skippable frame) that any seekable-format reader understands.
``write_archives`` returns the index: one row per frame with its place in the bundle and the offsets of
its records inside the decompressed frame, by record id.  ``read_archives`` reads every frame of an
index, ``fetch`` only the frames that hold the wanted records.

A task writes its bundles under fresh names, and only bundles that the stored index names count: a
task that is lost and run again leaves files that nothing refers to, never a half or double record.
Records stream, so memory is bounded by one frame or the largest record.

Records whose payloads are equal and have at least ``revisit_bytes`` bytes are one response (of the
smallest page_id; rows that repeat it are responses too) and revisits that refer to it.

The folder is a URI that pyarrow opens (a shared mount, or an object store).  A null html is an
empty payload; a null url leaves out the target; a null page_id is written as the id ``none``, counts
after every number, and revisits that refer to one keep their type.  Extra columns are not read; an
empty table writes nothing and gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.llm.shared import binary_text, key_exchange, shared_dir, stored

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_ID = "urn:inkproof:page:"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "bundle string, frame int, frame_offset bigint, frame_size int, frame_bytes int, "
    "records array<struct<record_id:string,offset:int,length:int>>"
)
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<{_ID}{'none' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    tail = (identifier or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _line(text: str) -> str:
    """A header value on one line: line ends, which no valid URL has, are percent-encoded."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def make_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the payload's length and digest but not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """The fields of a record and its payload; a response whose payload doesn't have its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_headers(http)["Content-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    found = {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
    }
    return found, payload


class BundleWriter:
    """Writes one bundle to an open stream."""

    def __init__(self, stream, frame_bytes: int, level: int = 3):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.records: list[dict] = []
        self.filled = 0

    def add(self, identifier: str, record: bytes) -> Iterator[dict]:
        """Add a record; gives the frame that it fills."""
        self.records.append({"record_id": identifier, "offset": self.filled, "length": len(record)})
        self.waiting.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.waiting:
            return
        plain = b"".join(self.waiting)
        packed = self.compress(plain)
        self.stream.write(packed)
        yield {
            "frame": len(self.table),
            "frame_offset": self.size,
            "frame_size": len(packed),
            "frame_bytes": len(plain),
            "records": self.records,
        }
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)
        self.waiting, self.records, self.filled = [], [], 0

    def close(self) -> Iterator[dict]:
        yield from self.flush()
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        body = entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle, from its footer."""
    end = file.size()
    many, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & CHECKSUM_FLAG else 8
    entries = file.read_at(many * width, end - 9 - many * width)
    out, at = [], 0
    for n in range(many):
        packed, plain = struct.unpack_from("<II", entries, n * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, offset: int, size: int, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(file.read_at(size, offset), max_output_size=plain)


def _opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def with_record_types(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, kind, refers_to): which pages are responses and which revisit another."""
    rows = pages.select("page_id", "url", binary_text("html").alias("payload"))
    digests = rows.where(F.octet_length("payload") >= revisit_bytes).select("page_id", F.sha1("payload").alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"))
    # only the payload's digest decides, and a hot one is split by the join's own exchange
    first = first.select(key_exchange("digest").alias("of"), "first")
    marked = rows.withColumn("digest", F.sha1("payload")).join(first, key_exchange("digest") == F.col("of"), "left")
    again = F.col("of").isNotNull() & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return marked.select(
        "page_id",
        "url",
        "payload",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


_INDEX_TYPE = pa.schema(
    [
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("frame_offset", pa.int64()),
        ("frame_size", pa.int32()),
        ("frame_bytes", pa.int32()),
        ("records", pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int32()), ("length", pa.int32())]))),
    ]
)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 128 << 20,
    revisit_bytes: int = 0,
) -> DataFrame:
    """Write a record per page (page_id, url, html) into bundles under ``folder``; the stored index."""
    base = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(base)
        system.create_dir(path, recursive=True)
        writer = name = None

        def frames(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for frame in found:
                yield pa.RecordBatch.from_pylist([{"bundle": f"{base}/{name}", **frame}], _INDEX_TYPE)

        for batch in batches:
            for n in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (column[n].as_py() for column in batch.columns)
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                yield from frames(writer.add(record_id(page_id), make_record(page_id, url, payload, kind, refers_to)))
                if writer.size >= bundle_bytes:
                    yield from frames(writer.close())
                    writer = None
        if writer is not None:
            yield from frames(writer.close())

    return stored(with_record_types(pages, revisit_bytes).mapInArrow(write, INDEX), "warc-index")


def _read(wanted: DataFrame, payload: bool) -> DataFrame:
    """Parse the records of index rows, opening each bundle once per task as long as its rows follow each other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            for row in range(batch.num_rows):
                frame = {c: batch[c][row].as_py() for c in batch.schema.names}
                if frame["bundle"] != name:
                    name, file = frame["bundle"], _opened(frame["bundle"])
                plain = read_frame(file, frame["frame_offset"], frame["frame_size"], frame["frame_bytes"])
                out = []
                for r in frame["records"]:
                    fields, body = parse_record(plain[r["offset"] : r["offset"] + r["length"]])
                    out.append({**fields, "payload": body} if payload else fields)
                yield pa.RecordBatch.from_pylist(out, schema)

    names = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    names += [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema([*names, ("payload", pa.binary())] if payload else names)
    return wanted.mapInArrow(read, RECORD + ", payload binary" * payload)


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of an index; each response's payload is checked against its digest."""
    return _read(index, payload)


def fetch(index: DataFrame, ids: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``ids`` (page_id), reading only the frames that hold them."""
    wanted = ids.select(F.concat(F.lit(f"<{_ID}"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id")).distinct()
    each = index.select("*", F.explode("records").alias("r")).join(wanted, F.col("r.record_id") == F.col("record_id"))
    frame = ["bundle", "frame", "frame_offset", "frame_size", "frame_bytes"]
    return _read(each.groupBy(*frame).agg(F.collect_list("r").alias("records")), payload)
