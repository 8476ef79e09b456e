"""WARC records in seekable Zstandard bundles, with an index to single records.

Records are grouped into independent Zstandard frames, a bundle is a run of frames, and its last bytes
are a seek table in a skippable frame (sizes of every frame, packed and unpacked), as the seekable
format has it. So a bundle is one valid .warc.zst file that any reader can unpack from the front, and a record
can be fetched by unpacking its frame alone. Bundles are rows of a table, so Spark's writers commit them, on
whatever store, and a task that is run again leaves no halves behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, sliced, written

FRAME_BYTES = 256 << 10  # of records, after which a frame is closed
BUNDLE_BYTES = 8 << 20  # of packed frames, after which a bundle is closed
MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"  # the tables say nothing of times

# Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response with the same payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    # White space and control characters would break the header; they are written as in a URL.
    target = "" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if target:
        fields.append(("WARC-Target-URI", target))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = HTTP + payload if refers_to is None else HTTP
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and payload of the record at ``start``, and where the next one begins; a broken record is an error."""
    end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:end].decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = end + 4
    last = block + int(fields["Content-Length"])
    if not version.startswith("WARC/1.") or data[last : last + 4] != b"\r\n\r\n":
        raise ValueError(f"no WARC record at {start}")
    payload = data[data.index(b"\r\n\r\n", block, last) + 4 : last]
    return fields, payload, last + 4


class Bundle:
    """Collects records into frames; ``close`` gives the file and the places of its records."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=3).compress
        self.open, self.open_size, self.packed_size = [], 0, 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.places: list[tuple[int | None, int, int, int]] = []  # page, frame, offset in it, length

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append((page_id, len(self.frames), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.pack(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.packed_size += len(frame)
            self.open, self.open_size = [], 0

    def close(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Start, packed and unpacked size of each frame, from the end of a bundle."""
    number, flags, magic = struct.unpack("<IBI", data[-9:])
    start = len(data) - 9 - 8 * number
    if magic != SEEKABLE_MAGIC or flags or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE_MAGIC, 8 * number + 9):
        raise ValueError("no seek table")
    frames, at = [], 0
    for packed, unpacked in struct.iter_unpack("<II", data[start:-9]):
        frames.append((at, packed, unpacked))
        at += packed
    return frames


def frame(data: bytes, place: tuple[int, int, int]) -> bytes:
    """One frame of a bundle, unpacked."""
    at, packed, unpacked = place
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=unpacked)


def fetch(data: bytes, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record, from its frame and its offset there; no other frame is unpacked."""
    return parse(frame(data, seek_table(data)[number]), offset)[:2]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a bundle, frame by frame."""
    for place in seek_table(data):
        unpacked, at = frame(data, place), 0
        while at < len(unpacked):
            fields, payload, at = parse(unpacked, at)
            yield fields, payload


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """Digest and largest page of every payload of ``least`` bytes or more that several rows have."""
    return (
        pages.where(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null").select("digest", "size", "original")
    )


def bundles(pages: DataFrame, least: int = MIN_REVISIT_BYTES, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> tuple[DataFrame, DataFrame]:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) to bundles; returns bundles and index, both stored.

    Bundles: ``bundle, data``. Index: ``page_id, bundle, frame, offset, length``. Null html is an empty
    payload, a null url leaves its field out, a null id is written as ``none`` and is never what others
    refer to. Of equal payloads of ``least`` bytes the row with the largest id is the response, several rows
    with that id all are; others are revisits. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")
    )
    originals = cut(_revisits(keyed, least))
    # Which rows refer to which: on ids and digests alone, so that no payload is moved for it.
    links = (
        keyed.where(F.col("size") >= least).join(originals, ["digest", "size"])
        .where("not page_id <=> original").select("page_id", "digest", "size", "original").distinct()
    )
    links = cut(links.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("size").alias("s"), "original"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.join(
        links,
        F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1("payload") == F.col("d")) & (F.octet_length("payload") == F.col("s")),
        "left",
    ).select("page_id", "url", "payload", "original")

    def run(batches):
        task, number = TaskContext.get().partitionId(), count()

        def row():
            data = bundle.close()
            ids, frames, offsets, lengths = map(list, zip(*bundle.places, strict=True))
            values = [f"part-{task:06d}-{next(number):06d}.warc.zst", data, ids, frames, offsets, lengths]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        names = ["bundle", "data", "ids", "frames", "offsets", "lengths"]
        types = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        bundle = Bundle(frame_bytes)
        for batch in sliced(batches):
            for page_id, url, data, original in zip(*batch.columns, strict=True):
                page = page_id.as_py()
                bundle.add(page, record(page, url.as_py(), data.as_py(), original.as_py()))
                if bundle.packed_size >= bundle_bytes:
                    yield row()
                    bundle = Bundle(frame_bytes)
        if bundle.places:
            yield row()

    made = written(
        rows.mapInArrow(run, "bundle string, data binary, ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"),
        "warc",
    )
    entry = F.explode(F.arrays_zip(F.col("ids").alias("page_id"), F.col("frames").alias("frame"), F.col("offsets").alias("offset"), F.col("lengths").alias("length")))
    index = made.select("bundle", entry.alias("e")).select(
        F.col("e.page_id").alias("page_id"), "bundle", F.col("e.frame").alias("frame"), F.col("e.offset").alias("offset"), F.col("e.length").alias("length")
    )
    return made.select("bundle", "data"), index


def read_bundles(stored: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every record.

    The digest and length of a response are taken from its payload and compared with its header, a revisit (payload
    null) has them in its header; a difference is an error.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def run(batches):
        for batch in sliced(batches, 1):
            rows = []
            for fields, payload in records(batch.column(0)[0].as_py()):
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size, revisit = int(fields["X-Payload-Length"]), fields["WARC-Type"] == "revisit"
                if not revisit and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                rows.append({
                    "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
                    "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
                    "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
                })
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return stored.select("data").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
