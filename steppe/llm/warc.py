"""Seekable Zstandard bundles of WARC records.

Pages become WARC/1.1 records, records are grouped into frames of about ``FRAME_BYTES``, and each
frame is compressed on its own.  A bundle is a run of such frames followed by a seek table in a
skippable frame, in the seekable format of the Zstandard project: any decoder reads the whole
bundle, and a reader that knows the table decompresses one frame to get one record.

Integers of the seek table are little-endian:

    0x184D2A5E, size of what follows,
    for each frame: compressed size, decompressed size (4 bytes each),
    number of frames (4), descriptor 0 (1), 0x8F92EAB1 (4)

Every bundle comes with an index from record identifiers to (frame, offset in the decompressed
frame, length).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 8 << 20, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
_SCHEMA = "bundle_id long, n_records long, n_frames long, raw_bytes long, data binary, index array<struct<page_id:long,record_id:string,frame:int,offset:long,length:long>>"


def record_id(page_id: int | None, url: str | None) -> str:
    """The identifier of a page's record: the same for the same page_id and url."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}')}>"


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A WARC resource record with the page as its block."""
    body = (html or "").encode("utf-8")
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    return struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of a bundle."""
    n, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE or descriptor & 0x7C:
        raise ValueError("not a seekable bundle")
    width = 12 if descriptor & 0x80 else 8
    entries = bundle[len(bundle) - 9 - n * width : len(bundle) - 9]
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", entries, i * width)
        out.append((at, c, d))
        at += c
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, decompressing only its frame."""
    at, size, raw = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=raw)[offset : offset + length]


class _Bundle:
    def __init__(self, level: int, frame_bytes: int) -> None:
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frame_bytes = frame_bytes
        self.clear()

    def clear(self) -> None:
        self.out, self.sizes, self.index, self.frame, self.frame_size, self.raw = [], [], [], [], 0, 0

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        if self.frame and self.frame_size + len(data) > self.frame_bytes:
            self.flush()
        self.index.append({"page_id": page_id, "record_id": record_id(page_id, url), "frame": len(self.sizes), "offset": self.frame_size, "length": len(data)})
        self.frame.append(data)
        self.frame_size += len(data)
        self.raw += len(data)

    def flush(self) -> None:
        if self.frame:
            packed = self.compressor.compress(b"".join(self.frame))
            self.out.append(packed)
            self.sizes.append((len(packed), self.frame_size))
            self.frame, self.frame_size = [], 0

    def row(self, number: int) -> pa.RecordBatch:
        self.flush()
        data = b"".join([*self.out, seek_table(self.sizes)])
        values = ([number], [len(self.index)], [len(self.sizes)], [self.raw], [data], [self.index])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), _INDEX)
        batch = pa.record_batch([pa.array(v, type=t) for v, t in zip(values, types, strict=True)], names=["bundle_id", "n_records", "n_frames", "raw_bytes", "data", "index"])
        self.clear()
        return batch


def bundle_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Seekable bundles of all pages, one to a row, with their indexes.

    Columns: bundle_id, n_records, n_frames, raw_bytes (bigint), data (binary) and index, an array of
    (page_id, record_id, frame, offset, length).  Pages are bundled where they are read, without
    a shuffle; a bundle ends at about ``bundle_bytes`` of records or with its partition.

    Every row gives one record, repeated rows one each (with the same identifier).  A null html is
    an empty block, a null url leaves out the target, a null page_id is null in the index.  A record
    larger than a frame has a frame of its own, of whatever length.  An empty table gives an empty result.  Other columns are ignored.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        bundle = _Bundle(level, frame_bytes)
        for batch in chunks(batches):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(page_id, url, record(page_id, url, html, date))
                if bundle.raw >= bundle_bytes:
                    yield bundle.row(part << 32 | number)
                    number += 1
        if bundle.index:
            yield bundle.row(part << 32 | number)

    return source.mapInArrow(run, _SCHEMA)


def write_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<bundle_id>.warc.zst`` in a folder that the cluster shares; returns the table of its records.

    Columns: file, bundle_id, page_id, record_id, frame, offset, length, frame_start, frame_bytes.  A file is written under
    another name first, so that a task that runs again leaves no half of one.  No bundles give an empty table, and no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, home = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        at.create_dir(home)
        for batch in batches:
            for number, data, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{number}.warc.zst"
                part = f"{home}/.{file}.{uuid.uuid4().hex}"
                with at.open_output_stream(part) as out:
                    out.write(data)
                at.move(part, f"{home}/{file}")
                frames = read_seek_table(data)
                for e in index:
                    e |= {"file": file, "bundle_id": number, "frame_start": frames[e["frame"]][0], "frame_bytes": frames[e["frame"]][1]}
                yield pa.RecordBatch.from_pylist(index, schema=_RECORDS)

    names = ", ".join(f"{f.name} {_SQL[f.type]}" for f in _RECORDS)
    return checkpointed(bundles.select("bundle_id", "data", "index").mapInArrow(run, names))


_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
_RECORDS = pa.schema(
    [("file", pa.string()), ("bundle_id", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32())]
    + [(n, pa.int64()) for n in ("offset", "length", "frame_start", "frame_bytes")]
)


def read_file_record(path: str, entry: dict) -> bytes:
    """One record of a bundle file by its entry in the table of :func:`write_bundles`: only its frame is read."""
    from pyarrow import fs

    at, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with at.open_input_file(where) as f:
        f.seek(entry["frame_start"])
        frame = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    return frame[entry["offset"] : entry["offset"] + entry["length"]]


def find_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, page_id, record binary) of the records of the bundles whose record_id is wanted.

    An identifier that several records have gives each of them, one that no record has none, and a null none.
    """
    entries = bundles.select("bundle_id", F.inline("index"))
    ids = wanted.where(F.col("record_id").isNotNull()).select("record_id").distinct()
    asked = entries.join(ids, "record_id").groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "page_id", "frame", "offset", "length")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, entries_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(e["record_id"], e["page_id"], read_record(data, e["frame"], e["offset"], e["length"])) for e in entries_]
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["record_id", "page_id", "record"])

    return bundles.join(asked, "bundle_id").select("data", "asked").mapInArrow(run, "record_id string, page_id long, record binary")
