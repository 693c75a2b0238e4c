"""WARC archives as seekable Zstandard bundles.

Every writing task makes bundles of its own. Records are grouped into frames of about FRAME_BYTES,
each compressed alone, and a bundle ends with the seek table of the seekable Zstandard format (a
skippable frame with the compressed and plain size of every frame). The index is a table: record
id, bundle, frame number, offset and length within the plain frame. A reader needs the seek table,
one frame and an offset to get at a record.

Pages with equal payloads of at least `min_bytes` are stored once: that with the smallest page_id is a
`response`, the others are `revisit` records that refer to it. Equal payloads meet by their SHA-1; only
digests that occur more than once are joined back, so the html is shuffled once.

A bundle's name is unique to the attempt that wrote it and only the rows of tasks that ended well reach
the index, so a task that is run again leaves at most a file that nothing refers to. Bundles go through
the file system of the folder's URI, next to `spark.checkpoint.dir` unless told otherwise.

Defined results: a null html is an empty payload; pages that share page_id and payload with the first
are responses too; a null page_id is stored without the identifier, and as revisit where another page has
the payload; line breaks in a url become blanks; an empty table gives no bundle and an empty index.
Columns of `pages` other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import join_repeated, map_texts, pieces, shared_folder, stored

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
LEVEL = 3
# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace for URLs
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame long, offset long, length long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """Record id and bytes of a response, or of a revisit of page `refers_to`."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.splitlines())}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(": ") for line in lines[1:])
    return {name.lower(): value for name, _, value in pairs}


def parse_record(record: bytes) -> dict:
    """The fields of RECORDS. A response's size and digest are taken anew from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n"))
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(_fields(http.split(b"\r\n"))["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
        raise ValueError(f"record {fields['warc-record-id']} does not hold the payload it names")
    number = {k: int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
    return {
        "page_id": number["x-page-id"], "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": number["x-refers-to-page-id"], "payload_bytes": size, "payload_digest": digest,
        "payload": payload if response else None,
    }


class BundleWriter:
    """One bundle: frames as they fill up, the seek table at the end."""

    def __init__(self, folder: str):
        self.system, path = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.system.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self.frame, self.written = bytearray(), 0
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                 "WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                 "Content-Length: 0\r\n\r\n\r\n\r\n".encode())

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset at which `record` stands."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self._flush()
        at = len(self.sizes), len(self.frame)
        self.frame += record
        return at

    def _flush(self) -> None:
        packed = self.compressor.compress(bytes(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *size) for size in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Frames of one bundle by number, found through its seek table; keeps the last one."""

    def __init__(self, bundle: str):
        system, path = pafs.FileSystem.from_uri(bundle)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{bundle} has no seek table")
        entry = 12 if descriptor & 0x80 else 8  # with checksums or without
        table = self._at(size - 9 - entry * count, entry * count)
        sizes = [struct.unpack_from("<II", table, entry * i) for i in range(count)]
        self.frames, start = [], 0
        for packed, plain in sizes:
            self.frames.append((start, packed, plain))
            start += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            start, packed, plain = self.frames[number]
            data = zstandard.ZstdDecompressor().decompress(self._at(start, packed), max_output_size=plain)
            self.last = number, data
        return self.last[1]


def find_repeats(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and for payloads that occur again the smallest page_id as `first`."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    found = (
        keyed.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return join_repeated(keyed, found, "digest", ["page_id"]).drop("digest")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page; returns the stored index (INDEX)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in pieces(batches, "payload"):
            rows = []
            for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                revisit = first is not None and first != page_id
                name, record = make_record(page_id, url, payload, first, revisit)
                if writer and writer.written > BUNDLE_BYTES:
                    writer.close()
                    writer = None
                writer = writer or BundleWriter(folder)
                frame, offset = writer.add(record)
                rows.append((name, page_id, writer.name, frame, offset, len(record)))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["record_id", "page_id", "bundle", "frame", "offset", "length"],
            )
        if writer:
            writer.close()

    repeats = find_repeats(pages, min_bytes).select("page_id", "url", "payload", "first")
    return stored(map_texts(repeats, write, INDEX), "warc-index")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of `index` (any rows of it), each frame read and unpacked once. Columns: RECORDS."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    names = names if with_payload else names[:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, reader = None, None
        for batch in batches:
            found, held = [], 0
            for name, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if name != bundle:
                    bundle, reader = name, BundleReader(name)
                record = parse_record(reader.frame(frame)[offset:offset + length])
                held += len(record["payload"] or b"") if with_payload else 0
                found.append([record[k] for k in names])
                if held > 8 << 20:
                    yield _records(found, names)
                    found, held = [], 0
            yield _records(found, names)

    # runs of frames: a task opens few bundles
    dealt = index.repartitionByRange("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.select("bundle", "frame", "offset", "length").mapInArrow(
        read, RECORDS if with_payload else RECORDS.rpartition(", ")[0]
    )


def _records(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def op3(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read all archives back: what the records say, one row per page."""
    index = write_archives(pages, folder or shared_folder(pages.sparkSession, "warc"))
    return read_archives(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
