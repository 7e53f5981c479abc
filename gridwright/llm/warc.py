"""WARC archives of pages: compressed record by record with a Zstandard dictionary of their own.

Writing. Of pages with equal payloads of at least ``least_bytes`` the one with
the smallest id is a response, the others are revisit records that refer to it.
Every task writes its rows into archives of about ``archive_bytes`` each. An
archive begins with a skippable frame (magic number 0x184D2A5D) that holds a
dictionary built from its own first records (``sample_bytes`` at most); each
record is a frame of its own. Archives are written under names that no other
attempt uses, so a lost task leaves nothing that is read: what counts is the
manifest, a table of the archives of the tasks that ended well.

Reading goes archive by archive as a stream; one record is held at a time, and
a response's size and digest come from the payload as read.

Archives and manifest are in the shared folder of the session.

Defined cases: a null page is an empty payload, a null address an empty one;
repeated rows of the smallest id are responses each; payloads that only rows
without an id have are responses; extra columns are ignored; an empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.frames import column, released, slices, text_of, written
from gridwright.session import scratch_path

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most repeated digests that are broadcast (about 25 MB); beyond, the join shuffles.
BROADCAST_DIGESTS = 200_000
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, first_url: str, date: str) -> bytes:
    """A response record, or a revisit record if ``first`` names the page with the same payload."""
    url, first_url = (" ".join(u.split()) for u in (url, first_url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first, first_url)}",
                 f"WARC-Refers-To-Target-URI: {first_url}", f"X-Refers-To-Page-Id: {first}", f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; where they are too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class ArchiveWriter:
    """One archive: the records wait until there are enough for the dictionary, then go out as they come."""

    def __init__(self, folder: str, level: int, sample_bytes: int, dictionary_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.level, self.sample_bytes, self.dictionary_bytes = level, sample_bytes, dictionary_bytes
        self.waiting: list[bytes] = []
        self.held = self.raw = self.records = self.written = 0
        self.out = self.compressor = None

    def add(self, one: bytes) -> None:
        self.records += 1
        self.raw += len(one)
        if self.out is not None:
            self._put(self.compressor.compress(one))
            return
        self.waiting.append(one)
        self.held += len(one)
        if self.held >= self.sample_bytes:
            self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _open(self) -> None:
        sample, taken = [], 0
        for one in self.waiting:
            sample.append(one[: self.sample_bytes - taken])  # what trains the dictionary is bounded; records are kept whole
            taken += len(sample[-1])
        made = dictionary([s for s in sample if s], self.dictionary_bytes)
        filesystem, path = _filesystem(self.path)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = filesystem.open_output_stream(path)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(made)) + made)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(made) if made else None)
        for one in self.waiting:
            self._put(self.compressor.compress(one))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        self.out.close()
        return self.path, self.records, self.written


def write(
    pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least_bytes: int = 100, archive_bytes: int = 64 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 32 << 10,
    level: int = 3, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives; returns the manifest (``path``, ``records``, ``bytes``)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(
        column(id_column).cast("long").alias("page_id"), text_of(url_column).alias("url"), text_of(payload_column).alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    again = written(rows.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("pages")).filter("pages > 1").select("digest", "first"), "digests")
    known = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    rows = rows.join(known, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")), F.col("first.page_id")).alias("first"),
        F.coalesce("first.url", F.lit("")).alias("first_url"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = [], None
        for batch in batches:
            for part in slices(batch, "payload", 4 << 20):
                for page_id, url, payload, digest, first, first_url in zip(*(c.to_pylist() for c in part.columns)):
                    if writer is None:
                        writer = ArchiveWriter(folder, level, sample_bytes, dictionary_bytes)
                    writer.add(record(page_id, url, payload.encode(), digest, first, first_url, date))
                    if writer.raw >= archive_bytes:
                        made.append(writer.close())
                        writer = None
        if writer is not None:
            made.append(writer.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*made))], ["path", "records", "bytes"])

    return written(rows.mapInArrow(released(archive), "path string, records long, bytes long"), "manifest")


def records_of(path: str) -> Iterator[tuple]:
    """The records of an archive: page, address, payload's size and digest, type, page referred to."""
    filesystem, inside = _filesystem(path)
    with filesystem.open_input_stream(inside) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        data = source.read(size)
        if data[:4] == struct.pack("<I", ZSTD_MAGIC):
            data = zstandard.ZstdDecompressor().decompress(data)
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        with plain.stream_reader(source, read_across_frames=True) as stream:
            held = b""
            while True:
                while b"\r\n\r\n" not in held:
                    more = stream.read(1 << 16)
                    if not more:
                        if held:
                            raise ValueError(f"{path} ends inside a record")
                        return
                    held += more
                head, _, held = held.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                parts, need = [held], int(fields["Content-Length"]) + 4 - len(held)
                while need > 0:
                    more = stream.read(min(need, 1 << 20))
                    if not more:
                        raise ValueError(f"{path} ends inside a record")
                    parts.append(more)
                    need -= len(more)
                block = b"".join(parts)
                block, held = block[: int(fields["Content-Length"])], block[int(fields["Content-Length"]) + 4:]
                page = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
                if fields["WARC-Type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    yield page, fields["WARC-Target-URI"], len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload
                else:
                    yield (page, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                           "revisit", int(fields["X-Refers-To-Page-Id"]), None)


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a manifest."""
    names = [*_NAMES, "payload"][: 7 if with_payload else 6]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for one in records_of(path):
                    rows.append(one[: len(names)])
                    held += len(one[6] or b"") * with_payload
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names)

    # an archive is a task's work: they are dealt out evenly
    archives = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(archives, "path").mapInArrow(released(parsed), (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload))
