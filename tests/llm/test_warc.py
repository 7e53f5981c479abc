import gzip
import hashlib
import struct

import pyarrow.fs as fs
import zstandard

from gridwright.llm import queries, warc


def expected(rows, least=100):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        again = refers is not None and (i is None or i > refers)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", refers if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, first string")


def page(i, extra=""):
    return f"<html><head><title>Page {i}</title></head><body><p>Some text of page {i} é \U0001f600</p>{extra}</body></html>"


ROWS = [(i, f"http://a.example/{i}", page(i % 40, "lorem ipsum " * (i % 7))) for i in range(200)] + [
    (300, "http://b.example/x\r\ny", "\r\n\r\n" * 60), (301, None, None), (302, "http://b.example", ""), (303, "u", "short"), (304, "u", "short"),
    (5, "http://a.example/5", page(5, "lorem ipsum " * 5)), (None, "http://n.example", page(77)), (305, "long", "x y z " * 400_000),
]


def test_round_trip(spark):
    docs = pages(spark, ROWS).repartition(3)
    manifest = warc.write(docs, archive_bytes=20_000)
    assert manifest.count() > 3
    got = sorted((tuple(r) for r in warc.read(spark, manifest).drop("url").collect()), key=repr)
    assert got == expected(ROWS)
    payloads = {(r["page_id"], r["payload_bytes"]): bytes(r["payload"]) for r in warc.read(spark, manifest, with_payload=True).collect()
                if r["record_type"] == "response"}
    for i, _, html in ROWS:
        data = (html or "").encode()
        assert payloads.get((i, len(data)), data) == data


def test_frames(spark):
    """Outside of this package's reader: a dictionary in a skippable frame, then a frame for each record."""
    manifest = warc.write(pages(spark, ROWS[:200]).coalesce(1))
    row = manifest.first()
    filesystem, path = fs.FileSystem.from_uri(row["path"])
    data = filesystem.open_input_stream(path).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size <= 32 << 10 and len(data) == row["bytes"]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8: 8 + size]))
    rest, records = data[8 + size:], []
    while rest:
        one = plain.decompressobj()
        records.append(one.decompress(rest))
        rest = one.unused_data
    assert len(records) == 200 == row["records"]
    for one in records:
        head, _, tail = one.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert one.startswith(b"WARC/1.1\r\n") and len(tail) == int(fields["Content-Length"]) + 4 and tail.endswith(b"\r\n\r\n")
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - 8 - size < 0.7 * alone and len(gzip.compress(b"".join(records))) > 0


def test_no_rows_and_few(spark):
    none = pages(spark, ROWS[:1]).limit(0)
    assert warc.read(spark, warc.write(none)).count() == 0
    one = warc.read(spark, warc.write(pages(spark, [(1, "u", None)])))
    assert tuple(one.drop("url").first()) == (1, 0, hashlib.sha256(b"").hexdigest(), "response", None)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op4_warc"](spark, sf).collect()), key=repr) == expected(rows)
