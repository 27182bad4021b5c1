"""Round trips of pages through archives, and archives that aren't whole."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from paddock.llm import warc


def want(rows):
    last: dict[bytes, int | None] = {}
    for key, _, html in rows:
        data = (html or "").encode()
        known = [k for k in (last.get(data), key) if k is not None]
        last[data] = max(known, default=None)
    out = []
    for key, url, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and key != last[data]
        out.append((key, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[data] if revisit else None, None if revisit else data))
    return out


@pytest.mark.parametrize("archive_bytes", [1 << 24, 3000])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    page = "<p>é</p>" * 200
    rows = [(k, f"http://a/{k}", page if k % 3 else f"{k} {page}") for k in range(60)]
    rows += [(None, None, page), (60, None, None), (61, "http://x", ""), (62, "u", "short"), (63, "u", "short"), (64, "u", "a" * 999), (65, "u", "a" * 999)]
    rows += [(66, "u", "b" * 1000), (66, "u", "b" * 1000), (67, "u", "x" * 300_000), (None, "n", "z" * 2000), (None, "m", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).repartition(3)
    archives = warc.write(pages, warc.new_folder(spark))
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    got = [(*r[:-1], None if r.payload is None else bytes(r.payload)) for r in warc.read(archives).collect()]
    assert sorted(got, key=str) == sorted(want(rows), key=str)
    empty = warc.write(pages.limit(0), warc.new_folder(spark))
    assert warc.read(empty).count() == 0


def archive() -> bytes:
    record = warc.Record(5, "http://a", "response", None, hashlib.sha1(b"hello").hexdigest(), 5, b"hello")
    file = io.BytesIO()
    warc.write_archive(file, [warc.encode(record, "1970-01-01T00:00:00Z")] * 3)
    return file.getvalue()


def frames(record: bytes) -> bytes:
    return struct.pack("<II", warc.SKIPPABLE, 4) + b"none" + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"none")).compress(record)


def test_broken_archives():
    whole = archive()
    assert len(list(warc.read_archive(io.BytesIO(whole)))) == 3
    for cut in (0, 4, 20, len(whole) - 3):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(whole[:cut])))
    record = warc.encode(warc.Record(5, None, "response", None, hashlib.sha1(b"hello").hexdigest(), 5, b"hello"), "d")
    assert len(list(warc.read_archive(io.BytesIO(frames(record))))) == 1
    for old, new in ((b"hello", b"hallo"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date: d\r\n", b""), (b"hello\r\n\r\n", b"hello\r\n"), (b"WARC-Type: response", b"WARC-Type: other"), (b"urn:x-page", b"urn:y")):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(frames(record.replace(old, new, 1)))))


def test_compressed_dictionary():
    record = warc.encode(warc.Record(1, None, "response", None, hashlib.sha1(b"").hexdigest(), 0, b""), "d")
    content = record[:40]
    packed = zstandard.ZstdCompressor().compress(content)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content)).compress(record)
    data = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + frame
    assert [r.page_id for r in warc.read_archive(io.BytesIO(data))] == [1]
