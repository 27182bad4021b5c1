"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame for each record.

Tasks write archives of bounded size into the shared folder and return their paths, so files that a failed attempt left
behind are never read. Payloads that occur more than once are stored once; the other records refer to that one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import IO, NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import shared

#: Bytes of records before compression that one archive holds, some record more.
ARCHIVE_BYTES = 1 << 24
DICTIONARY_BYTES = 1 << 15
SAMPLE_BYTES = 1 << 21
LEVEL = 3
READ_BYTES = 1 << 14
#: Payloads shorter than this are stored each time.
LEAST_REVISIT = 1000

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    digest: str  # SHA-1 of the full payload in lower-case hex
    size: int  # bytes of the full payload
    payload: bytes | None  # None in a revisit


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(none|-?\d+)>", urn)
    if not found:
        raise ValueError(f"not a record id of these archives: {urn!r}")
    return None if found[1] == "none" else int(found[1])


def encode(record: Record, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record.size}\r\n\r\n".encode()
    block = http + (record.payload or b"")
    headers = {"WARC-Type": record.record_type, "WARC-Record-ID": _urn(record.page_id), "WARC-Date": date}
    if record.url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url)
    headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(record.digest)).decode()
    if record.record_type == "revisit":
        headers |= {"WARC-Refers-To": _urn(record.refers_to), "WARC-Profile": REVISIT_PROFILE}
    headers |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"not a header: {line!r}")
        found[name.lower()] = value.strip()
    return found


def decode(data: bytes) -> Record:
    """The record in one frame; ValueError if its headers, lengths or digest don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("not a WARC/1.1 record")
    headers = _headers(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - headers.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block isn't of {length} bytes")
    status, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not status.startswith(b"HTTP/1.1 "):
        raise ValueError("the block isn't an HTTP response")
    size = int(_headers(status.partition(b"\r\n")[2])["content-length"])
    kind, _, value = headers["warc-payload-digest"].partition(":")
    if kind != "sha1":
        raise ValueError(f"unknown digest {kind!r}")
    digest = base64.b32decode(value).hex()
    key, url = _page_id(headers["warc-record-id"]), headers.get("warc-target-uri")
    if headers["warc-type"] == "revisit":
        if payload or headers.get("warc-profile") != REVISIT_PROFILE:
            raise ValueError("a revisit has a profile and no payload")
        return Record(key, url, "revisit", _page_id(headers["warc-refers-to"]), digest, size, None)
    if headers["warc-type"] != "response":
        raise ValueError(f"unknown record type {headers['warc-type']!r}")
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload doesn't have its length or digest")
    return Record(key, url, "response", None, digest, size, payload)


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over the archive; where they are too few, the first one's bytes serve."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:DICTIONARY_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(file: IO[bytes], records: list[bytes]) -> None:
    dictionary = _dictionary(records)
    content = dictionary.as_bytes()
    file.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for record in records:
        file.write(compressor.compress(record))


def read_archive(file: IO[bytes]) -> Iterator[Record]:
    """All records, one at a time; ValueError if the archive isn't whole."""
    head = file.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    content = file.read(size)
    if len(content) != size:
        raise ValueError("the dictionary frame is cut off")
    if content.startswith(FRAME):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    data = file.read(READ_BYTES)
    while data:
        frame = decompressor.decompressobj()
        parts = []
        while not frame.eof:
            if not data:
                raise ValueError("the last frame is cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as error:
                raise ValueError(f"not a Zstandard frame: {error}") from error
            data = frame.unused_data if frame.eof else file.read(READ_BYTES)
        yield decode(b"".join(parts))
        data = data or file.read(READ_BYTES)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write an archive record for each row of ``pages`` (page_id, url, html) below ``folder``; path and records of each archive.

    Of rows with equal payloads of at least ``least_revisit`` bytes, that with the largest page_id is the response, and
    the others are revisits of it; rows that share that id are all responses, and so are equal rows without any id.
    A null html is an empty payload, a null url has no header. Other columns aren't read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    long_enough = F.col("size") >= least_revisit
    copies = rows.where(long_enough).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = copies.where("n > 1").withColumnRenamed("digest", "of").withColumnRenamed("size", "of_size")
    rows = rows.join(copies, long_enough & (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select(
        "page_id", "url", "digest", "size", revisit.alias("revisit"),
        F.when(revisit, F.col("last")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            system, place = _open(path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place) as file:
                write_archive(file, records)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64())], ["path", "records"])

        records: list[bytes] = []
        held = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "revisit", "refers_to", "digest", "size", "payload"))
            for page_id, url, is_revisit, refers_to, digest, size, content in zip(*columns, strict=True):
                kind = "revisit" if is_revisit else "response"
                records.append(encode(Record(page_id, url, kind, refers_to, digest, size, content), date))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield archive()
                    records, held = [], 0
        if records:
            yield archive()

    return shared.written(rows.mapInArrow(task, "path string, records long"), "archives")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in column ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    ``with_payload`` adds payload (null in revisits). Frames are decoded and checked one at a time.
    """
    fields = list(_READ) if with_payload else list(_READ)[:-1]
    schema = pa.schema(fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = _open(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(place) as file:
                    for r in read_archive(file):
                        rows.append((r.page_id, r.url, r.size, r.digest, r.record_type, r.refers_to, r.payload)[: len(fields)])
                        held += len(r.payload or b"") if with_payload else 1
                        if held >= ARCHIVE_BYTES // 4:
                            yield _columns(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _columns(rows, schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition("path").mapInArrow(task, kinds + ", payload binary" * with_payload)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def new_folder(spark) -> str:
    return f"{shared.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
