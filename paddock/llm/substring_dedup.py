"""Removal of long strings that occur more than once in a corpus, found with suffix arrays.

A suffix array of the whole corpus would need one machine, so equal strings are brought together first:

1. Each window of ``length`` bytes picks as its anchor the gram (a third of it, see ``gram_of``) with the least hash in it. Neighbouring windows
   mostly pick the same one, so a text becomes a short list of regions: an anchor with all windows that picked it. Equal
   windows pick equal anchors, so windows need to be compared only within regions of equal anchors.
2. Regions are counted by (anchor, content). Equal regions are repeats already, and one of each content stands for all.
3. The contents of one anchor are compared by the suffix array of their bytes, which is built by linear grouping
   construction (see suffix_array.py): a string is repeated if its suffix shares ``length`` bytes with a neighbour.

An anchor with more than HOT_REGIONS contents is dealt anew by each pair of windows' common bytes; such a key can't have
more contents than there are pairs of bytes around them, however many rows share it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm import shared, suffix_array

#: Contents of one anchor that one task compares: at most 2.8 MB.
HOT_REGIONS = 4096
#: Windows of a text that are handled at once, a bound on memory.
CHUNK = 1 << 19
#: Bytes of regions that one task gathers before it builds their suffix arrays.
GATHER_BYTES = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)

ANCHOR_SCHEMA = "anchor long, content long, copies int, text_id binary, at long, size int"
_PLACE = ["text_id", "at", "size"]


def gram_of(length: int) -> int:
    """Bytes of an anchor: long enough to be rare, short enough that many windows share it; 128 of 400."""
    return max(1, length * 8 // 25)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes, from one running sum."""
    size = 1 << max(12, (data.size + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(data * up[: data.size], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: data.size - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each window stands, the leftmost of equal ones."""
    n = values.size
    rows = -(-n // width) + 1
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    at = np.arange(rows * width).reshape(rows, width)
    prefix = np.minimum.accumulate(blocks, axis=1)
    lower = np.ones(blocks.shape, bool)
    lower[:, 1:] = prefix[:, 1:] < prefix[:, :-1]
    prefix_at = np.maximum.accumulate(np.where(lower, at, 0), axis=1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    suffix_at = np.minimum.accumulate(np.where(suffix == blocks, at, rows * width)[:, ::-1], axis=1)[:, ::-1]
    windows = n - width + 1
    suffix, prefix = suffix.ravel()[:windows], prefix.ravel()[width - 1 : width - 1 + windows]
    return np.where(
        suffix <= prefix, suffix_at.ravel()[:windows], prefix_at.ravel()[width - 1 : width - 1 + windows]
    )


def regions(text: memoryview, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, content, start, size) of all regions of a text; every window is in exactly one."""
    gram = gram_of(length)
    for begin in range(0, len(text) - length + 1, CHUNK):
        part = text[begin : begin + CHUNK + length - 1]
        hashes = gram_hashes(np.frombuffer(part, np.uint8), gram)
        anchors = least_in_window(hashes, length - gram + 1)
        starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        ends = np.append(starts[1:], anchors.size) - 1 + length
        keys = hashes[anchors[starts]].view(np.int64).tolist()
        for key, a, b in zip(keys, starts.tolist(), ends.tolist(), strict=True):
            yield key, _signed(xxhash.xxh3_64_intdigest(part[a:b])), begin + a, b - a


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_id(text: Column) -> Column:
    """Texts are told apart by the 128-bit MD5 of their bytes, so ids may be null or repeated."""
    found = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.coalesce(found, F.lit(b""))  # never null, and the planner knows: joins of any kind read the same shuffled texts


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text_id, content (bytes), copies. Copies meet in the map tasks first, so a large group isn't one task's."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(text_id(F.col("text")).alias("text_id"), content.alias("content"))
    return rows.groupBy("text_id").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("copies"))


def _batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ANCHORS = pa.schema(
    [("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int32()), ("text_id", pa.binary()), ("at", pa.int64()), ("size", pa.int32())]
)


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            ids, copies = batch.column("text_id").to_pylist(), batch.column("copies").to_pylist()
            for k, text in enumerate(shared.slices(batch.column("content"))):
                for row in regions(text, length):
                    for column, value in zip(out, (*row[:2], min(copies[k], 2), ids[k], *row[2:]), strict=True):
                        column.append(value)
            yield _batch(_ANCHORS, *out)
            del out
        shared.release_memory()

    long_enough = texts.where(F.octet_length("content") >= length)
    return long_enough.select("text_id", "content", "copies").mapInArrow(task, ANCHOR_SCHEMA)


def _with_regions(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` of each text beside its bytes: a list for a text, never longer than the text has windows.

    All columns of ``texts`` go on, so that a query that needs them all elsewhere shuffles the texts once.
    """
    per_text = places.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "copies", "at", "size")).alias("places"))
    return texts.join(per_text, "text_id").select("text_id", "content", "copies", "places")


def _places(batch: pa.RecordBatch) -> Iterator[tuple[bytes, memoryview, list[list[int]]]]:
    """(text id, text, [[anchor, copies, start, size], ...]) of each row."""
    lists = batch.column("places")
    fields = list(zip(*(numbers.tolist() for numbers in map(shared.numbers, lists.flatten().flatten())), strict=True))
    ends = np.cumsum(shared.numbers(lists.value_lengths())).tolist()
    begin = 0
    texts = shared.slices(batch.column("content"))
    for key, text, end in zip(batch.column("text_id").to_pylist(), texts, ends, strict=True):
        yield key, text, fields[begin:end]
        begin = end


def _dealt_anew(texts: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Regions of two windows each for those of hot anchors; their key is what both windows share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for key, text, places in _places(batch):
                gram = gram_of(length)
                for anchor, copies, at, size in places:
                    part = text[at : at + size]
                    hashes = gram_hashes(np.frombuffer(part, np.uint8), gram).view(np.int64)
                    odd = int(np.flatnonzero(hashes == anchor)[0]) % 2  # pairs keep their place beside the anchor
                    for start in range(-odd, size - length + 1, 2):
                        a, b = max(start, 0), min(start + 1, size - length) + length
                        core = part[start + 1 : start + length]
                        row = (_signed(xxhash.xxh3_64_intdigest(core)), _signed(xxhash.xxh3_64_intdigest(part[a:b])))
                        for column, value in zip(out, (*row, copies, key, at + a, b - a), strict=True):
                            column.append(value)
            yield _batch(_ANCHORS, *out)

    return _with_regions(texts, hot).mapInArrow(task, ANCHOR_SCHEMA)


def _shared(anchors: DataFrame) -> DataFrame:
    """Regions whose anchor has another region: ``copies`` of the content, ``contents`` of the anchor, ``stands`` for them."""
    place = F.xxhash64("text_id", "at")
    contents = anchors.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(place).alias("stands"))
    keys = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum("copies").alias("all"))
    several = contents.join(keys.where("all > 1").drop("all"), "anchor")
    several = several.where("copies > 1 OR contents > 1")
    rows = anchors.drop("copies").join(several, ["anchor", "content"])
    return rows.withColumn("stands", place == F.col("stands"))


def _suffix_array_starts(regions_of: DataFrame, length: int) -> DataFrame:
    """Repeated windows by the suffix array of each anchor's regions: text_id, first, last."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("copies", pa.int64()), ("text_id", pa.binary()), ("at", pa.int64()), ("region", pa.binary())])
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, places in _places(batch):
                for anchor, copies, at, size in places:
                    for column, value in zip(out, (anchor, copies, key, at, text[at : at + size]), strict=True):
                        column.append(value)
            yield _batch(schema, *out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[bytes]] = []
        rows: list[tuple[int, bytes, int]] = []
        last, held = None, 0
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("anchor", "copies", "text_id", "at", "region"))
            for anchor, copies, key, at, region in zip(*columns, strict=True):
                if anchor != last:
                    if held >= GATHER_BYTES:
                        yield _starts(groups, rows, length)
                        groups, rows, held = [], [], 0
                    groups.append([])
                    last = anchor
                groups[-1].append(region)
                rows.append((copies, key, at))
                held += len(region)
        if groups:
            yield _starts(groups, rows, length)
        del groups, rows
        shared.release_memory()

    found = regions_of.mapInArrow(cut, "anchor long, copies long, text_id binary, at long, region binary")
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "text_id binary, first long, last long")


def _starts(groups: list[list[bytes]], rows: list[tuple[int, bytes, int]], length: int) -> pa.RecordBatch:
    out: tuple[list, ...] = ([], [], [])
    for (copies, key, at), starts in zip(rows, suffix_array.repeated_starts(groups, length), strict=True):
        if copies == 1 and starts.size:  # all windows of the others are repeated anyway
            cut = np.flatnonzero(np.diff(starts) > 1)
            firsts, lasts = starts[np.append(0, cut + 1)], starts[np.append(cut, starts.size - 1)]
            out[0].extend([key] * firsts.size)
            out[1].extend((firsts + at).tolist())
            out[2].extend((lasts + at).tolist())
    return _batch(pa.schema([("text_id", pa.binary()), ("first", pa.int64()), ("last", pa.int64())]), *out)


def repeated_windows(texts: DataFrame, length: int, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """text_id, first, last: runs of starts of strings of ``length`` bytes that also start elsewhere."""
    anchors = shared.written(_anchor_rows(texts, length), "anchors")
    places = shared.written(_shared(anchors), "shared")
    shared.dropped(anchors)
    compared = places.where((F.col("contents") > 1) & (F.col("contents") <= hot_regions) & F.col("stands"))
    equal = places.where("copies > 1")
    hot = places.where((F.col("contents") > hot_regions) & F.col("stands"))
    if not hot.isEmpty():  # else the texts needn't be moved for them
        dealt = shared.written(_shared(shared.written(_dealt_anew(texts, hot, length), "hot")), "hot-shared")
        compared = compared.unionByName(dealt.where((F.col("contents") > 1) & F.col("stands")))
        equal = equal.unionByName(dealt.where("copies > 1"))
    runs = equal.select("text_id", F.col("at").alias("first"), (F.col("at") + F.col("size") - length).alias("last"))
    return runs.unionByName(_suffix_array_starts(_with_regions(texts, compared), length))


def without_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, hot_regions: int = HOT_REGIONS) -> DataFrame:
    """Each row of ``docs`` with its text_id, n_bytes, n_removed, n_spans, kept_sha256 in place of ``text``.

    Every byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else in the corpus,
    the same text included. Overlapping ones count; strings are judged on the input. ``with_text`` keeps ``text``, with
    the kept bytes; a character that lost some of its bytes goes whole.

    A null text is empty. Ids and other columns aren't looked at, so nulls and repeated ids are harmless; a repeated row
    is a copy of its text. Columns named like those of the result are replaced. Texts shorter than ``length`` stay.
    """
    texts = distinct_texts(docs)
    runs = repeated_windows(texts, length, hot_regions)
    per_text = runs.groupBy("text_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    fields = [("text_id", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("text", pa.string())] * with_text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in schema)
            columns = (batch.column("text_id").to_pylist(), batch.column("copies").to_pylist(), batch.column("runs"))
            for text, key, copies, found in zip(shared.slices(batch.column("content")), *columns, strict=True):
                if copies > 1 and len(text) >= length:
                    spans = [(0, len(text))]
                else:
                    found = found.values
                    spans = [] if found is None else _merged(*map(shared.numbers, found.flatten()), length)
                kept = bytes(text) if not spans else b"".join(
                    text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True)
                )
                row = (key, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                for column, value in zip(out, (*row, kept.decode("utf-8", "ignore")), strict=False):
                    column.append(value)
            yield _batch(schema, *out)
            del out
        shared.release_memory()

    kinds = "text_id binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    joined = texts.join(per_text, "text_id", "left").select("text_id", "content", "copies", "runs")
    results = joined.mapInArrow(task, kinds)
    rows = docs.withColumn("text_id", text_id(F.col("text")))
    rows = rows.drop(*(c for c in results.columns if c != "text_id"), "text")
    return rows.join(results, "text_id")


def _merged(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The byte ranges that windows starting at first..last cover, joined where they touch."""
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(last[by] + length)
    head = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1])))
    return list(zip(first[head].tolist(), end[np.append(head[1:], first.size) - 1].tolist(), strict=True))
