"""Words of blocks of documents, and numbers packed as bytes, for joins of texts with a table of words.

A block is what one task reads of the documents, up to some megabytes. Its words go out once each, with a posting list:
which of the block's documents have the word, and how often. So a join on words moves a few bytes for a word of a
document, and what it finds comes back to the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paddock.llm import shared


#: Numbers that are packed at once, a bound on memory.
PACK = 1 << 18


def pack(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of 7 bits, the last of a number without the high bit; ``cuts`` become byte places."""
    packed = [_packed(values[a : a + PACK].astype(np.uint64)) for a in range(0, values.size, PACK)]
    ends = np.concatenate([np.zeros(1, np.int64), *(sizes for _, sizes in packed)]).cumsum()
    return np.concatenate([np.empty(0, np.uint8), *(data for data, _ in packed)]), ends[cuts]


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.ones(values.size, np.uint8)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(ends[-1]), np.uint8)
    at, rest, left = ends - sizes, values, sizes
    while at.size:
        last = left == 1
        out[at] = (rest & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8)
        on = ~last
        at, rest, left = at[on] + 1, rest[on] >> np.uint64(7), left[on] - 1
    return out, sizes


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each one's bytes end."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if ends.size else ends
    values = np.zeros(ends.size, np.int64)
    longest = int((ends - starts).max(initial=0))
    for k in range(longest):
        has = ends - starts > k
        values[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return values, ends


def binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of the pieces of ``data`` between ``cuts``."""
    return pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins; one more for the end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def pack_ids(ids: list) -> bytes:
    """Whole numbers or nulls as bytes; as a column of arrays they would cost a row more than all else in it."""
    nulls = np.array([i is None for i in ids], bool)
    return np.array([0 if i is None else i for i in ids], "<i8").tobytes() + nulls.tobytes()


def unpack_ids(data: bytes) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data, "<i8", n), pa.int64(), mask=np.frombuffer(data, bool, n, 8 * n))


def posting_lists(words: np.ndarray, docs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed lists of (step to the next document, occurrences) for words 0..n_words - 1, their cuts, their lengths."""
    width = int(docs.max(initial=0)) + 1
    pairs, counts = np.unique(words * np.int64(width) + docs, return_counts=True)
    word, doc = np.divmod(pairs, width)
    first = np.concatenate(([True], word[1:] != word[:-1])) if word.size else np.empty(0, bool)
    step = np.where(first, doc, np.diff(doc, prepend=0))
    lengths = np.bincount(word, minlength=n_words)
    data, cuts = pack(np.column_stack((step, counts)).ravel(), 2 * np.concatenate(([0], np.cumsum(lengths))))
    return data, cuts, lengths


def read_postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, occurrences) of all posting lists of a column."""
    data, starts = joined(column)
    values, ends = unpack(data)
    steps, counts = values[::2], values[1::2]
    row = np.searchsorted(starts[1:], ends[::2], "left")
    total = np.cumsum(steps)
    first = np.concatenate(([True], row[1:] != row[:-1])) if row.size else np.empty(0, bool)
    heads = np.flatnonzero(first)
    base = np.repeat(total[heads] - steps[heads], np.diff(np.append(heads, row.size)))
    return row, total - base, counts


def steady(rows: DataFrame) -> DataFrame:
    """``rows`` such that a task that is run again gets the same rows in the same order: what comes out of a shuffle is written."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return shared.written(rows, "rows") if "Exchange" in plan else rows


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, list, list[memoryview]]]:
    """(block, ids, texts) of doc_id and text columns, of ``steady`` rows.

    A block's number is made of its task's partition and a running number: no two tasks have the same, whatever their
    rows, and a rerun gives the same.
    """
    partition = TaskContext.get().partitionId()
    ids: list = []
    texts: list[memoryview] = []
    held, running = 0, 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), shared.slices(batch.column("text")), strict=True):
            ids.append(key)
            texts.append(text)
            held += len(text)
            if held >= most_bytes:
                yield running << 32 | partition, ids, texts
                ids, texts, held, running = [], [], 0, running + 1
    if ids:
        yield running << 32 | partition, ids, texts
