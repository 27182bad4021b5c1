"""Packing of documents into token sequences of bounded length by cutting stock.

A document longer than a sequence is cut into whole sequences and a rest; no other is cut. Pieces are counted by size, in
steps of ``unit`` tokens; that histogram, of bounded size, is all that the driver gets. Column generation turns it into
patterns (see cutting_stock.py). Pieces are ranked within their size, and each pattern takes the ranks it is due.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from paddock.llm import cutting_stock, pieces, shared

CAPACITY = 4096
UNIT = 8
#: Texts that are cut into chunks of words at once.
TEXTS = 256
#: Pieces of one size that one task ranks.
SHARE_ROWS = 100_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.vocabulary(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), shared.slices(batch.column("text"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for first in range(0, len(keys), TEXTS):
                some = [pieces.chunks(bytes(t)) for t in islice(texts, TEXTS)]
                known.learn(set().union(*some))
                for key, words in zip(keys[first : first + TEXTS], some, strict=True):
                    data = b"".join(map(known.words.__getitem__, words)) + end
                    for at in range(0, len(data), 4 * capacity):
                        piece = data[at : at + 4 * capacity]
                        row = (key, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_PIECES)
        shared.release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` with their rank within ``size``, from 0. A frequent size is ranked in shares that are added up."""
    shares = F.create_map(*(F.lit(x) for size, n in counts.items() for x in (size, 1 + n // SHARE_ROWS)))
    order = ["doc_id", "start", "ids_crc32"]
    rows = rows.withColumn("share", F.pmod(F.xxhash64(*order), shares[F.col("size")]))
    before = rows.groupBy("size", "share").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("share")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("size", "share").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(before, ["size", "share"]).withColumn("rank", F.col("before") + F.col("own"))


def _sequence_of(size: Column, rank: Column, sizes: np.ndarray, found: np.ndarray, times: np.ndarray) -> Column:
    """The sequence for which a pattern takes the piece of this rank."""
    base = np.cumsum(times) - times
    of_size = []
    for k in range(sizes.size):
        has = np.flatnonzero(found[:, k])
        takes = found[has, k]
        ends = np.cumsum(takes * times[has])
        of_size.append((ends - takes * times[has], takes, base[has]))
    place = {int(s): k for k, s in enumerate(sizes)}

    @arrow_udf("long")
    def looked_up(size_column: pa.Array, rank_column: pa.Array) -> pa.Array:
        size, rank = shared.numbers(size_column), shared.numbers(rank_column)
        out = np.empty(size.size, np.int64)
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            begins, takes, first = of_size[place[s]]
            k = np.searchsorted(begins, rank[at], "right") - 1
            out[at] = first[k] + (rank[at] - begins[k]) // takes[k]
        return pa.array(out)

    return looked_up(size, rank)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` as in token_counts; ``end_id`` follows each document. A null or empty text is that one id. Sequences
    are numbered from 0 and filled without gaps; what is missing to ``capacity`` is padding. Null and repeated ids stay
    as they are; equal pieces of equal ids may change places. Other columns aren't read.
    """
    rows = cut(docs, tokenizer, end_id, capacity).withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    rows = shared.written(rows, "pieces")
    counts = dict(rows.groupBy("size").count().collect())  # at most capacity / unit rows
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[s] for s in sizes.tolist()], np.int64)
    found, times = cutting_stock.patterns(sizes, demand, capacity // unit)
    if not counts:
        return rows.drop("size").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    placed = _ranked(rows, counts)
    placed = placed.withColumn("sequence_id", _sequence_of(F.col("size"), F.col("rank"), sizes, found, times))
    before = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
