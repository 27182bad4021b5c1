"""Near-duplicates by SimHash: a grid join of segment bit counts, then exact bit distances.

The embedding maps a fingerprint to the bit counts of its 32 segments of two bits. Fingerprints that differ in d bits
have counts whose Manhattan distance is at most d, and each bit changes one count only. So of 4 + d groups of segments,
4 at least agree wholly: cells of the grid are the counts of 4 groups, and fingerprints meet in the cells they share.
Those whose counts are farther apart than d drop out; the rest are compared bit by bit.

Counts are kept in unary, which sorts the two bits of a segment: then the Manhattan distance of two embeddings is the
number of bits in which they differ.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paddock.llm import components, shared

BITS = 64
SEED = 42
#: Fingerprints of one cell that are compared with each other; those of fuller cells meet in balls of bits instead.
CELL_ROWS = 512
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        cuts = zip((ends - lengths)[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts]
    parts = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((parts + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (seen @ _BITS_OF_BYTE).ravel() * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    @arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(bytes(t), shingle) for t in shared.slices(texts)], pa.int64())

    return hashed(F.coalesce(text, F.lit("")).cast("binary"))


def _constant(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits)


def embedding(fp: Column) -> Column:
    """Bit counts of the segments, in unary."""
    low, high = _constant(0x5555555555555555), _constant(0xAAAAAAAAAAAAAAAA)
    any_bit = (fp.bitwiseOR(F.shiftrightunsigned(fp, 1))).bitwiseAND(low)
    both_bits = (fp.bitwiseAND(F.shiftleft(fp, 1))).bitwiseAND(high)
    return any_bit.bitwiseOR(both_bits)


def _cell_masks(max_bits: int) -> list[int]:
    """What a cell keeps of the counts: all groups of segments but ``max_bits`` of them."""
    edges = np.linspace(0, BITS // 2, max_bits + 5).round().astype(int).tolist()
    groups = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [((1 << BITS) - 1) ^ sum(left_out) for left_out in combinations(groups, max_bits)]


def links(fingerprints: DataFrame, max_bits: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: pairs of distinct values of ``fingerprint`` that differ in at most ``max_bits`` bits, or chains of them.

    In a cell of more than ``cell_rows`` values the pairs aren't listed: values with a common neighbour half the distance
    away are within the distance of each other, so each is linked to the least of them. No link is lost either way.
    """
    masks = _cell_masks(max_bits)
    counts = embedding(F.col("fingerprint"))
    cells = F.array(*(F.struct(F.lit(m).alias("mask"), counts.bitwiseAND(_constant(k)).alias("cell")) for m, k in enumerate(masks)))
    values = fingerprints.select("fingerprint").distinct()
    rows = values.select("fingerprint", counts.alias("counts"), F.inline(cells))
    sizes = rows.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared_cells = shared.written(rows.join(sizes, ["mask", "cell"]), "cells")

    few = shared_cells.where(F.col("n") <= cell_rows).drop("n")
    one, two = (few.select("mask", "cell", F.col("fingerprint").alias(x), F.col("counts").alias(f"{x}_counts")) for x in "ab")
    apart = F.col("a_counts").bitwiseXOR(F.col("b_counts"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(_constant(k)) == 0, m) for m, k in enumerate(masks)))
    near = (
        (F.col("a") < F.col("b"))
        & (F.bit_count(apart) <= max_bits)  # the bound
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        & (first == F.col("one.mask"))  # a pair comes from one of the cells it shares
    )
    same = (F.col("one.mask") == F.col("two.mask")) & (F.col("one.cell") == F.col("two.cell"))
    pairs = one.alias("one").join(two.alias("two"), same & near)
    many = shared_cells.where(F.col("n") > cell_rows).select("fingerprint").distinct()
    return pairs.select("a", "b").unionByName(_ball_links(many, max_bits))


def _ball_links(values: DataFrame, max_bits: int) -> DataFrame:
    """Links through common neighbours: at most ``max_bits // 2`` bits from one end, the rest from the other."""
    inner = max_bits // 2
    flips = [sum(1 << b for b in bits) for r in range(max_bits - inner + 1) for bits in combinations(range(BITS), r)]
    ball = F.array(*(F.struct(_constant(f).alias("flip"), F.lit(f.bit_count() <= inner).alias("inner")) for f in flips))
    reached = values.select("fingerprint", F.inline(ball))
    reached = reached.select("fingerprint", "inner", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("center"))
    least = reached.groupBy("center").agg(
        F.min(F.when(F.col("inner"), F.col("fingerprint"))).alias("b"), F.count(F.lit(1)).alias("n")
    )
    met = reached.join(least.where("n > 1 AND b IS NOT NULL").drop("n"), "center").where("fingerprint <> b")
    return met.select(F.col("fingerprint").alias("a"), "b").distinct()


def classes(keys: DataFrame, max_bits: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """fingerprint, component_id, first (order, doc_id, text_md5 of the row to keep) for each distinct fingerprint."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5")).alias("first")
    distinct = shared.written(keys.groupBy("fingerprint").agg(least), "distinct-fingerprints")
    roots = components.components(links(distinct, max_bits, cell_rows))
    placed = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    placed = shared.written(placed.withColumn("root", F.coalesce("root", "fingerprint")), "roots")
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.drop("first").join(firsts, "root").select("fingerprint", F.col("first.doc_id").alias("component_id"), "first")


def near_duplicate_ids(docs: DataFrame, shingle: int = 3, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    component_id is the least doc_id of the rows whose fingerprints are linked, over any number of links. A null text is
    empty; texts without words have fingerprint 0. Rows with a null doc_id take part; a component of such rows only has
    a null id. Other columns aren't read.
    """
    keys = docs.select("doc_id", F.lit(None).cast("string").alias("text_md5"), fingerprint_column(F.col("text"), shingle).alias("fingerprint"))
    keys = shared.written(keys, "fingerprints")
    found = keys.join(classes(keys, max_bits, cell_rows), "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of ``docs`` for each component: that with the least doc_id (nulls last), then the least MD5 of its text.

    Of rows equal in doc_id and text the least stays, by its columns in their order; maps have no order, so with a column of
    maps it is any of them. Columns of ``docs`` stay as they are, whatever their names.
    """
    key = [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))]
    keys = docs.select("doc_id", key[1].alias("text_md5"), fingerprint_column(F.col("text"), shingle).alias("fingerprint"))
    keys = shared.written(keys, "fingerprints")
    first = classes(keys, max_bits, cell_rows).select("first.doc_id", "first.text_md5").distinct()
    first = first.select(F.col("doc_id").alias("first_id"), F.col("text_md5").alias("first_md5"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, key[0].alias("row_id"), key[1].alias("row_md5"))
    kept = rows.join(first, F.col("row_id").eqNullSafe(F.col("first_id")) & (F.col("row_md5") == F.col("first_md5")), "left_semi")
    least = F.first("row") if "map<" in rows.schema["row"].dataType.simpleString() else F.min("row")
    return kept.groupBy("row_id", "row_md5").agg(least.alias("row")).select("row.*")
