"""Periodic runs of words, found with a dictionary of basic factors.

For each power of two the dictionary names a text's stretches of that many words, equal stretches alike; the names of one length
are made from pairs of names of half of it. Neighbouring occurrences of a name that are at most twice its length apart stand
in arithmetic progressions inside a run, so their distance is proposed as a period. Each proposal is extended as far as
words one period apart agree; proposals that end up at the same place are one run, and its least proposal is its smallest period.

A run of period q and at least four times its length holds, at the first power of two that isn't below q, two neighbouring
occurrences exactly q apart, so none is missed. A stretch that occurs once can't be in a longer one that occurs twice, so
names of the next length are only made where two occurring twice meet: prose is done after a few lengths.

Texts are cut into words by tasks, some megabytes at once, and handled together as numpy arrays. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm import shared

SPACE = r"[\x20\x09-\x0D]+"
#: A run has this many words at least, and this many times its period.
LEAST_WORDS = 6
LEAST_TIMES = 4
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 4 << 20


def agreeing(words: np.ndarray, text: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places where words ``period`` apart agree: the first and the last such place of the same stretch, in the same text."""
    first, last = np.empty_like(at), np.empty_like(at)
    reached: dict[int, int] = {}  # the last place that a period's walk came to
    for k in np.argsort(at, kind="stable").tolist():
        place, q = int(at[k]), int(period[k])
        known = reached.get(q)
        if known is not None and place <= last[known]:
            first[k], last[k] = first[known], last[known]
            continue
        first[k], last[k] = (_walk(words, text, place, q, way) for way in (-1, 1))
        reached[q] = k
    return first, last


def _walk(words: np.ndarray, text: np.ndarray, place: int, q: int, way: int) -> int:
    """The farthest place from ``place`` on up to which all words agree with those q behind them."""
    step, end = 16, words.size - q
    while True:
        if way > 0:
            a, b = place + 1, min(place + 1 + step, end)
        else:
            a, b = max(place - step, 0), place
        if a >= b:
            return place
        same = (words[a:b] == words[a + q : b + q]) & (text[a:b] == text[a + q : b + q])
        wrong = np.flatnonzero(~same)
        if wrong.size:
            return a + int(wrong[0]) - 1 if way > 0 else a + int(wrong[-1]) + 1
        place, step = (b - 1 if way > 0 else a), step * 2


def proposals(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): where neighbouring occurrences of basic factors, at most twice their length apart, form progressions.

    In a run of period q, q + 1 places in a row at least have their next occurrence q words on; fewer propose nothing.
    """
    at, name = np.arange(words.size), words.astype(np.int64)
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    length = 1
    while at.size:
        order = np.lexsort((at, name, text[at]))  # occurrences of a name in one text, in order of place
        place, kind, where = at[order], name[order], text[at[order]]
        again = (kind[1:] == kind[:-1]) & (where[1:] == where[:-1])
        gap = np.diff(place)
        near = np.flatnonzero(again & (gap <= 2 * length))
        near = near[np.argsort(place[near])]
        row, step = place[near], gap[near]
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 1) | (np.diff(step) != 0)))[: row.size])
        steady = np.diff(np.append(heads, row.size)) > step[heads]
        places.append(row[heads[steady]])
        periods.append(step[heads[steady]])
        # names of twice the length, from places that begin two halves which both occur twice in the text
        twice = np.concatenate((again, [False])) | np.concatenate(([False], again))
        number = np.cumsum(np.concatenate(([True], ~again))) if place.size else place
        back = np.argsort(place[twice])
        at, name = place[twice][back], number[twice][back]
        other = np.searchsorted(at, at + length)
        has = other < at.size
        has[has] = at[other[has]] == at[has] + length
        has[has] = text[at[has]] == text[at[has] + length]
        name = name[has] * (int(number[-1]) + 1 if number.size else 1) + name[other[has]]
        at = at[has]
        length *= 2
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; ``text`` rises, and no run crosses from one to another."""
    place, period = proposals(words, text)
    start, last = agreeing(words, text, place, period)
    length = last - start + 1 + period
    enough = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    found = pd.DataFrame({"start": start[enough], "length": length[enough], "period": period[enough]})
    # proposals of one stretch are multiples of its smallest period
    found = found.groupby(["start", "length"], as_index=False)["period"].min().sort_values(["start", "period"])
    return tuple(found[c].to_numpy(np.int64) for c in ("start", "length", "period"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[memoryview]]]:
    """Rows and their texts, some megabytes at once."""
    for batch in batches:
        texts = [*shared.slices(batch.column("text"))]
        ends = np.cumsum([len(t) for t in texts])
        begin = 0
        while begin < len(texts):
            reach = (ends[begin - 1] if begin else 0) + BLOCK_BYTES
            end = max(begin + 1, int(np.searchsorted(ends, reach, "right")))
            yield batch.column("row").slice(begin, end - begin), texts[begin:end]
            begin = end


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _blocks(batches):
        split = [bytes(t).split() for t in texts]  # at the six characters of SPACE
        begins = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        spelled = np.empty(int(begins[-1]), object)
        spelled[:] = [w for words in split for w in words]
        words = pd.factorize(spelled)[0].astype(np.int64)
        text = np.repeat(np.arange(len(split)), np.diff(begins))
        start, length, period = find_runs(words, text)

        # words behind a run's first period are dropped: +1 where they begin, -1 behind them
        change = np.zeros(words.size + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        dropped = np.cumsum(change[:-1]) > 0
        owner = text[start]
        cut = np.searchsorted(owner, np.arange(len(split) + 1))
        left = []
        for k, own in enumerate(split):
            if cut[k] < cut[k + 1]:
                keep = ~dropped[begins[k] : begins[k + 1]]
                own = [w for w, stays in zip(own, keep.tolist(), strict=True) if stays]
            left.append(b" ".join(own))
        runs = pa.StructArray.from_arrays(
            [pa.array(start - begins[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"]
        )
        collapsed = pa.array(left, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                rows,
                pa.array(np.diff(begins)),
                pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs),
                collapsed,
            ],
            ["row", "n_words", "runs", "collapsed"],
        )
        del split, spelled
    shared.release_memory()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (the whole row of ``docs`` as a struct), n_words, runs (start, length, period by start, then period), collapsed.

    ``collapsed`` is the text's words with one space between them, but of each run only the first period. A null, an
    empty text and one of white space have no words, no runs and an empty ``collapsed``. Repeated rows, null ids and columns
    of any name are kept in ``row``. Order doesn't matter: rows are independent of each other.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if docs.columns else F.struct(F.lit(0).alias("none"))
    rows = docs.select(whole.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    made = T.StructType([rows.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "binary")
    out = rows.mapInArrow(_task, made)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, one text in ten with a period: from a place on, its words repeat the first ones behind that place.

    Place and period depend on the id's CRC-32; a null id counts as the empty string, whose CRC-32 is 0.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr("concat(slice(words, 1, int(a)), transform(sequence(a, n - 1), i -> words[int(a + (i - a) % p)]))")
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run (start, length, period, exponent_milli; nulls without one) and digests, per row.

    Of the longest runs the one that starts first counts, then the one of the smaller period.
    """
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = periodic_runs(docs.select("doc_id", "text")).withColumn("greatest", greatest)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("greatest.col2")).alias("start"),
        F.col("greatest.length").alias("length"),
        (-F.col("greatest.col3")).alias("period"),
        F.expr("1000 * greatest.length DIV -greatest.col3").alias("exponent_milli"),
        _sha256(text).alias("runs_sha256"),
        _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )
