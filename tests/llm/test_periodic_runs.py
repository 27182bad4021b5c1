"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import periodic_runs, queries


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: maximal stretches for each period, the smallest period of a stretch."""
    known: dict = {}
    row = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, row.size // 4 + 1):
        same = np.concatenate(([0], row[:-q] == row[q:], [0])).astype(np.int8)
        step = np.diff(same)
        for start, end in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            length = end - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_small_alphabets():
    random.seed(1)
    for _ in range(300):
        texts = []
        for _ in range(random.randint(1, 5)):
            words: list[int] = []
            for _ in range(random.randint(0, 8)):
                one = [random.randint(0, 3) for _ in range(random.randint(0, 12))]
                words += one if random.random() < 0.5 else one[:9] * random.randint(1, 7)
            texts.append(words)
        flat = np.array([w for words in texts for w in words], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        got = [*zip(*(c.tolist() for c in periodic_runs.find_runs(flat, text)), strict=True)]
        begins = np.cumsum([0, *map(len, texts)])
        assert got == [(s + b, n, q) for b, words in zip(begins, texts, strict=False) for s, n, q in plain_runs(words)]


def plain_row(doc_id, text, damage: bool = True) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    if damage and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    keep = np.ones(n, bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    digest = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
    left = hashlib.sha256(" ".join(w for w, k in zip(words, keep, strict=True) if k).encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, left)


def test_query_on_whole_tables(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        got = sorted(map(tuple, queries.periodic_run_query(spark, folder).collect()))
        assert got == sorted(plain_row(*r) for r in docs)
        assert any(r[1] for r in got)


def test_odd_rows(spark, monkeypatch):
    random.seed(2)
    texts = [None, "", " \t\x0b ", "a", "a a a a a a", "a b a b a b a b", "ab\x0cab\r\nab ab ab  ab", "é É é É é É é É", "x x " * 9]
    texts += ["la " * 60_000, "to be or not " * 4000 + "end", " ".join(str(random.randint(0, 99)) for _ in range(50_000))]
    rows = [(None if k == 4 else k % 11, t) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("runs", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("a.b", F.lit(None).cast("int"))
    for damage in (True, False):
        table = periodic_runs.planted(docs) if damage else docs
        got = periodic_runs.digests(table).collect()
        assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r, damage) for r in rows), key=str)
    whole = periodic_runs.periodic_runs(docs)
    assert whole.select("row.*").columns == docs.columns
    assert whole.where("collapsed IS NULL OR runs IS NULL").count() == 0
    assert periodic_runs.digests(docs.limit(0)).count() == 0
