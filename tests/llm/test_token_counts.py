"""Token counts against the tokenizer itself, and packed numbers."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paddock.llm import postings, token_counts

FILE = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def test_pack_and_unpack():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40])
    data, cuts = postings.pack(values, np.array([0, 3, 7]))
    assert postings.unpack(data)[0].tolist() == values.tolist()
    assert cuts.tolist() == [0, 3, data.size]


def test_posting_lists():
    rng = np.random.default_rng(2)
    words, docs = rng.integers(0, 50, 4000), np.sort(rng.integers(0, 300, 4000))
    data, cuts, _ = postings.posting_lists(words, docs, 52)
    row, doc, counts = postings.read_postings(postings.binary(data, cuts))
    got = {(r, d): c for r, d, c in zip(row.tolist(), doc.tolist(), counts.tolist(), strict=True)}
    pairs, n = np.unique(np.column_stack((words, docs)), axis=0, return_counts=True)
    assert got == {(w, d): c for (w, d), c in zip(pairs.tolist(), n.tolist(), strict=True)}


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_against_the_library(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block_bytes)
    odd = [
        None, "", " \t\n", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>", "Don't 'S it's", "H̱ É é!",
        "x" * 9000, "1234 5,6", " a b\u0085c\x1cd", "İstanbul ΣΑΣ", "K Å", "\x00 \x01", "word. " * 3000,
    ]
    rows = [(None if k % 5 == 4 else k // 2, t) for k, t in enumerate(odd)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = token_counts.token_counts(docs, FILE).collect()
    encoder = Tokenizer.from_file(FILE)
    want = []
    for key, text in rows:
        n = len(encoder.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), FILE).count() == 0


def test_equal_tasks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).toPandas()[["doc_id", "text"]]
    docs = spark.createDataFrame(docs).coalesce(1)
    for twice in (docs.union(docs), docs.union(docs).repartition(2)):
        got = sorted(map(tuple, token_counts.token_counts(twice, FILE).collect()))
        assert got == sorted(2 * [*map(tuple, token_counts.token_counts(docs, FILE).collect())])
