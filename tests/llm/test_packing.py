"""Patterns against demand and bound, pieces against the tokenizer."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paddock.llm import cutting_stock, packing, pieces

FILE = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"


def test_knapsack_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        prices = rng.random(4)
        value, pattern = cutting_stock.best_pattern(prices, sizes, 20)
        grid = np.stack(np.meshgrid(*[np.arange(21)] * 4, indexing="ij"), -1).reshape(-1, 4)
        assert np.isclose(value, (grid[grid @ sizes <= 20] @ prices).max())
        assert np.isclose(pattern @ prices, value) and pattern @ sizes <= 20


def test_patterns_pack_the_demand():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60):
        sizes = np.sort(rng.choice(np.arange(1, 129), n, replace=False))
        demand = rng.integers(1, 2000, n)
        found, times = cutting_stock.patterns(sizes, demand, 128)
        _, used = cutting_stock.fractional(sizes, demand.astype(float), 128)
        assert (times @ found == demand).all()
        assert (found @ sizes <= 128).all()
        assert used.sum() <= times.sum() <= used.sum() + n
        bound = max(demand @ sizes / 128, demand[sizes > 64].sum())
        assert used.sum() >= bound - 1e-6


def test_against_the_tokenizer(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(None, None), (7, ""), (7, ""), (8, "Word, " * 9000), (8, "Word, " * 9000), (9, "a<|endoftext|>B é Ü <|ENDOFTEXT|>"), (None, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(3)
    got = packing.packed(docs, FILE).collect()
    encoder = Tokenizer.from_file(FILE)
    want = []
    for key, text in rows:
        data = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(key, a, len(data[a : a + 4096]), zlib.crc32(data[a : a + 4096].tobytes()), len(data)) for a in range(0, len(data), 4096)]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    used: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096
    assert sum(r.length for r in got) / (4096 * len(used)) > 0.98


def test_words_in_parts_have_the_same_ids():
    encoder = Tokenizer.from_file(FILE)
    words = "word Word, (don't) 'S it's x<|endoftext|>y <|ENDOFTEXT|> H̱a é É. e\u0301 İst ¼x² a1b22c №5 ЖЖ, ｆｕｌｌ a_b __ --a--b Ünïcode! ß ǅ ŉ ΑΣ\u0085b a\u00a0b ²".split(" ")
    known = pieces.Vocabulary(encoder)
    known.learn({w.encode() for w in words})
    for w in words:
        assert np.frombuffer(known.words[w.encode()], "<u4").tolist() == encoder.encode(w, add_special_tokens=False).ids, w
    text = " ".join(words)
    assert b"".join(known.words[w.encode()] for w in words) == np.array(encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_chunks_have_the_same_ids_and_few_are_looked_up():
    assert pieces.chunks(b"Word, word. (WORD)\x0bword-word") == [b"word", b",", b"word", b".", b"(", b"word", b")", b"word", b"-", b"word"]
    assert pieces.chunks(b"a,B'c d<|x") == [b"a", b",", b"B'c", b"d<|x"]
    rng = np.random.default_rng(4)
    alphabet = ["a", "B", "H", "s", "'", "'S", ",", "-", "!!", "1", "22", " ", " ", "\n", "<", "<|endoftext|>", "|>", "É", "ß", "\u0331", "\u0301", "İ", "ж", "Σ"]
    alphabet += ["\u00a0", "\u0085", "\x00", "\x1c", "\x7f", "’", "ｆ", "_", "²"]
    encoder = Tokenizer.from_file(FILE)
    known = pieces.Vocabulary(encoder)
    for _ in range(3000):
        some = alphabet if rng.random() < 0.5 else alphabet[: rng.integers(8, 22)]
        text = "".join(rng.choice(some, rng.integers(0, 14)))
        found = pieces.chunks(text.encode())
        known.learn(set(found))
        assert b"".join(known.words[c] for c in found) == np.array(encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_empty_table_and_hot_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 7)
    docs = spark.createDataFrame([(k % 50, "same words") for k in range(300)], "doc_id long, text string")
    got = packing.packed(docs, FILE).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 300
    assert {r.sequence_id for r in got} == {0}
    assert packing.packed(docs.limit(0), FILE).count() == 0
