"""Substring removal and the suffix arrays under it against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F
import pytest

from paddock.llm import suffix_array
from paddock.llm.substring_dedup import without_repeats


def brute_force(texts: list[str | None], length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus() -> list[str | None]:
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeéß") for _ in range(random.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(90) for _ in range(4)]
    texts: list[str | None] = [None, "", "", "short", "short", "a" * 3000, "xy" * 700]
    for k in range(90):
        text = prose(random.randint(20, 160))
        if k % 3 == 0:
            at = random.randrange(len(text))
            text = text[:at] + random.choice(passages) + text[at:]
        if k % 7 == 0:
            text += passages[0][: random.randint(200, 480)]
        texts.append(text)
    texts += [texts[12], texts[12], texts[20]]
    near = texts[30] or ""
    texts += [near[:j] + "#" + near[j + 1 :] for j in range(0, len(near), 35)]
    return texts


@pytest.mark.parametrize("hot_regions", [4096, 2])
def test_against_brute_force(spark, hot_regions):
    texts = corpus()
    ids = [None if k % 11 == 5 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(range(len(texts)), ids, texts, strict=True)), "row int, doc_id long, text string")
    docs = docs.withColumn("n_bytes", F.lit("clash")).withColumn("text_id", F.lit(1)).withColumn("copies", F.lit(0))
    rows = without_repeats(docs, 400, hot_regions=hot_regions).collect()
    got = {r.row: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == dict(enumerate(brute_force(texts, 400)))
    assert {r.row: r.doc_id for r in rows} == dict(enumerate(ids))


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é" * 300), (2, "b" + "é" * 300), (3, "alone")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in without_repeats(docs, 400, with_text=True).collect()}
    assert kept == {1: "", 2: "b", 3: "alone"}
    assert without_repeats(docs.limit(0), 400).count() == 0


def test_texts_are_shuffled_once_for_regions_and_results(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    rows = without_repeats(docs, 400)
    rows.collect()
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_suffix_order_of_small_alphabets():
    random.seed(8)
    for _ in range(60):
        groups = [
            [bytes(random.choice(b"ab\0") for _ in range(random.choice([0, 1, 4, 20]))) for _ in range(random.randint(1, 3))]
            for _ in range(3)
        ]
        texts = suffix_array.Instances(groups)
        want, base = [], 0
        for group in groups:
            suffixes = []
            for k, region in enumerate(group):
                suffixes += [([b + 1 for b in region[i:]] + [k - len(group)], base + i) for i in range(len(region) + 1)]
                base += len(region) + 1
            want += [at for _, at in sorted(suffixes)]
        assert suffix_array.suffix_order(texts).tolist() == want
