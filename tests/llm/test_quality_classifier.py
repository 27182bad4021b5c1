"""Held-out accuracy, sparse vectors against plain counts, updates against the formula, odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import quality_classifier as classifier

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.scores(docs, classifier.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 100
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert sum(r.predicted for r in bad) / len(bad) < 0.05
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_forms():
    forms = {"Of%%%": b"Aa%", "DIE!!": b"A!", "|": b"|", "x1": b"a0", "Été": b"a", "é": b"~"}
    assert {w: classifier.form(w.encode()) for w in forms} == forms


def test_vectors_have_length_one_per_reading_and_do_not_depend_on_neighbours():
    random.seed(1)
    texts = ["", " \n", "one", "the the The", *(" ".join(random.choices(["a", "B!", "c", "10"], k=random.randint(1, 60))) for _ in range(30))]
    views = [memoryview(t.encode()) for t in texts]
    text, bucket, value = classifier.vectors(views)
    for k, view in enumerate(views):
        own = classifier.vectors([view])
        assert sorted(zip(bucket[text == k], value[text == k], strict=True)) == sorted(zip(own[1], own[2], strict=True))
        assert math.isclose((value[text == k] ** 2).sum(), 2)
    assert len(set(bucket[text == 0])) > 0  # the marks of an empty text


def test_words_are_counted_as_bigrams_and_unigrams():
    words = "a b a b c".split()
    counts = Counter([("<",), (">",), *((w,) for w in words)])
    counts += Counter(zip(["<", *words], [*words, ">"], strict=True))
    norm = math.sqrt(sum(v * v for v in counts.values()))
    value = classifier.vectors([memoryview(" ".join(words).encode())])[2]
    ours = sorted(v / norm for v in counts.values())
    left = sorted(value.tolist())
    for v in ours:  # the reading as words; what is left is the reading as forms
        at = min(range(len(left)), key=lambda k: abs(left[k] - v))
        assert math.isclose(left.pop(at), v)


def test_updates_follow_the_formula():
    random.seed(2)
    learner = classifier.Learner()
    z, n = Counter(), Counter()

    def weight(i: int) -> float:
        free = i == classifier.BUCKETS
        l1, l2 = (0, 0) if free else (classifier.L1, classifier.L2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + l2)

    for _ in range(200):
        x = {random.randrange(6): random.random() for _ in range(4)}
        label = int(x.get(0, 0) > 0.4)
        learner.learn(np.array([*x]), np.array([*x.values()]), label)
        x[classifier.BUCKETS] = 1.0
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA * w[i]
            n[i] += g * g
    at = np.array([*range(6), classifier.BUCKETS])
    assert np.allclose(learner.weights(at), [weight(i) for i in at.tolist()])


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "Some words."), (3, "x " * 300_000), (4, "\x0b")], "doc_id long, text string"
    ).withColumn("score", F.lit("clash")).withColumn("place", F.lit(9)).withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    labels = labels.withColumn("text", F.lit("clash"))
    rows = classifier.scores(docs, classifier.learn(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1
    none = classifier.learn(docs, labels.limit(0))
    assert [r.score for r in classifier.scores(docs, none).collect()] == [0.5] * 6
    assert classifier.scores(docs.limit(0), none).count() == 0
    assert classifier.learn(docs, labels, sample_rows=1).constant != 0
