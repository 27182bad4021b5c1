"""The recursions against enumeration, base scores against plain counting, and held-out gain."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import hmm, lm_scoring

FOLDER = "/root/testdata/sf0.01"


def model(states: int = 3, tokens: int = 4):
    rng = np.random.default_rng(5)
    chain = hmm.Chain(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states))
    return chain, rng.dirichlet(np.ones(tokens), states).T


def test_recursions_against_all_paths():
    chain, emission = model()
    sequences = [np.array(s) for s in ([0], [1, 2, 3, 0], [3, 3], [2, 0, 1])]
    data = hmm.layout(sequences)
    got = hmm.log_likelihoods(chain, emission, data)
    counts, first, steps = hmm.expected_counts(chain, emission, data)
    want_counts, want_first, want_steps = np.zeros_like(emission), np.zeros(3), np.zeros((3, 3))
    for s, value in zip(sequences, got, strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = chain.initial[path[0]] * emission[s[0], path[0]]
            for t in range(1, len(s)):
                p *= chain.transition[path[t - 1], path[t]] * emission[s[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(value, math.log(total))
        for path, p in paths.items():
            want_first[path[0]] += p / total
            for t, q in enumerate(path):
                want_counts[s[t], q] += p / total
                if t:
                    want_steps[path[t - 1], q] += p / total
    assert np.allclose(counts, want_counts) and np.allclose(first, want_first) and np.allclose(steps, want_steps)


def test_scaling_at_some_steps_gives_what_scaling_at_all_gives(monkeypatch):
    rng = np.random.default_rng(6)
    chain, emission = model(tokens=50)
    emission = emission * 10.0 ** rng.integers(-13, 0, (50, 1))  # as rare as a word of a large corpus
    data = hmm.layout([rng.integers(0, 50, n) for n in (1, 7, 8, 9, 16, 17, 40, 700, 8, 1)])
    assert hmm.SCALED > 1
    found = hmm.expectations(chain, emission, data)
    logs = hmm.log_likelihoods(chain, emission, data)
    monkeypatch.setattr(hmm, "SCALED", 1)
    for got, want in zip(found, hmm.expectations(chain, emission, data), strict=True):
        assert np.allclose(got, want, rtol=1e-9)
    assert np.allclose(logs, hmm.log_likelihoods(chain, emission, data), rtol=1e-12)
    assert np.isclose(logs.sum(), found[3]) and np.isclose(found[0].sum(), data.tokens.size)


def plain(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    seen = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    return [
        (k, held(k), len(words(t)), sum(seen[w] > 0 for w in words(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t)), 6))
        for k, t in rows
    ]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 300_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(None, None), (None, "The the\x0bthe"), (7, ""), (7, ""), (8, "x " * 30_000), (9, "É é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    got = lm_scoring.scores(docs).collect()
    shown = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(shown, key=str) == sorted(plain(rows), key=str)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    words, totals = lm_scoring.train(docs)
    table = words.toPandas()
    known = lm_scoring.emission(table.n.to_numpy(), table.shares.to_numpy(), totals).sum(axis=0)
    unknown = lm_scoring.emission(np.zeros(1, np.int64), np.zeros(1, np.int64), totals)[0]
    assert np.allclose(known + unknown, 1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_scoring.scores(docs.limit(0)).count() == 0
    held = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm_scoring.scores(docs.withColumn("doc_id", F.lit(held))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_equal_tasks(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c") for k in range(40)], "doc_id long, text string").coalesce(1)
    words, totals = lm_scoring.train(docs)
    for twice in (docs.union(docs), docs.union(docs).repartition(2)):
        got = sorted(map(tuple, lm_scoring.score(twice, words, totals).collect()))
        assert got == sorted(2 * [*map(tuple, lm_scoring.score(docs, words, totals).collect())])


def test_settled_over_all_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    fitted, found = lm_scoring.fit(docs), []
    answers, totals = fitted.answers, fitted.totals
    for _ in range(3):  # further iterations with the words' own probabilities
        counted = lm_scoring._next_counts(fitted.blocks, answers, totals, 1)
        answers = lm_scoring._exchanged(counted, lm_scoring.STATES, 1)
        totals, now = lm_scoring._totals(answers, lm_scoring.STATES)
        found.append(now)
    assert max(found) - found[0] < 1e-3 * abs(found[0])


def test_each_iteration_against_one_dense_model(spark, monkeypatch):
    """Classes, first words, next words: each from the model before it, with all texts in one matrix, no blocks and no groups."""
    rows = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(200).collect()] + [None, "", "a A a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    texts = [(t or "").encode().lower().split() + [b"\n"] for t in rows]
    names = sorted({w for t in texts for w in t})
    number = {w: k for k, w in enumerate(names)}
    data = hmm.layout([np.array([number[w] for w in t]) for t in texts])
    n = np.bincount(data.tokens, minlength=len(names))
    classes = np.array([zlib.crc32(w) % lm_scoring.CLASSES for w in names])

    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm_scoring, "GROUP_WORDS", 1_000)
    states, start = lm_scoring.STATES, lm_scoring._start(lm_scoring.STATES)
    blocks = lm_scoring.shared.written(lm_scoring._texts(docs).mapInArrow(lm_scoring._numbered_rows(20_000), lm_scoring._NUMBERED_KINDS), "blocks")
    groups = lm_scoring._groups(blocks)
    assert groups > 5 and blocks.count() > 5

    seed = lm_scoring._train_classes(blocks, states, 1.0)  # one iteration
    counts, first, steps, _ = hmm.expectations(start.chain, start.classes[classes], data)
    by_class = np.stack([np.bincount(classes, c, lm_scoring.CLASSES) for c in counts.T])
    assert np.allclose(seed.classes, hmm.normalised(by_class, 0.1).T, rtol=0.02)
    assert np.allclose(seed.chain.transition, hmm.normalised(steps), rtol=0.01)

    answers = begun = lm_scoring._exchanged(lm_scoring._first_counts(blocks, seed, groups), states, groups)
    chain, emission = seed.chain, seed.classes[classes]
    for _ in range(3):
        totals, likelihood = lm_scoring._totals(answers, states)
        counts, first, steps, want = hmm.expectations(chain, emission, data)
        assert np.isclose(likelihood, want)
        assert np.allclose(totals.chain.initial, hmm.normalised(first), atol=0.01) and np.allclose(totals.chain.transition, hmm.normalised(steps), rtol=0.01)
        fitted = lm_scoring.Fitted(blocks, answers, begun.where(F.col("block") == lm_scoring._LIST).select("part", "words"), totals)
        got = {bytes(r.key): (r.n, r.shares) for r in lm_scoring._word_rows(fitted).collect()}
        assert {w: c for w, (c, _) in got.items()} == dict(zip(names, n.tolist(), strict=True))
        shares = np.array([got[w][1] for w in names])
        share = shares[:, None] >> 8 * np.arange(states) & 255
        assert np.abs(share - counts * 255 / counts.sum(axis=1, keepdims=True)).max() < 1.5
        of_state = n[:, None] * share / share.sum(axis=1, keepdims=True)
        assert (totals.tokens, totals.words) == (n.sum(), len(names))
        assert np.allclose(totals.by_state, of_state.sum(axis=0)) and np.allclose(totals.once_by_state, of_state[n == 1].sum(axis=0))
        chain, emission = totals.chain, lm_scoring.emission(n, shares, totals)
        answers = lm_scoring._exchanged(lm_scoring._next_counts(blocks, answers, totals, groups), states, groups)


def test_training_texts_score_the_same_by_either_way(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(lm_scoring, "GROUP_WORDS", 5_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200).repartition(2)
    fitted = lm_scoring.fit(docs, settled=1e-2)
    got = lm_scoring._score_trained(fitted).collect()
    want = lm_scoring.score(docs, lm_scoring._word_rows(fitted), fitted.totals).collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)))


def test_only_the_last_answers_are_kept(spark):
    docs = spark.createDataFrame([(k, f"a b c {k % 7} b a") for k in range(40)], "doc_id long, text string")
    folder = Path(lm_scoring.shared.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("answers-*"))
    fitted = lm_scoring.fit(docs)
    assert len(set(folder.glob("answers-*")) - before) == 1
    assert lm_scoring._word_rows(fitted).count() == 3 + 7 + 1
