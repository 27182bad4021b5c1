"""The grammar on hand-made clauses, and held-out accuracy of what is learned."""

from __future__ import annotations

import pickle

import pytest
from pyspark.sql import functions as F

from paddock.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("text", "pattern"),
    [
        ("What an idiot.", "I"),
        ("You are an idiot.", "D"),
        ("You are not an idiot.", "i"),
        ("A friend said idiot.", "r"),
        ("They will kill the moron", "X"),
        ("I never wanted it, you idiot", "D"),
        ("we will hurt you", "X"),
        ("kill you", "X"),
        ("kill time", "T"),
        ("he wrote that we kill", "q"),
        ("it isn't stupid", "i"),
    ],
)
def test_clauses(text, pattern):
    counts = dict(zip(toxicity.PATTERNS, toxicity.Model().clauses(text), strict=False))
    assert counts[pattern] >= 1, counts


def test_clause_end_resets_and_stems_match():
    model = pickle.loads(pickle.dumps(toxicity.Model(frozenset(["blor*", "zap"]))))
    assert model.clauses("You went. idiot")[list(toxicity.PATTERNS).index("I")] == 1
    assert sum(model.clauses("blorka! zap; zapper, Blor blo")[:-1]) == 2
    assert sum(model.clauses("blor blors")[:-1]) == 1
    assert sum(model.clauses("")) == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    rows = toxicity.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted != r.toxic for r in rows) / len(rows) < 0.015  # some labels are of texts turned to junk
    assert sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows) < 0.005


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "You idiot"), (3, "x " * 200_000)], "doc_id long, text string"
    ).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.scores(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == 5
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    assert toxicity.scores(docs.limit(0), toxicity.learn(docs, labels.limit(0))).count() == 0
    assert toxicity.without_toxic(docs, toxicity.Model()).columns == docs.columns
