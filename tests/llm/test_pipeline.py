"""The pipeline's stages on a small hostile table, each against plain Python, and the whole on test data."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from paddock.llm import queries

FOLDER = "/root/testdata/sf0.001"
CLASHES = ("fingerprint", "component_id", "text_id", "n_bytes", "size", "item", "hash", "score", "row", "root", "copies")


def words(n: int) -> str:
    return " ".join(random.choice("abcdefgh") + random.choice("aeiou") * random.randint(1, 4) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark beside the documents, with nulls and repeated rows."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    labels = [(k, 1, int(k % 10 == 0)) for k in range(400)] + [(None, 1, 1), (7, None, None), (10, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    random.seed(12)
    items = [(k, words(12)) for k in range(5)] + [(None, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    random.seed(13)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    passage = words(150)
    rows = []
    for k in range(400):
        text = words(random.randint(60, 120))
        if k % 10 == 0:
            text = ". ".join(f"{words(6)} you {random.choice(['vile', 'grot'])} {words(5)}" for _ in range(4))
        if k % 17 == 1:
            text = f"{text} {passage} {words(20)}"
        if k % 23 == 2:
            text = f"{text} {random.choice(items)} {words(9)}"
        rows.append((k, text, "en", "src", len(text)))
    rows += [rows[3], rows[3], (1001, rows[5][1], None, None, None), (None, rows[6][1], "en", "src", 5)]
    rows += [(None, None, None, None, None), (1002, "", "en", "src", 0), (1003, " \n", "en", None, 2), (1004, "long " * 40_000, "en", "src", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHES):
        table = table.withColumn(name, F.concat(F.lit("own"), F.lit(k), F.coalesce("text", F.lit(""))))
    return table.repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def own_columns(rows):
    """The clashing columns still hold what they held."""
    assert all(r[name] == f"own{k}" + r.original for r in rows for k, name in enumerate(CLASHES))


def texts(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_toxic_documents_go(spark, docs, folder):
    kept = stage("toxicity")(spark, docs, folder)
    assert kept.columns == docs.columns
    want = [(r.doc_id, r.text) for r in docs.collect() if not re.search("vile|grot", r.text or "")]
    assert texts(kept) == sorted(want, key=str)


def test_one_of_each_group_stays(spark, docs, folder):
    kept = stage("SimHash near-dedup")(spark, docs, folder)
    rows = docs.collect()
    marks = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(marks, 2)
    groups: dict[int, list] = {}
    for r, mark in zip(rows, marks, strict=True):
        groups.setdefault(roots[mark], []).append(r.doc_id)
    least = [min((k for k in g if k is not None), default=None) for g in groups.values()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least, key=str)
    assert kept.columns == docs.columns


def test_repeated_strings_go(spark, docs, folder):
    kept = stage("suffix-array dedup")(spark, docs.withColumn("original", F.coalesce("text", F.lit(""))), folder)
    rows = kept.collect()
    own_columns(rows)
    assert len(rows) == docs.count()
    data = [r.original for r in rows]
    seen: dict[str, int] = {}
    size = corpus_pipeline.PASSAGE_BYTES
    for text in data:
        for i in range(len(text) - size + 1):
            seen[text[i : i + size]] = seen.get(text[i : i + size], 0) + 1
    for r in rows:
        gone = [False] * len(r.original)
        for i in range(len(r.original) - size + 1):
            if seen[r.original[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        assert r.text == "".join(c for c, g in zip(r.original, gone, strict=True) if not g)
        assert r.n_chars == len(r.text)


def test_passages_of_fifty_words_go(spark):
    """Fifty-one words of a document, put into other documents, are gone from all of them, and nothing else is."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    long = [r.text for r in rows if len(r.text.split()) > 400][:12]
    passages = [" ".join(text.split()[100:151]) for text in long]
    hosts = [(k, f"word{k} " + " ".join(f"own{k}x{i}" for i in range(60))) for k in range(24)]
    docs = spark.createDataFrame(
        [(k, f"{text}\n{passages[k % 12]}\n{text[::-1]}") for k, text in hosts], "doc_id long, text string"
    )
    kept = stage("suffix-array dedup")(spark, docs, FOLDER).collect()
    assert min(len(p.encode()) for p in passages) >= corpus_pipeline.PASSAGE_BYTES
    for r in kept:
        assert passages[r.doc_id % 12][20:-20] not in r.text
        assert hosts[r.doc_id][1][:-10] in r.text and hosts[r.doc_id][1][::-1][10:] in r.text


def test_contaminated_documents_go(spark, docs, folder):
    kept = stage("benchmark decontamination")(spark, docs, folder)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    want = [(r.doc_id, r.text) for r in docs.collect() if not any(i in (r.text or "") for i in items)]
    assert texts(kept) == sorted(want, key=str)
    assert kept.columns == docs.columns


def test_stages_of_an_empty_table(spark, docs, folder):
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), folder).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= ids
    assert len({r.doc_id for r in rows}) > len(ids) / 2
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing",
    ]


def test_a_query_for_each_operator():
    assert [int(name[2 : name.index("_")]) for name in queries.QUERIES] == list(range(1, 14))
