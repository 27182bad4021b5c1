"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text is read twice: as its words, and as the forms of its words. A form says which kinds of characters follow each other
in a word (letters of either case, digits, and each sign itself; non-ASCII letters only where there is nothing else), whether the
word equals the one before it, and whether the three words ending there have stood in the text before. Either reading
begins and ends with a mark, so an empty text has n-grams too. N-grams of one and two words are hashed to a fixed number of
weights; a reading's counts are scaled to length one, and the score is the logistic function of the sparse dot product.

Training texts become sparse vectors in parallel. One task then takes them in the order of a hash, once for each pass, and updates
a weight's sums per text (FTRL-Proximal): its memory is the fixed number of weights, whatever the number of rows. The
rows it reads are bounded by ``SAMPLE_ROWS``. Every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm import shared

#: Weights; n-grams share them by hash. A power of two.
BUCKETS = 1 << 18
#: Labelled rows from which the weights are learned, and passes over them.
SAMPLE_ROWS = 20_000
PASSES = 4
#: FTRL-Proximal: learning rate, its offset, and the strengths that draw weights to 0.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 2 << 20

_KINDS = bytes.maketrans(
    bytes(range(256)),
    bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else c for c in range(256)),
)
_NON_ASCII = bytes(range(128, 256))
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BEGIN, _END, _SAME, _SEEN = (np.uint64(xxhash.xxh64_intdigest(b"\n" + name)) for name in (b"begin", b"end", b"same", b"seen"))


def form(word: bytes) -> bytes:
    """Kinds of characters in their order, none twice in a row."""
    return _AGAIN.sub(rb"\1", word.translate(_KINDS, _NON_ASCII)) or b"~"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MIX + b
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def vectors(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the sparse vectors of some texts, by text, then bucket."""
    split = [bytes(t).split() for t in texts]  # at the six ASCII characters of white space
    sizes = np.array([len(w) + 2 for w in split], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(split)), sizes)
    inner = np.ones(owner.size, bool)
    inner[ends - 1] = inner[ends - sizes] = False
    spelled = np.empty(int(inner.sum()), object)
    spelled[:] = [w for words in split for w in words]
    code, known = pd.factorize(spelled)
    words, forms = np.empty((2, owner.size), np.uint64)
    for out, name in ((words, bytes.lower), (forms, form)):
        out[ends - sizes], out[ends - 1] = _BEGIN, _END
        hashes = np.array([xxhash.xxh64_intdigest(name(w)) for w in known], np.uint64)
        out[inner] = hashes[code] if code.size else 0
    # what repeats in the text is part of the form
    same = np.flatnonzero((words[1:] == words[:-1]) & inner[1:] & inner[:-1]) + 1
    forms[same] ^= _SAME
    windows = np.flatnonzero(inner[2:] & inner[1:-1] & inner[:-2]) + 2
    triple = _mixed(_mixed(words[windows - 2], words[windows - 1]), words[windows]) ^ _mixed(owner[windows].astype(np.uint64), _MIX)
    first = np.ones(windows.size, bool)
    order = np.argsort(triple, kind="stable")
    first[order[1:]] = np.diff(triple[order]) != 0
    forms[windows[~first]] ^= _SEEN

    joint = owner[1:] == owner[:-1]
    parts = []
    for salt, reading in ((np.uint64(1), words), (np.uint64(2), forms)):
        grams = np.concatenate((_mixed(reading, salt), _mixed(_mixed(reading[:-1], salt), reading[1:])[joint]))
        text = np.concatenate((owner, owner[1:][joint]))
        place, count = np.unique(text * np.int64(BUCKETS) + (grams % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        text, bucket = np.divmod(place, BUCKETS)
        norm = np.sqrt(np.bincount(text, count.astype(float) ** 2, len(split)))
        parts.append((text, bucket, count / norm[text]))
    text, bucket, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], bucket[order], value[order]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Learner:
    """FTRL-Proximal: per weight a sum of gradients and one of their squares; weights follow from them. The last is the constant."""

    def __init__(self) -> None:
        self.gradients = np.zeros(BUCKETS + 1)
        self.squares = np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, constant = self.gradients[at], at == BUCKETS
        beyond = np.where(constant, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))
        return -beyond / ((BETA + np.sqrt(self.squares[at])) / ALPHA + np.where(constant, 0, L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, BUCKETS), np.append(value, 1.0)
        at, value = np.unique(at), np.bincount(np.unique(at, return_inverse=True)[1], value)  # both readings may share a bucket
        w = self.weights(at)
        gradient = (_logistic(w @ value) - label) * value
        before = self.squares[at]
        after = before + gradient**2
        self.gradients[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        self.squares[at] = after


@dataclass
class Model:
    """``BUCKETS`` weights and a constant."""

    weights: np.ndarray
    constant: float

    def scores(self, texts: list[memoryview]) -> np.ndarray:
        text, bucket, value = vectors(texts)
        return _logistic(np.bincount(text, self.weights[bucket] * value, len(texts)) + self.constant)


def is_held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _blocks(texts: list[memoryview]) -> Iterator[tuple[int, int]]:
    """Ends of blocks of some megabytes."""
    ends = np.cumsum([len(t) for t in texts])
    begin = 0
    while begin < len(texts):
        reach = (ends[begin - 1] if begin else 0) + BLOCK_BYTES
        end = max(begin + 1, int(np.searchsorted(ends, reach, "right")))
        yield begin, end
        begin = end


def _vector_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [*shared.slices(batch.column("text"))]
        for begin, end in _blocks(texts):
            text, bucket, value = vectors(texts[begin:end])
            cut = np.searchsorted(text, np.arange(end - begin + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place").slice(begin, end - begin),
                    batch.column("label").slice(begin, end - begin),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32))),
                ],
                ["place", "label", "bucket", "value"],
            )
    shared.release_memory()


def _learn_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Learner()
    for batch in batches:
        buckets, values = batch.column("bucket"), batch.column("value")
        for k, label in enumerate(batch.column("label").to_pylist()):
            learner.learn(buckets[k].values.to_numpy().astype(np.int64), values[k].values.to_numpy().astype(float), label)
    weights = learner.weights(np.arange(BUCKETS + 1))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], ["weights"])


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model to at most ``sample_rows`` labelled rows for which ``held_out`` doesn't hold, those with the least hash of their id.

    Rows without a label or an id aren't used; of several labels of an id the highest counts, of several texts the greatest. Null
    texts are empty. Without labelled rows every text scores 0.5.
    """
    held_out = is_held_out(F.col("doc_id")) if held_out is None else held_out
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(~held_out).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample_rows)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(known, "doc_id").groupBy("doc_id", "place", "label").agg(F.max("text").alias("text"))
    rows = rows.select("place", F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    sparse = rows.mapInArrow(_vector_task, "place long, label int, bucket array<int>, value array<float>")
    sparse = shared.written(sparse, "vectors")
    passes = sparse.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))
    passes = passes.repartition(1).sortWithinPartitions("pass", F.xxhash64("place", "pass"), "place", "bucket")
    found = passes.select("label", "bucket", "value").mapInArrow(_learn_task, "weights binary").collect()  # of fixed size
    weights = np.frombuffer(found[0].weights, "<f8") if found else np.zeros(BUCKETS + 1)
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; other columns aren't read.

    Null and empty texts get the score of a text without words; null ids count as an empty text for ``held_out``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [*shared.slices(batch.column("text"))]
            found = [model.scores(texts[a:b]) for a, b in _blocks(texts)]
            score = np.concatenate([np.empty(0), *found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )
        shared.release_memory()

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, score double, predicted int")
