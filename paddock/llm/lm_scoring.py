"""Log probabilities of texts under a hidden Markov model whose counts are gathered from a whole corpus.

States emit words. Training runs over all training texts in every iteration, from a random model, in two stages:

The texts are read once: blocks of them are kept as packed numbers of their distinct words, and every iteration reads numbers.

1. Baum-Welch with words hashed to CLASSES classes, until the likelihood settles: each task runs the forward-backward
   recursion over its blocks, and expected counts are summed across partitions. The model stays small.
2. Baum-Welch with the words themselves, until the likelihood settles. A block's words are dealt to groups by their hash. A
   block sends each group its words' expected counts, and the group answers with the words' sums; which word is meant is
   settled once, by the first answer. That table grows with the corpus and stays distributed; the driver gets totals only.

A word's probability in a state is its share of the state's counts. A state keeps the share of words seen once for the
unknown word, one more event beside the known ones, and mixes in a little of the words' overall shares.

Texts are scored by the exact forward recursion: the training texts from their blocks, others by a join with the words' counts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm import hmm, postings, shared

STATES = 4
CLASSES = 4096
BLOCK_BYTES = 12_000_000
#: Share of a word's probability that is the same in all states.
MIXED = 0.01
#: Expected counts are summed as whole numbers of this part, so that their order doesn't matter.
PART = 1024
#: The likelihood has settled when its log gains no more than this part.
SETTLED = 1e-4
#: Words of blocks that a group gets, of all blocks together: a bound on a task's memory.
GROUP_WORDS = 500_000

END = b"\n"  # no word has white space


class Seed(NamedTuple):
    chain: hmm.Chain
    classes: np.ndarray  # (class, state): probability of the class in the state


class Totals(NamedTuple):
    """What the driver knows of the trained model."""

    chain: hmm.Chain
    tokens: int
    words: int
    by_state: np.ndarray
    once_by_state: np.ndarray


class Fitted(NamedTuple):
    """Blocks of the training texts, what their words' groups answered to them, the words' texts, and the totals."""

    blocks: DataFrame
    answers: DataFrame
    names: DataFrame
    totals: Totals


class _Numbers(defaultdict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(texts: list[memoryview]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, frequent ones first, the texts as numbers of them, and their lengths; the end is a word.

    Arrow's ASCII kernels split and lower-case as the contract's words say; what they make of other bytes isn't looked at.
    """
    ends = np.cumsum([0, *map(len, texts)])
    column = pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    encoded = pc.dictionary_encode(split.values.cast(pa.large_binary()))
    names, found = list(map(bytes, shared.slices(encoded.dictionary))), shared.numbers(encoded.indices)
    is_word = np.fromiter(map(len, names), np.int64, len(names)) > 0  # white space at either end leaves an empty string
    kept = is_word[found]
    before = np.concatenate(([0], np.cumsum(kept)))
    cuts = shared.numbers(split.offsets)
    lengths = before[cuts[1:]] - before[cuts[:-1]] + 1
    tokens = np.full(int(lengths.sum()), len(names))  # the end
    is_end = np.zeros(tokens.size, bool)
    is_end[np.cumsum(lengths) - 1] = True
    tokens[~is_end] = found[kept]
    by = np.argsort(-np.bincount(tokens, minlength=len(names) + 1), kind="stable")
    number = np.empty(by.size, np.int64)
    number[by] = np.arange(by.size)
    names.append(END)
    return [names[k] for k in by.tolist() if names[k]], number[tokens], lengths


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _start(states: int) -> Seed:
    """A random model, the same for any corpus."""
    chain = hmm.Chain(np.full(states, 1 / states), hmm.normalised(np.eye(states) * 20 * states))
    return Seed(chain, np.random.default_rng(1).dirichlet(np.ones(CLASSES), states).T)


_NUMBERED_KINDS = "block long, n_words long, words binary, hashes binary, tokens binary, ids binary, lengths binary"


def _numbered_rows(most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block: its distinct words, frequent ones first, their hashes, and the texts as packed numbers of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in postings.blocks(batches, most_bytes):
            names, tokens, lengths = _numbered(texts)
            row = {
                "block": block,
                "n_words": len(names),
                "words": b" ".join(names),
                "hashes": np.fromiter(map(zlib.crc32, names), "<u4", len(names)).tobytes(),
                "tokens": _planes(hmm.by_step(tokens, lengths)),
                "ids": postings.pack_ids(ids),
                "lengths": _planes(lengths),
            }
            yield pa.RecordBatch.from_pylist([row])
            del names, tokens, lengths, row
            shared.release_memory()

    return task


def _packed(values: np.ndarray) -> bytes:
    return postings.pack(values, np.zeros(1, np.int64))[0].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return postings.unpack(np.frombuffer(data, np.uint8))[0]


def _planes(values: np.ndarray) -> bytes:
    """Numbers that aren't negative: all lowest bytes, then all next ones, as many planes as the greatest needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + b"".join((values >> (8 * k)).astype(np.uint8).tobytes() for k in range(width))


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, data[0]):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _sequences(row: dict) -> hmm.Layout:
    return hmm.laid_out(_from_planes(row["tokens"]), _from_planes(row["lengths"]))


def _in_parts(*found: np.ndarray) -> np.ndarray:
    return np.rint(np.concatenate([np.ravel(f) for f in found]) * PART).astype(np.int64)


def _chain(sums: np.ndarray, states: int) -> hmm.Chain:
    """Of the counts of first states, then of steps."""
    sums = sums / PART
    return hmm.Chain(hmm.normalised(sums[:states]), hmm.normalised(sums[states : states + states * states].reshape(states, states)))


def _train_classes(blocks: DataFrame, states: int, settled: float) -> Seed:
    seed, before = _start(states), -np.inf
    while True:
        sums = np.zeros(CLASSES * states + states + states * states + 1, np.int64)
        for k, value in _count_classes(blocks, seed).collect():  # as many rows at most
            sums[k] = value
        counts, rest = sums[: CLASSES * states].reshape(CLASSES, states), sums[CLASSES * states :]
        now = rest[-1] / PART
        if now - before <= settled * abs(now):
            return seed
        seed, before = Seed(_chain(rest, states), hmm.normalised(counts.T / PART, 0.1).T), now


def _count_classes(blocks: DataFrame, seed: Seed) -> DataFrame:
    """key, n: expected counts (in PARTs) by class and state, then of first states and steps, then the log likelihood."""

    def of_block(row: dict) -> np.ndarray:
        data = _sequences(row)
        classes = (np.frombuffer(row["hashes"], "<u4") % CLASSES).astype(np.int64)
        return _in_parts(*hmm.expectations(seed.chain, seed.classes, data._replace(tokens=classes[data.tokens])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | int = 0
        for batch in batches:
            for k in range(batch.num_rows):
                sums = sums + of_block(batch.slice(k, 1).to_pylist()[0])
        if isinstance(sums, np.ndarray):
            keys = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["key", "n"])
        shared.release_memory()

    found = blocks.select("hashes", "tokens", "lengths").mapInArrow(task, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


_COUNTED_KINDS = "part long, block long, words binary, places binary, n binary, counts binary, sums binary"


def _counted(row: dict, places: np.ndarray | None, n: np.ndarray, found: tuple, groups: int) -> pa.RecordBatch:
    """What a block sends to the groups of its words, and to one group its sums."""
    counts, *rest = found
    counts, (by, cuts) = _in_parts(counts).reshape(counts.shape), _dealt(row, groups)
    names = row["words"].split(b" ") if places is None else []
    out = []
    for g in range(groups):
        at = by[cuts[g] : cuts[g + 1]]
        if at.size:
            out.append({
                "part": g,
                "block": row["block"],
                "words": b" ".join([names[k] for k in at.tolist()]) if places is None else None,
                "places": None if places is None else _planes(places[at]),
                "n": _packed(n[at]),
                "counts": _packed(counts[at].ravel()),
                "sums": None,
            })
    own = dict.fromkeys(("words", "places", "n", "counts"))
    # the likelihood is negative, and sums aren't packed
    out.append({"part": zlib.crc32(b"%d" % row["block"]) % groups, "block": row["block"], **own, "sums": _in_parts(*rest).tobytes()})
    return pa.RecordBatch.from_pylist(out, _schema(_COUNTED_KINDS))


def _dealt(row: dict, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words by group, and where each group begins and ends."""
    group = (np.frombuffer(row["hashes"], "<u4") // CLASSES % groups).astype(np.int64)
    return np.argsort(group, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))


def _schema(kinds: str) -> pa.Schema:
    of = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, of[kind]) for name, kind in (k.split() for k in kinds.split(", "))])


_ANSWER_KINDS = "block long, part long, words binary, places binary, n binary, shares binary, sums binary"
#: In place of a block: a group's words in their order, and a group's sums.
_LIST, _SUMS = -1, -2


def _answers(states: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a group's counts by word, and answers each block with its words' places, counts and shares."""

    def answered(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names, sums = _Numbers(), np.zeros(states + states * states + 1, np.int64)
        sent = []
        for row in rows:
            if row["sums"] is not None:
                sums += np.frombuffer(row["sums"], np.int64)
            elif row["words"] is not None:
                words = row["words"].split(b" ")
                sent.append((row, np.fromiter(map(names.__getitem__, words), np.int64, len(words))))
            else:
                sent.append((row, _from_planes(row["places"])))
        size = max((int(places.max()) + 1 for _, places in sent), default=0)
        n, counts = np.zeros(size, np.int64), np.zeros((size, states), np.int64)
        for row, places in sent:  # a block's places are distinct
            if row["words"] is not None:
                n[places] += _unpacked(row["n"])
            else:
                n[places] = _unpacked(row["n"])
            counts[places] += _unpacked(row["counts"]).reshape(-1, states)
        total = counts.sum(axis=1, keepdims=True)
        share = np.where(total > 0, np.rint(counts * 255 / np.maximum(total, 1)), 1).astype(np.int64)
        shares = (share << (8 * np.arange(states))).sum(axis=1)
        of_state = n[:, None] * share / share.sum(axis=1, keepdims=True)
        found = [float(n.sum()), float(size), *of_state.sum(axis=0), *of_state[n == 1].sum(axis=0), *sums.astype(float)]

        def answer(block: int, words: bytes | None, places: np.ndarray | None, of: np.ndarray | slice) -> dict:
            where = None if places is None else _planes(places)
            own = {"words": words, "places": where, "n": _packed(n[of]), "shares": _planes(shares[of])}
            return {"block": block, "part": part, **own, "sums": None}

        for row, places in sent:
            yield pa.RecordBatch.from_pylist([answer(row["block"], None, places, places)], _schema(_ANSWER_KINDS))
        own = answer(_LIST, b" ".join(names) if names else None, None, slice(None))
        nothing = dict.fromkeys(("words", "places", "n", "shares"))
        out = [own, {"block": _SUMS, "part": part, **nothing, "sums": np.array(found).tobytes()}]
        yield pa.RecordBatch.from_pylist(out, _schema(_ANSWER_KINDS))

    return _by_key("part", answered)


def _by_key(key: str, finished: Callable[[int, list[dict]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``finished`` with the rows of each key; they come one after the other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row[key] != now:
                    if rows:
                        yield from finished(now, rows)
                    now, rows = row[key], []
                rows.append(row)
        if rows:
            yield from finished(now, rows)
        shared.release_memory()

    return task


def _exchanged(counted: DataFrame, states: int, groups: int) -> DataFrame:
    dealt = counted.repartition("part").sortWithinPartitions("part", "block")
    return shared.written(dealt.mapInArrow(_answers(states, groups), _ANSWER_KINDS), "answers")


def _totals(answers: DataFrame, states: int) -> tuple[Totals, float]:
    """Sums of all groups: the model's totals, and the log likelihood of the model before."""
    rows = answers.where(F.col("block") == _SUMS).select("part", "sums").collect()  # a row for each group
    width = 2 + 2 * states
    found = sum((np.frombuffer(r.sums) for r in sorted(rows)), np.zeros(width + states + states * states + 1))
    by_state, once = found[2 : 2 + states], found[2 + states : width]
    return Totals(_chain(found[width:], states), int(found[0]), int(found[1]), by_state, once), found[-1] / PART


def _first_counts(blocks: DataFrame, seed: Seed, groups: int) -> DataFrame:
    """Expected counts of the words under the model of classes."""

    def of_block(row: dict) -> pa.RecordBatch:
        data = _sequences(row)
        classes = (np.frombuffer(row["hashes"], "<u4") % CLASSES).astype(np.int64)
        n = np.bincount(data.tokens, minlength=classes.size)
        return _counted(row, None, n, hmm.expectations(seed.chain, seed.classes[classes], data), groups)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield of_block(batch.slice(k, 1).to_pylist()[0])
        shared.release_memory()

    return blocks.select("block", "words", "hashes", "tokens", "lengths").mapInArrow(task, _COUNTED_KINDS)


def _of_answers(blocks: DataFrame, answers: DataFrame, groups: int, finished: Callable[..., pa.RecordBatch], kinds: str) -> DataFrame:
    """``finished`` of each block's row, its texts, and its words' places, counts and shares."""

    def of_block(block: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        row = rows[0]
        by, cuts = _dealt(row, groups)
        places, n, shares = (np.zeros(by.size, np.int64) for _ in range(3))
        for answer in rows[1:]:
            at = by[cuts[answer["part"]] : cuts[answer["part"] + 1]]
            places[at] = _from_planes(answer["places"])
            n[at], shares[at] = _unpacked(answer["n"]), _from_planes(answer["shares"])
        yield finished(row, _sequences(row), places, n, shares)

    own = blocks.select("block", F.lit(-1).cast("long").alias("part"), "hashes", "tokens", "ids", "lengths")
    sent = answers.where(F.col("block") >= 0).select("block", "part", "places", "n", "shares")
    both = own.unionByName(sent, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_by_key("block", of_block), kinds)


def _next_counts(blocks: DataFrame, answers: DataFrame, totals: Totals, groups: int) -> DataFrame:
    """Expected counts of the words under their own probabilities."""

    def finished(row: dict, data: hmm.Layout, places: np.ndarray, n: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
        return _counted(row, places, n, hmm.expectations(totals.chain, emission(n, shares, totals), data), groups)

    return _of_answers(blocks, answers, groups, finished, _COUNTED_KINDS)


def _groups(blocks: DataFrame) -> int:
    words = blocks.agg(F.sum("n_words").alias("n")).first().n or 0
    return words // GROUP_WORDS + 1


def fit(docs: DataFrame, states: int = STATES, settled: float = SETTLED) -> Fitted:
    """The model of the texts of ``docs``: a null text is empty, repeated rows count as often as they come."""
    blocks = shared.written(postings.steady(_texts(docs)).mapInArrow(_numbered_rows(BLOCK_BYTES), _NUMBERED_KINDS), "blocks")
    seed, groups = _train_classes(blocks, states, settled), _groups(blocks)
    answers = _exchanged(_first_counts(blocks, seed, groups), states, groups)
    names = shared.written(answers.where(F.col("block") == _LIST).select("part", "words"), "names")
    totals, before = _totals(answers, states)[0], -np.inf
    while True:
        further = _exchanged(_next_counts(blocks, answers, totals, groups), states, groups)
        found, now = _totals(further, states)
        if now - before <= settled * abs(now):
            shared.dropped(further)
            return Fitted(blocks, answers, names, totals)
        shared.dropped(answers)
        answers, totals, before = further, found, now


def _word_rows(fitted: Fitted) -> DataFrame:
    """key, n, shares of each word: one byte of the word's posterior for each state."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                shares = _from_planes(row["shares"])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(_unpacked(row["n"])), pa.array(shares)], ["key", "n", "shares"])

    sent = fitted.answers.where(F.col("block") == _LIST).select("part", "n", "shares")
    return fitted.names.where("words IS NOT NULL").join(sent, "part").mapInArrow(task, "key binary, n long, shares long")


def train(docs: DataFrame, states: int = STATES, settled: float = SETTLED) -> tuple[DataFrame, Totals]:
    """The words' counts (key, n, shares: one byte of the word's posterior for each state) and the model's totals."""
    fitted = fit(docs, states, settled)
    return shared.written(_word_rows(fitted), "words"), fitted.totals


def emission(n: np.ndarray, shares: np.ndarray, totals: Totals) -> np.ndarray:
    """(word, state) probabilities of words with these counts; a count of 0 stands for the unknown word."""
    part = (shares[:, None] >> (8 * np.arange(totals.by_state.size))) & 255
    part = part / np.maximum(part.sum(axis=1, keepdims=True), 1)
    unknown = (totals.once_by_state + 1) / (totals.by_state + 2)
    own = n[:, None] * part / np.maximum(totals.by_state, 1e-300)
    known = (1 - MIXED) * own + MIXED * n[:, None] / max(totals.tokens, 1)
    return np.where(n[:, None] > 0, (1 - unknown) * known, unknown)


_BLOCK_KINDS = "key binary, block long, number int, sequence binary, ids binary, lengths binary"


def _block_rows(most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each word of a block, and one with the block's texts as packed numbers, frequent words first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in postings.blocks(batches, most_bytes):
            words, tokens, lengths = _numbered(texts)
            n = len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*words, b" %d" % block], pa.binary()),
                    pa.array(np.full(n + 1, block), pa.int64()),
                    pa.array(np.arange(n + 1), pa.int32()),
                    pa.array([None] * n + [_planes(hmm.by_step(tokens, lengths))], pa.binary()),
                    pa.array([None] * n + [postings.pack_ids(ids)], pa.binary()),
                    pa.array([None] * n + [_planes(lengths)], pa.binary()),
                ],
                ["key", "block", "number", "sequence", "ids", "lengths"],
            )
            del words, tokens, lengths
            shared.release_memory()

    return task


def _read_block(words: list[tuple], texts: tuple) -> tuple[hmm.Layout, np.ndarray, np.ndarray, np.ndarray]:
    """A block's texts, counts and shares by token, and the texts' sizes."""
    sequence, _, lengths = texts
    tokens, sizes = _from_planes(sequence), _from_planes(lengths)
    n, shares = np.zeros(int(tokens.max()) + 1, np.int64), np.zeros(int(tokens.max()) + 1, np.int64)
    for number, count, share in words:
        n[number], shares[number] = count, share
    return hmm.laid_out(tokens, sizes), n, shares, sizes


_SCORE_KINDS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score_batch(totals: Totals, ids: pa.Array, data: hmm.Layout, sizes: np.ndarray, n: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
    natural = hmm.log_likelihoods(totals.chain, emission(n, shares, totals), data)
    base = np.log10((n + 1) / (totals.tokens + totals.words + 1))
    known = hmm.sums((n > 0)[data.tokens].astype(float), data).astype(np.int64)
    out = [ids, pa.array(sizes), pa.array(known), pa.array(hmm.sums(base[data.tokens], data)), pa.array(natural / np.log(10))]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _scored(totals: Totals) -> Callable[[list[tuple], tuple], pa.RecordBatch]:
    def finished(words: list[tuple], texts: tuple) -> pa.RecordBatch:
        data, n, shares, sizes = _read_block(words, texts)
        return _score_batch(totals, texts[1], data, sizes, n, shares)

    return finished


def _score_trained(fitted: Fitted) -> DataFrame:
    """The scores of the texts that the model was fitted to, from their blocks."""
    totals = fitted.totals

    def finished(row: dict, data: hmm.Layout, places: np.ndarray, n: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
        return _score_batch(totals, postings.unpack_ids(row["ids"]), data, _from_planes(row["lengths"]), n, shares)

    return _of_answers(fitted.blocks, fitted.answers, _groups(fitted.blocks), finished, _SCORE_KINDS)


def _of_blocks(finished: Callable[[list[tuple], tuple], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``finished`` with each block's (number, n, shares) of words and (sequence, ids, lengths) of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, texts = None, [], None
        for batch in batches:
            names = shared.numbers(batch.column("block"))
            cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if names.size else []
            for a, b in zip(cuts, [*cuts[1:], names.size], strict=False):
                if names[a] != block:
                    if texts is not None:
                        yield finished(words, texts)
                    block, words, texts = names[a], [], None
                part = batch.slice(a, b - a)
                is_word = shared.numbers(part.column("n").is_valid())
                if not is_word.all():
                    k = int(np.flatnonzero(~is_word)[0])
                    sequence, ids, lengths = (part.column(c)[k].as_py() for c in ("sequence", "ids", "lengths"))
                    texts = (sequence, postings.unpack_ids(ids), lengths)
                    part = part.filter(pa.array(is_word))
                words.append(tuple(shared.numbers(part.column(c)) for c in ("number", "n", "shares")))
        if texts is not None:
            yield finished(words, texts)
        del words, texts
        shared.release_memory()

    return task


def _with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of the texts' blocks with their words' counts, each block in one partition."""
    blocks = postings.steady(texts).mapInArrow(_block_rows(BLOCK_BYTES), _BLOCK_KINDS)
    found = blocks.join(words, "key", "left").where("n IS NOT NULL OR sequence IS NOT NULL").drop("key")
    return found.repartition("block").sortWithinPartitions("block")


def score(docs: DataFrame, words: DataFrame, totals: Totals) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row of ``docs``."""
    found = _with_words(_texts(docs), words)
    return found.mapInArrow(_of_blocks(_scored(totals)), _SCORE_KINDS)


def scores(docs: DataFrame, states: int = STATES, settled: float = SETTLED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    The model learns from the rows that aren't held out; both scores are log10 probabilities of the lower-cased words
    and one end. base_score is that of single words with one count added. A null text is empty and has the end only; a
    null id counts as an empty text for ``held_out``. Without training rows every token is unknown. Repeated rows count
    as often as they come; other columns aren't read.
    """
    held_out = is_held_out(F.col("doc_id"))
    fitted = fit(docs.where(~held_out), states, settled)
    totals = fitted.totals
    rows = _score_trained(fitted).unionByName(score(docs.where(held_out), _word_rows(fitted), totals))
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
