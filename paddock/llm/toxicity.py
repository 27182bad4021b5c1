"""Toxicity by a grammar of weighted finite-state transducers over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, quotation mark, clause end, other). Transducers
rewrite the symbols: negation and reported speech weaken an insult or threat behind them, a target makes it a directed
one, a clause end resets them all. Their composition is one transducer, built once; run over a clause it leaves the
patterns that matched there, all of which count as its heaviest one. A text's score is the logistic function of the
weighted numbers of matches, so a word scores by the clause it stands in, and of clauses, as a long text has some by chance.

The general words are fixed values below. Insults of any language, as words or word beginnings, and the patterns'
weights are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paddock.llm import shared

#: Labelled rows from which words and weights are learned.
SAMPLE_ROWS = 8000
#: Words and word beginnings that may be learned.
LEXICON_ROWS = 2000
#: Evidence that a learned entry needs: its log odds, and the likelihood ratio (chi-squared, one degree of freedom).
LEAST_LOG_ODDS = 2.0
LEAST_RATIO = 30.0
#: Words whose symbols a task keeps.
KEPT_WORDS = 100_000
#: Letters of word beginnings; a word begins so if it goes on behind them.
STEMS = (4, 5, 6, 7, 8)

# General words of the grammar, by symbol.
INSULTS = "idiot idiots moron morons imbecile loser losers scum trash vermin worthless pathetic disgusting stupid clown dumb"
THREATS = "kill hurt destroy murder beat shoot stab hunt strangle burn"
TARGETS = "you your youre u he she they them him her we us i me my his their these those people"
NEGATIONS = "not no never none neither nor isnt arent wasnt dont doesnt didnt without hardly"
REPORTS = "said says say saying wrote writes called calls quoted quotes claims claimed alleged reported told tells"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = "oITGNRQE"
#: Patterns that a clause can match, lightest first, and the prior of their weights.
PATTERNS = {
    "i": -0.5,  # negated insult
    "t": -0.5,  # negated threat
    "r": 0.0,  # reported insult
    "q": 0.0,  # reported threat
    THREAT: 0.3,
    INSULT: 2.0,
    "D": 3.0,  # directed insult
    "X": 3.0,  # directed threat
}
SYMBOLS = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, "i", "t", "r", "q", "D", "X"]


class Transducer(NamedTuple):
    """Sequential: arcs[state][symbol] = (next state, symbol written); what isn't listed is copied, by rest[state]."""

    arcs: list[dict[str, tuple[int, str]]]
    rest: list[int]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs[state].get(symbol, (self.rest[state], symbol))


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what ``second`` makes of the output of ``first``; states that can't be reached go."""
    number = {(0, 0): 0}
    arcs: list[dict[str, tuple[int, str]]] = []
    queue = [(0, 0)]
    for a, b in queue:
        row = {}
        for symbol in SYMBOLS:
            to_a, middle = first.step(a, symbol)
            to_b, out = second.step(b, middle)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                queue.append((to_a, to_b))
            row[symbol] = (number[to_a, to_b], out)
        arcs.append(row)
    return Transducer(arcs, [0] * len(arcs))


def negation(reach: int = 3) -> Transducer:
    """An insult or threat up to ``reach`` words behind a negation is weakened."""
    weak = {INSULT: "i", THREAT: "t"}
    arcs = [{NEGATION: (reach, NEGATION)}]
    for k in range(1, reach + 1):
        arcs.append({NEGATION: (reach, NEGATION), END: (0, END)} | {s: (k - 1, w) for s, w in weak.items()})
    return Transducer(arcs, [0, *range(reach)])


def reported_speech() -> Transducer:
    """Behind a reporting verb or a quotation mark, up to the clause's end, insults and threats are reported ones."""
    begin = {REPORT: (1, REPORT), QUOTE: (1, QUOTE)}
    return Transducer([begin, {INSULT: (1, "r"), THREAT: (1, "q"), QUOTE: (0, QUOTE), END: (0, END)}], [0, 1])


def target() -> Transducer:
    """A target makes what follows in its clause directed."""
    return Transducer([{TARGET: (1, TARGET)}, {INSULT: (1, "D"), THREAT: (1, "X"), END: (0, END)}], [0, 1])


def threat() -> Transducer:
    """A target behind an undirected threat makes it directed."""
    return Transducer([{THREAT: (1, THREAT)}, {TARGET: (0, "X"), END: (0, END)}], [0, 1])


def grammar() -> Transducer:
    return composed(composed(composed(negation(), reported_speech()), target()), threat())


_TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n\"«»“”]")
_APOSTROPHES = str.maketrans("", "", "'’")
_CODES = {s: k for k, s in enumerate(SYMBOLS)}
_FIXED = {word: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for word in words.split()}
_FIXED |= {c: QUOTE for c in '"«»“”'} | {c: END for c in ".,;:!?\n"}
_MATTERS = bytes(_CODES[s] for s in (INSULT, THREAT))
_RANK = {s: k for k, s in enumerate(PATTERNS)}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().translate(_APOSTROPHES) if "'" in text or "’" in text else text.lower())


class Symbols(dict):
    """Symbol codes of words, kept for the words seen last."""

    def __init__(self, learned: frozenset[str]):
        self.learned = learned

    def __missing__(self, word: str) -> int:
        symbol = _FIXED.get(word, OTHER)
        if symbol == OTHER and (word in self.learned or any(word[:k] + "*" in self.learned for k in STEMS if len(word) > k)):
            symbol = INSULT
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = code = _CODES[symbol]
        return code


@dataclass
class Model:
    """Learned entries (a word, or a beginning and ``*``), weights of PATTERNS and of the number of clauses, and a constant."""

    learned: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [*PATTERNS.values(), 0.0])
    constant: float = -1.0

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.symbols = Symbols(self.learned)
        machine = grammar()
        self.table = [[(machine.step(q, s)[0], _RANK.get(machine.step(q, s)[1], -1)) for s in SYMBOLS] for q in range(len(machine.arcs))]

    def __getstate__(self) -> tuple:
        return self.learned, self.weights, self.constant

    def __setstate__(self, state: tuple) -> None:
        self.learned, self.weights, self.constant = state
        self.reset()

    def clauses(self, text: str) -> list[int]:
        """Matches in clauses whose heaviest pattern is each one of PATTERNS, and how many clauses there are."""
        codes = bytes(map(self.symbols.__getitem__, tokens(text)))
        counts = [0] * len(PATTERNS) + [codes.count(_CODES[END])]
        if not codes.translate(None, bytes(set(range(256)) - set(_MATTERS))):
            return counts
        for clause in codes.split(bytes([_CODES[END]])):
            matches, state = [], 0
            for code in clause:
                state, pattern = self.table[state][code]
                if pattern >= 0:
                    matches.append(pattern)
            if matches:
                counts[max(matches)] += len(matches)
        return counts

    def score(self, text: str) -> float:
        x = self.constant + sum(w * math.log1p(n) for w, n in zip(self.weights, self.clauses(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score_column(text: Column, model: Model) -> Column:
    """Score of each text, 0 to 1; a null text is empty."""

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(str(t, "utf-8", "replace")) for t in shared.slices(texts)], pa.float64())

    return scored(F.coalesce(text, F.lit("")).cast("binary"))


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model to at most ``sample_rows`` labelled rows that aren't held out, those with the least hash of their id.

    Rows without a label or an id aren't used; of several labels of an id the highest counts. Without labelled rows, or
    with one kind of label only, the fixed words and prior weights stand.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # of sample_rows rows at most
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = shared.written(rows.select("toxic", F.col("text").cast("binary").alias("text")), "labelled")

    kinds = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not clean:
        return Model()
    seen, part = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    surprise = lambda n, p: F.when(n > 0, n * F.log(n / (seen * p))).otherwise(0.0)
    ratio = 2 * (surprise(F.col("toxic"), part) + surprise(F.col("clean"), 1 - part))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    entries = _entries(rows).where((odds >= LEAST_LOG_ODDS) & (ratio >= LEAST_RATIO))
    best = entries.orderBy(ratio.desc(), "entry").limit(LEXICON_ROWS).collect()
    learned: set[str] = set()
    for entry in (r.entry for r in best):  # of a word and its beginnings the most telling
        own = entry.rstrip("*")
        if not any(own.startswith(e.rstrip("*")) or e.startswith(own) for e in learned):
            learned.add(entry)
    model = Model(frozenset(learned))
    counted = rows.select("toxic", _clause_column(F.col("text"), model).alias("n")).collect()  # sample_rows short lists
    model.weights, model.constant = _logistic(np.array([r.n for r in counted]), np.array([r.toxic for r in counted]))
    return model


def _entries(rows: DataFrame) -> DataFrame:
    """entry, toxic and clean: the texts that have it, but no more toxic ones than it has different neighbours in them.

    Copies of a text have the same neighbours, so a word that one toxic text made frequent counts once.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            found: set[tuple[str, int]] = set()
            for toxic, raw in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w for w in tokens(raw.decode("utf-8", "replace")) if len(w) > 2]
                counts[toxic == 1].update({entry for word in set(words) for entry in _forms(word)})
                if toxic == 1:
                    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                        context = xxhash.xxh32_intdigest(f"{before} {after}")
                        found.update((entry, context) for entry in _forms(word))
            clean, toxic_texts = counts
            entries, contexts = zip(*found, strict=True) if found else ((), ())
            empty, own = [0] * len(entries), [*(clean | toxic_texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*entries, *own], pa.string()),
                    pa.array([*contexts, *[None] * len(own)], pa.int64()),
                    pa.array(empty + [toxic_texts[e] for e in own], pa.int64()),
                    pa.array(empty + [clean[e] for e in own], pa.int64()),
                ],
                ["entry", "context", "toxic", "clean"],
            )

    counts = rows.mapInArrow(task, "entry string, context long, toxic long, clean long")
    sums = [F.sum(c).alias(c) for c in ("toxic", "clean")]
    counts = counts.groupBy("entry", "context").agg(*sums).groupBy("entry").agg(*sums, F.count("context").alias("contexts"))
    return counts.select("entry", F.least("toxic", "contexts").alias("toxic"), "clean")


def _forms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _clause_column(text: Column, model: Model) -> Column:
    @arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([model.clauses(str(t, "utf-8", "replace")) for t in shared.slices(texts)], pa.list_(pa.int32()))

    return counted(text)


def _logistic(counts: np.ndarray, toxic: np.ndarray, strength: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression on log(1 + count), drawn to the prior weights: patterns that weren't seen keep theirs."""
    x = np.column_stack((np.log1p(counts), np.ones(len(counts))))
    prior = np.array([*PATTERNS.values(), 0.0, -1.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - toxic @ z + strength / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(w.size)
        step = np.linalg.solve(hessian, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; other columns aren't read.

    Null and empty texts get the score of a text without matches, null ids count as an empty text for ``held_out``.
    """
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, unchanged, whatever other columns they have."""
    return docs.where(score_column(F.col("text"), model) < 0.5)
