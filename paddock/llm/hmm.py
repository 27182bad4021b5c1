"""Hidden Markov models over many token sequences at once: scaled forward and backward recursions in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np


#: Steps from one scaling to the next: few enough that what isn't scaled stays far above the least number.
SCALED = 8


class Chain(NamedTuple):
    """Probabilities of the first state and of the next one."""

    initial: np.ndarray
    transition: np.ndarray


class Layout(NamedTuple):
    """Sequences longest first: the tokens of all first steps, then of all second ones; how many sequences have each step."""

    tokens: np.ndarray
    alive: list[int]
    order: np.ndarray


def _order(lengths: np.ndarray) -> tuple[list[int], np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    alive = lengths.size - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    return alive.tolist(), order


def by_step(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The tokens of sequences that come one behind another, as a layout has them."""
    alive, order = _order(lengths)
    starts = (np.cumsum(lengths) - lengths)[order]
    return tokens[np.concatenate([starts[:m] + t for t, m in enumerate(alive)])] if alive else tokens[:0]


def laid_out(tokens: np.ndarray, lengths: np.ndarray) -> Layout:
    """Of tokens that are in the order of ``by_step``."""
    return Layout(tokens, *_order(lengths))


def layout(sequences: Sequence[np.ndarray]) -> Layout:
    """Sequences must not be empty."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    return laid_out(by_step(np.concatenate(sequences), lengths) if len(sequences) else np.empty(0, np.int64), lengths)


def sums(values: np.ndarray, data: Layout) -> np.ndarray:
    """The sum of each sequence's values; ``values`` are in the order of the layout's tokens."""
    total = np.zeros(data.order.size)
    end = 0
    for m in data.alive:
        total[:m] += values[end : end + m]
        end += m
    return _in_place(total, data)


def _in_place(found: np.ndarray, data: Layout) -> np.ndarray:
    out = np.empty_like(found)
    out[data.order] = found
    return out


def _emitted(emission: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """(state, token) probabilities: rows of one state lie together, so that a step's work on them is one run over memory."""
    out = np.empty((emission.shape[1], tokens.size))
    for row, of_state in zip(out, emission.T, strict=True):
        np.take(np.ascontiguousarray(of_state), tokens, out=row, mode="clip")
    return out


def _last(data: Layout) -> np.ndarray:
    """Where each sequence's last token is, the longest sequence first."""
    alive = np.array(data.alive, np.int64)
    steps = np.searchsorted(-alive, -np.arange(data.order.size))  # that have the sequence
    return (np.cumsum(alive) - alive)[steps - 1] + np.arange(data.order.size)


def _forward(chain: Chain, seen: np.ndarray, data: Layout) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Forward probabilities by state and token, scaled at every SCALED steps; the scales of each of these, and the last sums."""
    alphas, scales = np.empty_like(seen), []
    step, before, start = np.ascontiguousarray(chain.transition.T), alphas[:, :0], 0
    for t, m in enumerate(data.alive):
        end = start + m
        here = alphas[:, start:end]
        if t:
            np.matmul(step, before[:, :m], out=here)
            here *= seen[:, start:end]
            if t % SCALED == 0:
                scales.append(here.sum(axis=0))
                here /= scales[-1]
        else:
            np.multiply(seen[:, :end], chain.initial[:, None], out=here)
        before, start = here, end
    return alphas, scales, alphas[:, _last(data)].sum(axis=0)


def _logs(scales: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability, the longest sequence first."""
    total = np.log(last)
    for scale in scales:
        total[: scale.size] += np.log(scale)
    return total


def log_likelihoods(chain: Chain, emission: np.ndarray, data: Layout) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion; ``emission``: (token, state)."""
    return _in_place(_logs(*_forward(chain, _emitted(emission, data.tokens), data)[1:]), data)


def expected_counts(chain: Chain, emission: np.ndarray, data: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts: of each token's states, of first states, of steps from state to state."""
    return expectations(chain, emission, data)[:3]


def expectations(chain: Chain, emission: np.ndarray, data: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The expected counts, and the natural log of all sequences' probability."""
    states, n = chain.initial.size, data.order.size
    seen = _emitted(emission, data.tokens)  # in place: the forward probability times the backward one
    alphas, scales, last = _forward(chain, seen, data)
    steps, first = np.zeros((states, states)), np.zeros(states)
    # a sequence that has yet to end has what makes its last states' probabilities one
    betas, products = np.tile(1 / last, (states, 1)), np.empty((states, n))
    end = data.tokens.size
    for t in range(len(data.alive) - 1, -1, -1):
        m = data.alive[t]
        start = end - m
        here, beta, alpha = seen[:, start:end], betas[:, :m], alphas[:, start:end]
        if t:
            ahead = products[:, :m]
            np.multiply(beta, here, out=ahead)
            if t % SCALED == 0:
                ahead /= scales[t // SCALED - 1]
            np.multiply(alpha, beta, out=here)
            before = start - data.alive[t - 1]
            steps += alphas[:, before : before + m] @ ahead.T
            np.matmul(chain.transition, ahead, out=beta)
        else:
            np.multiply(alpha, beta, out=here)
            first = here.sum(axis=1)
        end = start
    counts = np.stack([np.bincount(data.tokens, of_state, len(emission)) for of_state in seen], axis=1)
    return counts, first, steps * chain.transition, float(_logs(scales, last).sum())


def normalised(counts: np.ndarray, more: float = 1.0) -> np.ndarray:
    counts = counts + more
    return counts / counts.sum(axis=-1, keepdims=True)
