"""One-dimensional cutting stock by column generation.

A pattern says how many items of each size go into one sequence. The linear program over patterns finds how often to use
each so that all items are packed into the fewest sequences. Few patterns are needed at a time: the simplex method keeps a
basis of as many as there are sizes, and dynamic programming over a knapsack finds the pattern that the current prices make
most valuable. Rounding down leaves a few items, which are packed largest first.
"""

from __future__ import annotations

import numpy as np

#: The program ends when no solution can be better by more than this part.
GAP = 1e-4
#: Rooms of the knapsack that are filled at once with the sizes of at least as many units; smaller sizes go room by room.
ROOMS = 32


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, its value first: dynamic programming over the room that is left."""
    useful = np.flatnonzero(prices > 1e-12)
    cut = int(np.searchsorted(sizes[useful], ROOMS))
    small = list(zip(sizes[useful[:cut]].tolist(), prices[useful[:cut]].tolist(), useful[:cut].tolist(), strict=True))
    large, price = sizes[useful[cut:]], prices[useful[cut:]]
    filled = np.full(2 * capacity + 1, -np.inf)  # the values, from room -capacity on: nothing fits into less than no room
    filled[capacity] = 0
    value, choice = [0.0], [-1]
    for first in range(1, capacity + 1, ROOMS):
        rooms = np.arange(first, min(first + ROOMS, capacity + 1))
        fits = int(np.searchsorted(large, rooms[-1], "right"))
        if fits:
            gained = filled[capacity + rooms[:, None] - large[:fits]] + price[:fits]
            best = gained.argmax(axis=1)
            most, taken = gained[np.arange(rooms.size), best].tolist(), useful[cut + best].tolist()
        for j, room in enumerate(rooms.tolist()):
            now, chosen = value[room - 1], -1
            for size, worth, k in small:
                if size > room:
                    break
                if value[room - size] + worth > now:
                    now, chosen = value[room - size] + worth, k
            if fits and most[j] > now:
                now, chosen = most[j], taken[j]
            value.append(now)
            choice.append(chosen)
        filled[capacity + rooms] = value[first:]
    pattern = np.zeros(sizes.size, np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return value[capacity], pattern


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, size) counts and how often to use each pattern, in fractions. ``sizes`` rise and are at most ``capacity``."""
    own = capacity // sizes
    basis = np.diag(own).astype(np.int64)  # a column for each pattern
    inverse = np.diag(1.0 / own)
    used = demand / own
    while True:
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + GAP:
            return basis.T, used
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, used / direction, np.inf)
        leaves = int(ratios.argmin())
        used = np.maximum(used - ratios[leaves] * direction, 0)
        used[leaves] = ratios[leaves]
        basis[:, leaves] = pattern
        row = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, row)
        inverse[leaves] = row


def rest_patterns(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for a few items: each takes the largest that still fits, again and again."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        while True:
            fits = np.flatnonzero((left > 0) & (sizes <= room))
            if not fits.size:
                break
            k = fits[-1]
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k] += n
            left[k] -= n
            room -= n * int(sizes[k])
        out.append(pattern)
    return out


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, size) counts and how often each is used, whole numbers that pack exactly ``demand`` items of each size."""
    if not sizes.size:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    found, used = fractional(sizes, demand.astype(float), capacity)
    times = np.floor(used + 1e-9).astype(np.int64)
    left = demand - times @ found
    for k in np.flatnonzero((found * times[:, None] > 0).any(axis=1)):  # rounding errors: never pack more than there is
        while times[k] and np.any((left < 0) & (found[k] > 0)):
            times[k] -= 1
            left += found[k]
    rest = rest_patterns(sizes, left, capacity)
    return np.concatenate((found[times > 0], *(r[None] for r in rest))), np.append(times[times > 0], np.ones(len(rest), np.int64))
