"""Suffix arrays of many small texts at once, by linear grouping construction, and their repeats.

Suffixes are grouped by their Lyndon prefix (the longest prefix that is a Lyndon word). All suffixes start grouped by
first byte. Groups are handled in descending order: a handled suffix leaves the list of live positions, so the live
neighbour on its left is its previous smaller suffix, and that one on its right the next smaller one. Suffixes to which
a group's members point get longer Lyndon prefixes, so they move to new groups right above their old one. Afterwards
the groups are handled in ascending order: members differ only in what follows their Lyndon prefix, whose place is
known by then, so one sort per group emits its order. No rank is ever renamed in rounds.

Independent texts ("instances") take these steps together, one group of every instance at a time, which makes each step
a numpy operation over many texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Positions that take their steps together; bounds the memory of a batch to some 60 bytes for each.
BATCH_POSITIONS = 1 << 20


class Instances:
    """Regions of bytes laid out one after another, an end mark (0; bytes count from 1) behind each."""

    def __init__(self, groups: Sequence[Sequence[bytes]]):
        regions = [region for group in groups for region in group]
        self.lengths = np.fromiter(map(len, regions), np.int64, len(regions))
        self.region_start = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.size = int((self.lengths + 1).sum())
        self.raw = np.frombuffer(b"\0".join(regions) + b"\0" * 9, np.uint8)  # 8 more, so that words can be read
        self.region_end = self.region_start + self.lengths
        symbols = self.raw[: self.size].astype(np.int16) + 1
        symbols[self.region_end] = 0
        self.symbols = symbols
        counts = np.fromiter(map(len, groups), np.int64, len(groups))
        first = np.concatenate(([0], np.cumsum(counts)))
        ends = np.append(self.region_start, self.size)
        self.base = ends[first[:-1]]
        self.stop = ends[first[1:]]
        self.marks = counts
        self.instance = np.repeat(np.arange(len(groups)), self.stop - self.base)
        self.end_of = np.repeat(self.region_end, self.lengths + 1)


def _ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (sizes[0] of them), start[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(start - ends + sizes, sizes)


def suffix_order(texts: Instances) -> np.ndarray:
    """Suffix arrays of all instances, one behind another; end marks sort first, in the order of their regions."""
    n = texts.size
    key = texts.instance * 257 + texts.symbols
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    ends = np.append(new[1:], n)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(new, ends - new)
    group[n] = -1  # what lies left of a region's first position
    group_end = np.zeros(n, np.int64)
    group_end[new] = ends
    left = np.arange(-1, n)
    left[texts.region_start] = n
    right = np.arange(1, n + 2)
    leaves_at = np.zeros(n, np.int64)  # the next smaller suffix that isn't in the same group
    repeats = np.zeros(n, np.int64)  # how often the Lyndon prefix stands before it
    moving = np.zeros(n, bool)

    handled: list[tuple[np.ndarray, np.ndarray]] = []
    end, floor = texts.stop.copy(), texts.base + texts.marks
    active = end > floor
    end, floor = end[active], floor[active]
    while end.size:
        start = group[order[end - 1]]
        handled.append((start, end))
        members = order[_ranges(start, end - start)] if np.any(end - start > 1) else order[start]
        members = np.sort(members)
        before = left[members]
        heads = np.flatnonzero(group[before] != group[members])
        runs = np.diff(np.append(heads, members.size))
        lefts = before[heads]
        rights = right[members[heads + runs - 1]]
        leaves_at[members] = np.repeat(rights, runs)
        repeats[members] = np.repeat(heads + runs, runs) - np.arange(members.size)
        right[lefts] = rights
        left[rights] = lefts

        inside = lefts != n
        if not inside.all():
            lefts, runs = lefts[inside], runs[inside]
        if lefts.size:
            old = group[lefts]
            by = np.argsort(old * (int(runs.max()) + 1) + runs)
            lefts, old, runs = lefts[by], old[by], runs[by]
            changes = old[1:] != old[:-1]
            block = np.flatnonzero(np.concatenate(([True], changes)))
            count = np.diff(np.append(block, old.size))
            first = old[block]
            block_end = group_end[first]
            block_start = block_end - count
            target = _ranges(block_start, count)
            slots = slot[lefts]
            moving[lefts] = True
            occupants = order[target]
            displaced = occupants[~moving[occupants]]
            if displaced.size:
                vacated = slots[slots < np.repeat(block_start, count)]
                order[vacated] = displaced
                slot[displaced] = vacated
            moving[lefts] = False
            order[target] = lefts
            slot[lefts] = target
            group_end[first] = block_start
            head = np.flatnonzero(np.concatenate(([True], changes | (runs[1:] != runs[:-1]))))
            last = np.append(head[1:], old.size) - 1
            group_end[target[head]] = target[last] + 1
            group[lefts] = np.repeat(target[head], last - head + 1)

        going = start > floor
        end, floor = start[going], floor[going]

    rank = slot  # right for end marks and groups of one
    for start, end in reversed(handled):
        size = end - start
        many = size > 1
        if not many.any():
            continue
        start, size = start[many], size[many]
        slots = _ranges(start, size)
        members = order[slots]
        by = np.lexsort((rank[leaves_at[members]], repeats[members], np.repeat(start, size)))
        members = members[by]
        order[slots] = members
        rank[members] = slots
    return order


def common_prefixes(texts: Instances, order: np.ndarray) -> np.ndarray:
    """For each position, the longest common prefix with the suffix before it in its instance's order.

    Where the bytes before both suffixes are equal, the value is the last position's less one; the others are compared,
    eight bytes at a time.
    """
    n = texts.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = np.where(texts.instance[order[1:]] == texts.instance[order[:-1]], order[:-1], -1)
    before[texts.region_end] = -1
    at = np.arange(n)
    has = before >= 0
    is_first = np.zeros(n + 1, bool)
    is_first[texts.region_start] = True
    follows = has & ~is_first[at] & ~is_first[before]
    follows &= texts.raw[at - 1] == texts.raw[before - 1]
    compared = np.flatnonzero(has & ~follows)
    words = np.ndarray((n,), "<u8", buffer=texts.raw, strides=(1,))
    result = np.zeros(n, np.int64)
    i, j = compared, before[compared]
    limit = np.minimum(texts.end_of[i] - i, texts.end_of[j] - j)
    length = np.zeros(i.size, np.int64)
    while i.size:
        different = words[i + length] ^ words[j + length]
        equal = (different == 0) & (length + 8 < limit)
        done = ~equal
        d = different[done]
        low = d & (~d + np.uint64(1))
        equal_bytes = np.where(d == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        result[i[done]] = np.minimum(length[done] + equal_bytes, limit[done])
        i, j, limit, length = i[equal], j[equal], limit[equal], length[equal] + 8
    origin = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(has, np.where(follows, result[origin] - (at - origin), result), 0)


def repeated_starts(groups: Sequence[Sequence[bytes]], length: int) -> list[np.ndarray]:
    """For each region of each group, where those strings of ``length`` bytes start that also start elsewhere in the group."""
    found: list[np.ndarray] = [np.empty(0, np.int64)] * sum(map(len, groups))
    first = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
    sizes = np.array([sum(map(len, g)) + len(g) for g in groups])
    batch: list[int] = []
    held = 0
    for k in np.argsort(sizes, kind="stable"):
        if batch and held + sizes[k] > BATCH_POSITIONS:
            _batch_starts(groups, batch, first, length, found)
            batch, held = [], 0
        batch.append(k)
        held += sizes[k]
    if batch:
        _batch_starts(groups, batch, first, length, found)
    return found


def _batch_starts(
    groups: Sequence[Sequence[bytes]], batch: list[int], first: np.ndarray, length: int, found: list[np.ndarray]
) -> None:
    texts = Instances([groups[k] for k in batch])
    if not texts.size:
        return
    order = suffix_order(texts)
    common = common_prefixes(texts, order)
    repeated = common >= length
    following = order[1:][repeated[order[1:]]]
    slots = np.empty(texts.size, np.int64)
    slots[order] = np.arange(texts.size)
    repeated[order[slots[following] - 1]] = True
    hits = np.flatnonzero(repeated)
    region = np.searchsorted(texts.region_start, hits, "right") - 1
    starts = hits - texts.region_start[region]
    cuts = np.searchsorted(region, np.arange(texts.lengths.size + 1))
    r = 0
    for k in batch:
        for m in range(first[k], first[k + 1]):
            found[m] = starts[cuts[r] : cuts[r + 1]]
            r += 1
