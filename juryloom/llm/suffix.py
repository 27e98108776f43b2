"""Suffix arrays by Larsson-Sadakane refinement, and common prefixes by Kasai's walk, in numpy."""

from __future__ import annotations

import numpy as np


def leading_words(text: np.ndarray) -> np.ndarray:
    """Seven bytes from each position on, then how many of them there are, as integers in string order."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = ((four[:-4] << np.uint64(32)) | four[4:])[:n]
    return (eight & np.uint64(0xFFFFFFFFFFFFFF00)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)


def _group_starts(changed: np.ndarray) -> np.ndarray:
    """For each slot the first slot of its group; changed marks the first slots."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; a suffix that is another's prefix comes first.

    Groups of equal prefix are refined by the rank of the suffix that much further on, which doubles the sorted
    depth; groups of one suffix are done and are not touched again.
    """
    n = len(text)
    key = leading_words(text)
    order = np.argsort(key)
    changed = np.ones(n, bool)
    changed[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(changed)
    h = 7
    while True:
        single = changed & np.append(changed[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        who = order[slots]
        ahead = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who].astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        changed[slots] = first
        # Slots of untouched groups of one lie between groups, never within one.
        rank[who] = slots[_group_starts(first)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, steps: np.ndarray, cap: int) -> np.ndarray:
    """For each slot the common prefix with the slot before, up to cap, for the suffixes at starts + 0 ... steps - 1.

    Kasai's walk: from a suffix to the next in the text the common prefix shrinks by one at most. The walks of all
    strings go in step. Other slots stay at -1.
    """
    n = len(text)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    out = np.full(n, -1, np.int64)
    padded = np.concatenate([text, np.zeros(cap, np.uint8)])
    length = np.zeros(len(starts), np.int64)
    for step in range(int(steps.max(initial=0))):
        on = np.flatnonzero(steps > step)
        at = starts[on] + step
        mine = slot[at]
        before = order[np.maximum(mine - 1, 0)]
        size = np.maximum(length[on] - 1, 0)
        size[mine == 0] = 0
        room = np.minimum(cap, n - np.maximum(at, before))
        growing = np.flatnonzero((size < room) & (mine > 0))
        while len(growing):
            same = padded[at[growing] + size[growing]] == padded[before[growing] + size[growing]]
            growing = growing[same]
            size[growing] += 1
            growing = growing[size[growing] < room[growing]]
        length[on] = size
        out[mine] = size
    return out
