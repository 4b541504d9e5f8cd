"""Suffix arrays by induced sorting and permuted common prefixes, as whole-array numpy steps."""

from __future__ import annotations

import numpy as np


def _kinds(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a unique least symbol, counts as smaller."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    # within a run of equal symbols the first difference after it decides
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _refine(order: np.ndarray, rank: np.ndarray, reach: int = 1) -> np.ndarray:
    """Settle the order of suffixes whose ranks tie, comparing the ranks ``reach`` further on, doubling it.

    ``order`` lists the suffixes with ties anywhere within their group; ``rank`` holds for every
    suffix the place where its group begins, and is completed in place.
    """
    n = len(rank)
    base = rank[order]
    tied = np.zeros(len(order), dtype=bool)
    same = base[1:] == base[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    spots = np.flatnonzero(tied)
    while len(spots):
        own = order[spots]
        key = rank[own] * np.int64(n + len(order) + 2) + rank[np.minimum(own + reach, n - 1)]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[spots] = own
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        group = rank[own]
        first = np.ones(len(key), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        place = np.arange(len(key))
        head = np.maximum.accumulate(np.where(first, place, 0))
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[own] = group + (start - head)
        last = np.ones(len(key), dtype=bool)
        last[:-1] = fresh[1:]
        spots = spots[~(fresh & last)]
        reach *= 2
    return order


def _induce(t: np.ndarray, target: np.ndarray, known: np.ndarray, place: np.ndarray, above: bool) -> np.ndarray:
    """Order of the target suffixes, from the places of the known ones that end their runs.

    ``target`` and ``known`` are position lists, ``known`` sorted by suffix.  A target suffix is
    a run of its own kind followed by a known one, so its symbols up to there decide.  For
    equal first symbols known suffixes come before targets if ``above``, else after.
    """
    symbols = int(t.max()) + 1
    per_symbol = np.bincount(t[known], minlength=symbols)
    through = np.cumsum(per_symbol)
    counts = np.bincount(t[target], minlength=symbols)
    before = np.cumsum(counts) - counts
    rank = np.zeros(len(t), dtype=np.int64)
    if above:
        rank[known] = place[known] + (np.cumsum(counts) - counts)[t[known]]
        rank[target] = before[t[target]] + through[t[target]]
    else:
        rank[known] = place[known] + np.cumsum(counts)[t[known]]
        rank[target] = before[t[target]] + (through - per_symbol)[t[target]]
    order = target[np.argsort(t[target], kind="stable")]
    return _refine(order, rank)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last one is 0 and occurs nowhere else.

    Suffixes are classified as larger or smaller than their successor; the substrings between
    leftmost smaller ones are named in sorted order and, while names repeat, the string of
    names is sorted by recursion.  Their order induces that of the larger suffixes, and
    that one the order of the smaller ones.
    """
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    t = t.astype(np.int64)
    small = _kinds(t)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    place = np.zeros(n, dtype=np.int64)
    if len(marks) > 1:
        names = _names(t, small, marks)
        if names.max() + 1 == len(marks):
            ordered = np.empty(len(marks), dtype=np.int64)
            ordered[names] = np.arange(len(marks))
        else:
            ordered = suffix_array(names)
        marks = marks[ordered]
    place[marks] = np.arange(len(marks))
    large = np.flatnonzero(~small)
    if len(large):
        large = _induce(t, large, marks, place, above=False)
        place[large] = np.arange(len(large))
    smaller = _induce(t, np.flatnonzero(small), large, place, above=True)
    # merge: for equal first symbols the larger suffixes come first
    both = np.concatenate([large, smaller])
    return both[np.argsort(t[both] * 2 + small[both], kind="stable")]


def _names(t: np.ndarray, small: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Dense names, in sorted order, of the substrings from each mark to the next; the last mark is the end."""
    ends = np.append(marks[1:], marks[-1])
    symbol = t * 2 + small
    width = max(1, int(symbol.max()).bit_length())
    fit = max(1, 40 // width)
    group = np.zeros(len(marks), dtype=np.int64)
    active = np.arange(len(marks))
    at = 0
    while len(active):
        key = np.zeros(len(active), dtype=np.int64)
        for j in range(fit):
            spot = marks[active] + at + j
            inside = spot <= ends[active]
            key = (key << width) | np.where(inside, symbol[np.minimum(spot, len(t) - 1)], 0)
        at += fit
        by = np.lexsort((key, group[active]))
        own, k, g = active[by], key[by], group[active[by]]
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        first = np.ones(len(own), dtype=bool)
        first[1:] = g[1:] != g[:-1]
        spot = np.arange(len(own))
        head = np.maximum.accumulate(np.where(first, spot, 0))
        start = np.maximum.accumulate(np.where(fresh, spot, 0))
        group[own] = g + (start - head)
        last = np.ones(len(own), dtype=bool)
        last[:-1] = fresh[1:]
        going = ~(fresh & last) & (marks[own] + at <= ends[own])
        active = own[going]
    _, names = np.unique(group, return_inverse=True)
    return names


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position of the byte array its common prefix with the suffix sorted before it.

    Only where the preceding bytes differ is the prefix measured, eight bytes a step; every
    other entry is its left neighbour's less one.  ``order`` is the suffix array of the bytes.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    measured = (before < 1) | (at == 0)
    inner = ~measured
    measured[inner] = data[at[inner] - 1] != data[before[inner] - 1]
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    word = np.zeros(n + 8, dtype=np.uint64)
    for j in range(8):
        word |= padded[j : n + 8 + j].astype(np.uint64) << np.uint64(8 * j)
    a = np.flatnonzero(measured & (before >= 0))
    b = before[a]
    spot, done = a.copy(), np.zeros(n, dtype=np.int64)
    step = 0
    while len(a):
        room = n - np.maximum(a, b) - step
        differ = word[np.minimum(a + step, n + 7)] ^ word[np.minimum(b + step, n + 7)]
        low = differ & (~differ + np.uint64(1))
        bytes_same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        stop = (differ != 0) | (room <= 8)
        done[spot[stop]] = step + np.minimum(bytes_same, room)[stop]
        a, b, spot = a[~stop], b[~stop], spot[~stop]
        step += 8
    source = np.maximum.accumulate(np.where(measured, at, 0))
    return np.maximum(done[source] - (at - source), 0)
