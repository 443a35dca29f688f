"""Suffix array by linear grouping, for one text of integers.

Phase 1 groups suffixes by their Lyndon prefix (the longest prefix that is less than all its own proper suffixes). Groups start as
first symbols and are processed in descending order; from each member a pointer leads to the previous suffix of
a smaller group, whose Lyndon prefix is thereby prolonged: pointed-to suffixes leave their group for a new one right above
it, those with more pointers from the group higher. Phase 2 goes through the array in ascending order and puts each suffix that
hangs on the one just emitted by previous-smaller pointers into the next place of its group; no ranks are renamed, nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text (non-negative integers) in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    # suffix n is the empty one: a symbol below all others. Groups are ranges of `order`, known by their first place.
    symbols = np.concatenate([text.astype(np.int64) + 1, [0]])
    order_np = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order_np]
    lead = np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]]
    begin = np.maximum.accumulate(np.where(lead, np.arange(n + 1), 0))
    place_np = np.empty(n + 1, np.int64)
    place_np[order_np] = np.arange(n + 1)
    group_np = np.empty(n + 1, np.int64)
    group_np[order_np] = begin
    ends_np = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(lead)
    ends_np[starts] = np.r_[starts[1:], n + 1]
    order, place, group, end = order_np.tolist(), place_np.tolist(), group_np.tolist(), ends_np.tolist()
    prev = [-2] * (n + 1)  # -2: not looked for yet; -1: none
    at = n  # the last place of the group in work
    while at >= 0:
        g = group[order[at]]
        members = order[g : at + 1]
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:  # larger groups are done and know their own pointers
                p = prev[j]
                j = p if p != -2 else j - 1
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for j, c in counts.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for j in by_count[c]:
                    moved.setdefault(group[j], []).append(j)
                for old, js in moved.items():
                    last = end[old]
                    if last - old == len(js):
                        continue  # the whole group moves: it stays where it is
                    for j in js:  # to the back of the old group
                        last -= 1
                        k, other = place[j], order[last]
                        order[k], order[last] = other, j
                        place[other], place[j] = k, last
                    end[last], end[old] = end[old], last
                    for j in js:
                        group[j] = last
        at = g - 1
    # phase 2
    out = [-1] * (n + 1)
    free = list(range(n + 1))  # next place of each group, by its first place
    done = [False] * (n + 1)
    out[0], done[n] = n, True
    for r in range(n + 1):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return np.array(out[1:], np.int64)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """lcp[r]: symbols that suffixes r - 1 and r share; lcp[0] is 0."""
    n = len(text)
    symbols, rank = text.tolist(), [0] * n
    for r, i in enumerate(suffixes.tolist()):
        rank[i] = r
    order, out, h = suffixes.tolist(), [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        m = n - max(i, j)
        while h < m and symbols[i + h] == symbols[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int64)
