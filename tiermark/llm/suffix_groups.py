"""Suffix arrays of many short strings side by side, by groups of suffixes (after Baier, 2016, "Linear-time suffix sorting").

Phase 1 groups the suffixes of a string by their longest Lyndon prefix.  It begins with a group for each first symbol and takes the
groups in descending order.  Every member of the group at hand gets a pointer to the nearest suffix on its left in a smaller
group; suffixes pointed at once, twice and so on leave their own group for new ones right behind it, more pointers further
back.  Phase 2 emits the order: the suffix of the next place names the suffixes whose next smaller suffix it is, along the pointers
from the suffix before it; each goes to the next free place of its group.  Nothing is renamed and solved again.

All strings of a call take each step together, in numpy.
"""

from __future__ import annotations

import numpy as np


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, sizes long, one after another."""
    return np.repeat(first - _starts(sizes), sizes) + np.arange(sizes.sum(), dtype=np.int32)


def _sorted(symbols: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Places by string, then by symbol (numbers of 16 bits are sorted by their digits)."""
    narrow = lambda x: x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x
    by_symbol = np.argsort(narrow(symbols), kind="stable")
    return by_symbol[np.argsort(narrow(lane[by_symbol]), kind="stable")].astype(np.int32)


def _groups(symbols: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every suffix's group and its pointer after phase 1.  A pointer of none is a place in the string before, whose
    groups all come earlier (-1 for the first string, which stands for a group before all)."""
    n = len(symbols)
    lane = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    members = _sorted(symbols, lane)
    place = np.empty(n, np.int32)
    place[members] = np.arange(n, dtype=np.int32)
    ordered, of = symbols[members], lane[members]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(new).astype(np.int32)
    size = np.zeros(n, np.int32)
    size[begins] = np.diff(np.append(begins, n))
    group = np.full(n + 1, -1, np.int32)
    group[members] = np.repeat(begins, size[begins])
    pointer, flag, last, end, low = np.full(n + 1, -1, np.int32), np.zeros(n, bool), np.zeros(n, np.int32), base + sizes, base
    while len(end):
        at = group[members[end - 1]]  # the last group that has not been taken yet, of every string
        count = end - at
        i = members[_ranges(at, count)] if len(at) != count.sum() else members[at]
        mine, first = np.repeat(at, count), np.repeat(low, count)
        p = i - 1
        over = np.flatnonzero(group[p] > mine)
        while len(over):  # over suffixes of larger groups, whose pointers are known
            p[over] = pointer[p[over]]
            over = over[group[p[over]] > mine[over]]
        pointer[i] = p
        over = np.flatnonzero(group[p] == mine)
        while len(over):  # and over members of the same group
            p[over] = pointer[p[over]]
            over = over[group[p[over]] == mine[over]]
        pointer[i] = p
        p = np.sort(p[p >= first])
        own = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else p
        aims, times = p[own], np.diff(np.append(own, len(p)))
        old = group[aims]
        number = np.arange(len(old), dtype=np.int32)
        last[old] = number
        again = old[last[old] != number]
        if len(again):  # groups that several leave
            flag[again] = True
            several = flag[old]
            flag[again] = False
            single = ~several
            _part(aims[several], times[several], old[several], members, place, group, size, flag)
            aims, old = aims[single], old[single]
        # one suffix leaves its group: it changes places with the last of it
        size[old] -= 1
        slots, was = old + size[old], place[aims]
        other = members[slots]
        members[was], place[other] = other, was
        members[slots], place[aims] = aims, slots
        size[slots], group[aims] = 1, slots
        left = at > low
        end, low = at[left], low[left]
    return group, pointer


def _part(aims, times, old, members, place, group, size, flag) -> None:
    """Move the aims, pointed at so many times, out of their old groups to new ones right behind, by times."""
    order = np.argsort(old.astype(np.int64) * len(members) + times)
    aims, times, old = aims[order], times[order], old[order]
    change = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
    moved = np.diff(np.append(change, len(old)))
    home = old[change]
    slots = _ranges(home + size[home] - moved, moved)
    was = place[aims]
    flag[slots] = True
    holes = np.sort(was[~flag[was]])
    flag[slots] = False
    if len(holes):
        flag[was] = True
        shifted = members[np.sort(slots[~flag[slots]])]
        flag[was] = False
        members[holes], place[shifted] = shifted, holes
    members[slots], place[aims] = aims, slots
    size[home] -= moved
    fresh = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
    count = np.diff(np.append(fresh, len(old)))
    size[slots[fresh]] = count
    group[aims] = np.repeat(slots[fresh], count)


def suffix_orders(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order, string by string.

    symbols holds the strings one after another (sizes of each, above 0; under 2^31 in all); each ends in a symbol 0, smaller than all
    its others."""
    sizes = np.asarray(sizes, np.int32)
    base, symbols, n = _starts(sizes).astype(np.int32), np.asarray(symbols), len(symbols)
    if not n:
        return np.zeros(0, np.int32)
    group, pointer = _groups(symbols, base, sizes)
    order, free, left = np.full(n, -1, np.int32), np.arange(n, dtype=np.int32), np.ones(n + 1, bool)
    order[base] = base + sizes - 1
    left[base + sizes - 1] = left[-1] = False  # so a chain ends where it leaves its string
    at, high = base.copy(), base + sizes
    s = order[at] - 1
    while len(at):
        go = np.flatnonzero(left[s])
        put = s[go]
        home = group[put]
        to = free[home]
        order[to], left[put], free[home] = put, False, to + 1
        s[go] = pointer[put]
        stop = np.flatnonzero(~left[s])
        at[stop] += 1
        over = at[stop] >= high[stop]
        if over.any():
            more = np.ones(len(at), bool)
            more[stop[over]] = False
            stop = stop[~over]
            s[stop] = order[at[stop]] - 1
            at, high, s = at[more], high[more], s[more]
        else:
            s[stop] = order[at[stop]] - 1
    return order
