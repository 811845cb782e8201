"""Suffix sorting by groups of Lyndon prefixes, without recursion.

Every suffix is grouped by its longest Lyndon prefix. Groups are processed from the highest
to the lowest: for every suffix of a group, the previous suffix in a smaller group is found
by following pointers over suffixes already processed, and that suffix's prefix grows by
the processed group's prefix, once for every suffix that points to it. What grows alike
moves to a group of its own right above its old one. When no group is left, each holds the
suffixes of one Lyndon prefix, and the order within it is that of the suffixes behind the
prefixes, so one pass over the sorted suffixes hands out all places.
"""

from __future__ import annotations

from itertools import chain

import numpy as np


class _Group:
    """Suffixes that begin with one Lyndon prefix of `size` symbols, between its neighbours."""

    __slots__ = ("higher", "live", "lower", "members", "seat", "size")

    def __init__(self, members: list[int], lower: _Group | None, higher: _Group | None, size: int):
        self.members, self.lower, self.higher, self.size = members, lower, higher, size
        self.live, self.seat = len(members), 0  # members that moved on stay in the list
        if lower is not None:
            lower.higher = self
        if higher is not None:
            higher.lower = self


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The sorted suffixes of `symbols`, which are numbers of any size."""
    n = len(symbols)
    return _emit(_lyndon_groups(symbols, n), n) if n else np.zeros(0, np.int64)


def _lyndon_groups(symbols: np.ndarray, n: int) -> list[_Group]:
    """The groups of suffixes with one longest Lyndon prefix, from the lowest up."""
    order = np.argsort(symbols, kind="stable")
    bounds = np.flatnonzero(np.diff(symbols[order])) + 1
    where: list = [None] * n
    group = None
    for members in np.split(order, bounds):
        group = _Group(members.tolist(), group, None, 1)
        for suffix in group.members:
            where[suffix] = group
    smaller = list(range(-1, n - 1))  # leads over processed suffixes to the next that is not
    done = [False] * n
    finished = []
    while group is not None:
        members = group.members
        if group.live < len(members):
            group.members = members = [suffix for suffix in members if where[suffix] is group]
        if len(members) == 1:
            suffix = members[0]
            done[suffix] = True
            before = smaller[suffix]
            while before >= 0 and done[before]:
                before = smaller[before]
            smaller[suffix] = before
            if before >= 0:
                old = where[before]
                if old.live == 1:
                    old.size += group.size
                else:
                    _grow([before], old, group.size, where)
        elif members:
            for suffix in members:
                done[suffix] = True
            grown: dict[int, int] = {}
            for suffix in members:
                before = smaller[suffix]
                while before >= 0 and done[before]:
                    before = smaller[before]
                smaller[suffix] = before
                if before >= 0:
                    grown[before] = grown.get(before, 0) + 1
            parts: dict[tuple, list[int]] = {}
            for suffix, times in grown.items():
                parts.setdefault((-times, id(where[suffix])), []).append(suffix)
            # the more often a prefix is followed by this group's, the higher it ranks
            for (times, _), moved in sorted(parts.items()):
                _grow(moved, where[moved[0]], -times * group.size, where)
        if members:
            finished.append(group)
        group = group.lower
    finished.reverse()
    return finished


def _grow(moved: list[int], old: _Group, size: int, where: list) -> None:
    """Lengthen the prefix of some suffixes of a group; together they rank right above it."""
    if old.live == len(moved):
        old.size += size
        return
    new = _Group(moved, old, old.higher, old.size + size)
    old.live -= len(moved)
    for suffix in moved:
        where[suffix] = new


def _emit(groups: list[_Group], n: int) -> np.ndarray:
    counts = np.array([len(group.members) for group in groups])
    members = np.fromiter(chain.from_iterable(group.members for group in groups), np.int64, n)
    rank = np.empty(n, np.int64)
    rank[members] = np.repeat(np.arange(len(groups)), counts)
    seats = (np.cumsum(counts) - counts).tolist()
    # the suffixes whose prefix ends where another suffix begins, by that place
    behind = np.arange(n) + np.array([group.size for group in groups])[rank]
    order = np.argsort(behind, kind="stable")
    waiting, ranks = order.tolist(), rank[order].tolist()
    bounds = np.searchsorted(behind[order], np.arange(n + 2)).tolist()
    out = [0] * n
    at, place = -1, n
    while True:
        for k in range(bounds[place], bounds[place + 1]):
            group = ranks[k]
            seat = seats[group]
            out[seat] = waiting[k]
            seats[group] = seat + 1
        at += 1
        if at == n:
            return np.array(out, np.int64)
        place = out[at]
