"""Matching blocks of two texts, as difflib finds them, with its rule for popular characters and its ties.

difflib looks for the longest common run of characters that aren't popular (in a second text of 200 characters or more,
those that make up more than a hundredth of it), the first of several in either text, lengthens it by what is equal around it, and goes on
left and right of it. Its search reads a part once for every block found in it, which is quadratic in the text. Here the runs of
either text are listed by length once: a part left of a block holds no run as long as the block's, a part right of it none
before it, so every entry of the lists is looked at once. Texts whose lists would outgrow them are searched as difflib does,
or, where characters have very many places, by a suffix automaton of the second text's part.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

#: Comparisons per character beyond which the automaton is worth its building.
MANY = 24


class Suffixes:
    """Suffix automaton of a text; a run never crosses a character of `apart`."""

    def __init__(self, text: str, apart: frozenset[str] = frozenset()):
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            last = 0 if c in apart else self._add(last, c, at)

    def _state(self, edges: dict[str, int], link: int, size: int, end: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.edges) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        """The state of the runs that end in c from p on: q itself, or a part of it with the same first end."""
        if self.size[p] + 1 == self.size[q]:
            return q
        part = self._state(dict(self.edges[q]), self.link[q], self.size[p] + 1, self.end[q])
        self.link[q] = part
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = part
            p = self.link[p]
        return part

    def _add(self, last: int, c: str, at: int) -> int:
        if c in self.edges[last]:  # after a cut: the run is there already
            return self._split(last, self.edges[last][c], c)
        new, p = self._state({}, 0, self.size[last] + 1, at), last
        while p >= 0 and c not in self.edges[p]:
            self.edges[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.edges[p][c], c)
        return new

    def longest(self, text: str) -> tuple[int, int, int]:
        """Start in text, start in the automaton's text and length of the longest common run: the first in text, and of that the
        first in the automaton's text."""
        state, size, best = 0, 0, (0, 0, 0)
        for i, c in enumerate(text):
            while state and c not in self.edges[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.edges[state]:
                state, size = self.edges[state][c], size + 1
                if size > best[2]:
                    best = (i - size + 1, self.end[state] - size + 1, size)
            else:
                size = 0
        return best


def _runs(a: str, b: str, popular: frozenset[str]) -> list[tuple[list[int], dict[str, list[int]]]] | None:
    """Of every length, from 1 on, the places in a of common runs without popular characters, and the places in b of each;
    None where they are more than the texts' characters."""
    levels, size, most = [], 0, len(a) + len(b)
    where: dict[str, list[int]] = {c: [] for c in set(a).intersection(b) - popular}
    starts = [i for i, c in enumerate(a) if c in where]
    spots = [j for j, c in enumerate(b) if c in where]
    for j in spots:
        where[b[j]].append(j)
    while starts:
        levels.append((starts, where))
        size, most = size + 1, most - len(starts) - len(spots)
        if most < 0:
            return None
        ahead = [i for i, after in zip(starts, starts[1:]) if after == i + 1]
        where = {a[i : i + size + 1]: [] for i in ahead}
        spots = [j for j, after in zip(spots, spots[1:]) if after == j + 1 and b[j : j + size + 1] in where]
        for j in spots:
            where[b[j : j + size + 1]].append(j)
        starts = [i for i in ahead if where[a[i : i + size + 1]]]
    return levels


def ahead(a: Sequence, i: int, b: Sequence, j: int, most: int) -> int:
    """How many items from a[i] and b[j] on are equal, up to most: steps that double, then halve."""
    n, step = 0, 16
    while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    while step := step // 2:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return n


def _behind(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters before a[i] and b[j] are equal, up to most."""
    n, step = 0, 16
    while n + step <= most and a[i - n - step : i - n] == b[j - n - step : j - n]:
        n, step = n + step, 2 * step
    while step := step // 2:
        if n + step <= most and a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
    return n


def _matched_by(levels: list[tuple[list[int], dict[str, list[int]]]], a: str, b: str) -> int:
    """Characters in the matching blocks, of the lists of runs. A part comes with the length that its runs don't exceed."""
    total, parts = 0, [(0, len(a), 0, len(b), len(levels))]
    while parts:
        alo, ahi, blo, bhi, size = parts.pop()
        size, i, j = min(size, ahi - alo, bhi - blo), alo, blo
        while size:
            starts, where = levels[size - 1]
            at, i, j = bisect_left(starts, alo), alo, -1
            while at < len(starts) and (i := starts[at]) <= ahi - size:
                spots = where[a[i : i + size]]
                first = bisect_left(spots, blo)
                if first < len(spots) and spots[first] <= bhi - size:
                    j = spots[first]
                    break
                at += 1
            if j >= 0:
                break
            size -= 1
            i, j = alo, blo
        before = _behind(a, i, b, j, min(i - alo, j - blo))
        after = ahead(a, i + size, b, j + size, min(ahi - i, bhi - j) - size)
        total += before + size + after
        if size and alo < i - before and blo < j - before:
            parts.append((alo, i - before, blo, j - before, size - 1))
        if size and i + size + after < ahi and j + size + after < bhi:
            parts.append((i + size + after, ahi, j + size + after, bhi, size))
    return total


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of `difflib.SequenceMatcher(None, a, b)`."""
    if a == b:
        return len(a)
    count = Counter(b)
    popular = frozenset(c for c, n in count.items() if n > len(b) // 100 + 1) if len(b) >= 200 else frozenset()
    if len(b) >= 200 and (levels := _runs(a, b, popular)) is not None:
        return _matched_by(levels, a, b)
    met = sum(n * count[c] for c, n in Counter(a).items() if c not in popular)
    if met <= MANY * (len(a) + len(b)):
        return sum(block.size for block in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    total, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        i, j, size = Suffixes(b[blo:bhi], popular).longest(a[alo:ahi])
        i, j = (i + alo, j + blo) if size else (alo, blo)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                parts.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                parts.append((i + size, ahi, j + size, bhi))
    return total
