"""Error rates of transcriptions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.blocks import ahead, matched
from quirefold.functions.markup import openers
from quirefold.functions.text import trim_u


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences by bit vectors (Hyyro 2001): a column of the table is two integers."""
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        x = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(x | up)) & full, up & x
    return score


def _banded(a: Sequence, b: Sequence, k: int) -> int:
    """The distance where it is at most k, else some larger number, by vectors of the 2k + 1 rows around the diagonal.

    k is no less than the difference of the lengths. Column j holds rows j - k to j + k, so the vectors slide down by a row
    a column (Hyyro 2003). Rows above the first and below the last are there as rows that match nothing; what those below
    the last add is taken off again at the end.
    """
    m, n, width = len(a), len(b), 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}  # of an item its rows in the window, and the column that this is as of
    for i, x in enumerate(a[:k]):
        where[x] = where.get(x, (0, 0))[0] | 1 << (k + 1 + i), 0
    plus, minus, score, none = full >> k << k, 0, k, (0, 0)
    for j, y in enumerate(b, 1):
        if j + k <= m:
            x = a[j + k - 1]
            rows, since = where.get(x, none)
            where[x] = rows >> (j - since) | top, j
        rows, since = where.get(y, none)
        eq = rows >> (j - since)
        x = ((eq & plus) + plus ^ plus) & full | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        if not x & top:
            score += 1
            if score > 2 * k + n - m:
                return score
        x >>= 1
        plus, minus = (down | ~(x | up)) & full, up & x
    low = m - n + k
    return score - ((plus & ~top) >> low).bit_count() + ((minus & ~top) >> low).bit_count()


#: A run of this length ends a search for edits, which takes so many of them at most.
RUN, EDITS = 8, 16
#: Neighbouring groups of edits that are proven together.
GROUPS = 6


def _next_run(a: str, i: int, b: str, j: int) -> tuple[int, int, int, int]:
    """Number of edits from a[i] and b[j] on to where a run begins, its place in a, and the places in both where it ends. If no
    run is found, to as far as the edits reach.

    One edit is tried first. Then the places that n edits reach are kept by diagonal, the farthest of each (Ukkonen 1985).
    """
    m, n = len(a), len(b)
    before, after = a[i : i + RUN], b[j : j + RUN]
    skipped, added = a[i + 1 : i + 1 + RUN], b[j + 1 : j + 1 + RUN]
    for x, y, same in ((i + 1, j + 1, skipped == added), (i + 1, j, skipped == after), (i, j + 1, before == added)):
        if same and x + RUN <= m and y + RUN <= n:
            run = RUN + ahead(a, x + RUN, b, y + RUN, min(m - x, n - y) - RUN)
            return 1, x, x + run, y + run
    reach = {0: i}
    for edits in range(1, EDITS + 1):
        found, far = None, {}
        for d in range(-edits, edits + 1):
            x = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            y = x - i + j + d
            if x < i or y < j or x > m or y > n:
                continue
            run = ahead(a, x, b, y, min(m - x, n - y)) if x < m and y < n and a[x] == b[y] else 0
            far[d] = x + run
            if (run >= RUN or x + run == m or y + run == n) and (found is None or run > found[2] - found[1]):
                found = edits, x, x + run, y + run
        if found:
            return found
        reach = far
    d, x = max(reach.items(), key=lambda place: 2 * place[1] + place[0])
    return EDITS, x, x, x - i + j + d


def _some_edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """Edits that make b of a, in groups: where a group begins and ends in a, and how many it has. They are taken as they come,
    so fewer might do."""
    i = j = ahead(a, 0, b, 0, min(len(a), len(b)))
    groups = []
    while i < len(a) and j < len(b):
        edits, end, x, y = _next_run(a, i, b, j)
        groups.append((i, end, edits))
        i, j = x, y
    if rest := len(a) - i + len(b) - j:
        groups.append((i, len(a), rest))
    return groups


def _nearest(piece: str, text: str) -> int:
    """The least edit distance of the piece from any part of the text (Myers 1999)."""
    where: dict = {}
    for i, x in enumerate(piece):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(piece)) - 1, 1 << (len(piece) - 1)
    plus, minus, score = full, 0, len(piece)
    least = score
    for y in text:
        eq = where.get(y, 0)
        x = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        score += bool(up & top) - bool(down & top)
        least = min(least, score)
        up, down = up << 1, down << 1
        plus, minus = (down | ~(x | up)) & full, up & x
    return least


def _far(piece: str, text: str, due: int) -> bool:
    """Whether every part of the text is at least due edits from the piece. A nearer one has one of due parts of the piece as it
    is, so only the places around those are compared."""
    size = len(piece)
    cuts = [size * n // due for n in range(due + 1)]
    starts = set()
    for low, high in zip(cuts, cuts[1:]):
        at = text.find(piece[low:high])
        while at >= 0:
            starts.add(at - low)
            at = text.find(piece[low:high], at + 1)
    spans: list[list[int]] = []
    for start in sorted(starts):
        low, high = max(start - due, 0), start + size + due
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    return all(_nearest(piece, text[low:high]) >= due for low, high in spans)


def _absent(a: str, b: str, left: int, right: int, low: int, begin: int, end: int, wanted: int) -> tuple[int, int]:
    """How many pieces of a from low on, as many as wanted at most, b doesn't have near them, and where the last one ends. Each
    ends in the edits between begin and end, or as soon after them as it must."""
    found, there = 0, max(low, begin)
    while found < wanted and there < len(a) and (there < end or there == begin):
        high, step = there + 1, 1
        while high < len(a) and b.find(a[low:high], max(low - left, 0), high + right) >= 0:
            there, step = high, 2 * step
            high = min(high + step, len(a))
        if b.find(a[low:high], max(low - left, 0), high + right) >= 0:
            break
        while high - there > 1:
            middle = (there + high) // 2
            if b.find(a[low:middle], max(low - left, 0), middle + right) >= 0:
                there = middle
            else:
                high = middle
        found, low, there = found + 1, high, high
    return found, low


def _needed(a: str, b: str, groups: list[tuple[int, int, int]]) -> bool:
    """Whether b can't be made of a with fewer edits than the groups have.

    a is cut into pieces. With no more edits than that, each piece becomes a part of b that lies about where it lay itself.
    A piece that b doesn't have there takes an edit; of a longer one the nearest part of b tells how many. A piece begins
    where the one before ends and is as short as can be.
    """
    most, more = sum(edits for _, _, edits in groups), len(b) - len(a)
    left, right = (most - more) // 2, (most + more) // 2
    low = at = 0
    while at < len(groups):
        start, due, g = low, 0, at
        while True:  # groups that are short of pieces are taken together with those after them
            begin, end, edits = groups[g]
            g, due = g + 1, due + edits
            if g - at == 1:
                found, low = _absent(a, b, left, right, start, begin, end, edits)
                if found == edits:
                    break
            follows = groups[g][0] if g < len(groups) else len(a)
            low = (end + follows) // 2 if g < len(groups) else len(a)
            if low - start >= due and _far(a[start:low], b[max(start - left, 0) : low + right], due):
                break
            if g == len(groups) or g - at == GROUPS:
                return False
        at = g
    return True


#: From here on a band around the diagonal is tried first; wide enough for a distance of a tenth of the length.
LONG, PART = 1024, 10
#: Texts below this length aren't worth a search for edits.
SHORT = 64


def _distance(a: Sequence, b: Sequence) -> int:
    """`edit_distance`, in time that follows the distance where long sequences differ in little."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    k = max(len(b) - len(a), len(a) // PART)
    while len(a) >= LONG and 3 * k < len(a):
        if (found := _banded(a, b, k)) <= k:
            return found
        k *= 2
    return edit_distance(a, b)


def _alike(a: Sequence, b: Sequence) -> int:
    """How many items the two have in common from the start, by halving: a comparison of slices is one call."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trimmed_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance. Of texts, edits are taken as they come; where they are proven to be needed, that is all. Else what is left
    between a common start and a common end, which cost nothing, is compared."""
    if isinstance(a, str) and min(len(a), len(b)) >= SHORT:
        long, short = (f"\0{x}\0" for x in ((a, b) if len(a) >= len(b) else (b, a)))  # so that edits at an end lie inside
        groups = _some_edits(long, short)
        if _needed(long, short, groups):
            return sum(edits for _, _, edits in groups)
    n = _alike(a, b)
    a, b = a[n:], b[n:]
    n = _alike(a[::-1], b[::-1])
    return _distance(a[: len(a) - n], b[: len(b) - n])


def _distance_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else trimmed_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def distance(a: Column, b: Column) -> Column:
    """Edit distance by code points, of texts of any length; equal texts don't leave the JVM."""
    unlike = a != b
    return F.when(a == b, F.lit(0).cast("long")).otherwise(F.pandas_udf(_distance_series, "long")(F.when(unlike, a), F.when(unlike, b)))


def _cer_series(truth: pd.Series, guess: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([k if x is None or y is None else trimmed_distance(x, y) / len(x) for x, y, k in zip(truth, guess, known, strict=True)], dtype="float64")


def cer(truth: Column, guess: Column) -> Column:
    """Edit distance by characters over the length of the truth, both trimmed; may exceed 1.

    Texts that are equal, or of which one is missing or the truth is empty, don't leave the JVM. The function gives the rate
    itself: what it is computed of would be trimmed again for every mention above it.
    """
    truth, guess = trim_u(truth), trim_u(guess)
    known = F.when(truth == guess, 0.0).when(F.length(truth) == 0, 1.0)
    asked = (truth != guess) & (F.length(truth) > 0)
    return F.pandas_udf(_cer_series, "double")(F.when(asked, truth), F.when(asked, guess), known)


def _wer(truth: str | None, guess: str | None) -> float | None:
    if truth is None or guess is None:
        return None
    truth, guess = truth.split(), guess.split()
    return trimmed_distance(truth, guess) / len(truth) if truth else float(bool(guess))


def _wer_series(truth: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series(map(_wer, truth, guess), dtype="float64")


def wer(truth: Column, guess: Column) -> Column:
    """Edit distance by words over the number of words of the truth. Spark has no edit distance of arrays."""
    return F.pandas_udf(_wer_series, "double")(truth, guess)


def _unmatched(truth: str | None, guess: str | None) -> float | None:
    if truth is None or guess is None:
        return None
    return 1 - matched(guess, truth) / max(len(truth), 1)


def _unmatched_series(truth: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series(map(_unmatched, truth, guess), dtype="float64")


def unmatched_share(truth: Column, guess: Column) -> Column:
    """One less the share of the truth in matching blocks: a diagnostic, not an edit distance."""
    return F.pandas_udf(_unmatched_series, "double")(truth, guess)


def tag_accuracy(truth: Column, guess: Column) -> Column:
    """Share of the truth's opening and lone tags that the guess has as well, name by name; null where the truth has none."""
    asked, given = openers(truth), openers(guess)
    times = lambda tags, name: F.size(F.filter(tags, lambda t: t == name))
    found = F.aggregate(F.array_distinct(asked), F.lit(0), lambda total, name: total + F.least(times(asked, name), times(given, name)))
    return F.when(F.size(asked) > 0, found / F.size(asked))
