"""Operator 3: mixing sources to target weights by subset-sum budget fitting.

Each source's share of the budget follows its weight, is capped at a multiple of the source's own size, and what a
capped source leaves is shared again by weight, until none is above its cap (an aggregate a round; a row a source).
A source first takes whole copies of all its documents; for the rest of its target, documents are counted by exact
length and a bounded knapsack (subset sums over lengths with counts) finds the numbers of each length whose sum is
nearest to the budget. Of each length, the wanted number of documents is taken in the order of a seeded hash.

The knapsack starts from a proportional part of every length and fits the words that are left. Its sum is taken only when
it is proven nearest: no sum can be nearer than the nearest multiple of the lengths' greatest common divisor. Where that
isn't reached, four times as many words are left to it. Where documents are few and so long that this would take arrays as long as
they, sums are listed instead of marked: `FEW` documents, half of them taken and half not, are chosen anew by the two lists of
the sums of either half (all documents, where there are no more; then the nearest of those sums is the nearest there is).

Scale: only (source, length) counts reach one task, one source at a time - never its documents. The hash order within
a (source, length) group is worked out over slices of the hash range of about `SLICE` rows each, so a group that holds
a third of all rows is ranked by many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are kept
in whole copies only; rows are told apart by a hash of all fields, nulls included; rows equal in every field share one
entry whose copies are added up; a text of any length is one count; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import fresh, row_digest, written
from quirefold.operators.sampling import numbered

WEIGHTS = (3, 1, 2)
SLICE = 1000
#: So many words of a budget are left to subset sums at first.
WINDOW = 1 << 16
#: From so many words on, sums of few documents are tried first; documents (or powers of two of copies) that two lists hold.
WIDEST, FEW = 1 << 22, 34


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size.

    Weights go by the sources' order, which is numbered without a window over all of them; the level that uncapped sources
    share is found by a sum a round, so there may be as many sources as the web has domains.
    """
    ordered = sizes.withColumn("place", F.struct(F.col("source").isNull().alias("last"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")))
    ranked = numbered(ordered, "place", name="rank").drop("place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("w", weight).drop("rank").withColumn("most", F.col("source_size") * F.lit(float(cap))), "mix-sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = 0.0, -1
    while True:
        full = F.col("most") < F.col("w") * F.lit(level)
        found = ranked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("used"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if found["n"] == capped or not found["open"]:
            break
        capped, level = found["n"], (total - (found["used"] or 0.0)) / found["open"]
    return ranked.select("source", "source_size", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length come nearest to the budget in words."""
    take, some = np.zeros(len(lengths), np.int64), lengths * counts > 0
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    unit = int(np.gcd.reduce(lengths[some]))
    low = min(budget // unit, total // unit) * unit
    least = min(abs(budget - low), abs(min(low + unit, total) - budget))
    window, pieces = WINDOW, int(sum(int(c).bit_length() for c in counts[some]))
    if budget > window and pieces <= FEW:
        return _by_halves(lengths, counts, budget)
    while True:
        if window >= WIDEST:
            for attempt in range(16):
                found = _from_few(lengths, counts, budget, attempt)
                if abs(int((found * lengths).sum()) - budget) == least:
                    return found
        found = _from_part(lengths, counts, budget, window) if budget > window else _subset(lengths, counts, budget)
        if budget <= window or abs(int((found * lengths).sum()) - budget) == least:
            return found
        window *= 4


def _from_part(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """A proportional part of each length, and subset sums for the last `window` words."""
    total = int((lengths * counts).sum())
    share = min(1.0, (budget - window) / total)  # what is left is enough to choose from
    take = np.minimum(counts, np.floor(counts * share).astype(np.int64))
    left = budget - int((take * lengths).sum())
    for i in np.lexsort((-lengths, np.floor(counts * share) - counts * share)):
        if lengths[i] and take[i] < counts[i] and lengths[i] <= left - window:
            more = min(int(counts[i] - take[i]), (left - window) // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    return take + _subset(lengths, counts - take, left)


def _by_halves(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """`_subset` for few items: the sums of either half of them are listed, and pairs of sums compared."""
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero(lengths * counts > 0).tolist():
        room, some = int(counts[i]), 1
        while room > 0:
            items.append((i, min(some, room)))
            room, some = room - items[-1][1], some * 2
    halves = [items[::2], items[1::2]]
    sums = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
    for k, half in enumerate(halves):
        for i, n in half:
            sums[k] = np.concatenate([sums[k], sums[k] + n * int(lengths[i])])
    order = np.argsort(sums[1], kind="stable")
    known, want = sums[1][order], budget - sums[0]
    at = np.searchsorted(known, want)
    best = min(((abs(total - budget), total, a, b) for near in (np.maximum(at - 1, 0), np.minimum(at, len(known) - 1)) for total, a, b in [_nearest(sums[0] + known[near], near, budget)]), key=lambda x: x[:2])
    out = np.zeros(len(lengths), np.int64)
    for half, chosen in zip(halves, (best[2], int(order[best[3]])), strict=True):
        for bit, (i, n) in enumerate(half):
            out[i] += n * (chosen >> bit & 1)
    return out


def _nearest(totals: np.ndarray, partner: np.ndarray, budget: int) -> tuple[int, int, int]:
    """The total nearest to the budget (of two as near, the smaller), its place, and its partner."""
    a = int(np.lexsort((totals, np.abs(totals - budget)))[0])
    return int(totals[a]), a, int(partner[a])


def _from_few(lengths: np.ndarray, counts: np.ndarray, budget: int, attempt: int) -> np.ndarray:
    """A proportional part of each length up to half the words of FEW documents, other ones in each attempt, which are chosen
    by their sums for the rest."""
    order = np.random.default_rng(attempt).permutation(np.flatnonzero(lengths * counts > 0))
    free = np.zeros(len(lengths), np.int64)
    while free.sum() < FEW and (free < counts)[order].any():
        some = order[free[order] < counts[order]][: FEW - int(free.sum())]
        free[some] += 1
    rest = counts - free
    goal = max(0, budget - int((free * lengths).sum()) // 2)
    take = np.floor(rest * min(1.0, goal / max(1, int((rest * lengths).sum())))).astype(np.int64)
    goal -= int((take * lengths).sum())
    for i in order.tolist():
        more = min(int(rest[i] - take[i]), max(goal, 0) // int(lengths[i]))
        take[i] += more
        goal -= more * int(lengths[i])
    return take + _by_halves(lengths, free, budget - int((take * lengths).sum()))


def _subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the numbers of each length whose sum is nearest to the budget (of two as near, the smaller)."""
    out = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return out
    top = 2 * budget  # above it, nothing at all is nearer
    first = np.full(top + 1, -1, np.int32)  # the item by which a sum was first reached
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, room, some = int(lengths[i]), int(counts[i]), 1
        room = min(room, top // length) if length else 0
        while room > 0 and not reached[budget]:
            n = min(some, room)
            room, some, weight = room - n, some * 2, n * length
            new = np.flatnonzero(reached[: top + 1 - weight] & ~reached[weight:]) + weight
            first[new], reached[new] = len(items), True
            items.append((int(i), n))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[first[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = group["__size"].to_numpy(np.int64), group["__count"].to_numpy(np.int64)
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    whole = int(target // size) if size else 1
    take = fit(lengths, counts, round(target) - whole * size if size else 0)
    return group.assign(__whole=whole, __take=take)[["__source", "__size", "__count", "source_size", "target", "__whole", "__take"]]


def mixed(docs: DataFrame, size: Column, copies: str, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", **shares) -> DataFrame:
    """docs with their size, their source's size and target, and the column `copies`: how often the mix takes the row (0, 1
    or 2). docs has none of the columns size, source_size and target; rows that are equal are interchangeable."""
    s, n, h, slice_, rank, before = fresh(docs, "s", "n", "h", "slice", "rank", "before")
    rows = docs.withColumns({"size": size, h: row_digest(docs, seed)})
    counts = rows.groupBy(F.col(source_col).alias("__source"), F.col("size").alias("__size")).agg(F.count(F.lit(1)).alias("__count"))
    goals = targets(written(counts.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("__size") * F.col("__count")).alias("source_size")), "mix-goals"), **shares)
    planned = counts.join(goals, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    kind = docs.schema[source_col].dataType.simpleString()
    plan = planned.groupBy("__source").applyInPandas(_fit_source, f"__source {kind}, __size long, __count long, source_size long, target double, __whole int, __take long")
    plan = written(plan, "mix-plan").withColumnsRenamed({"__source": s, "__size": n})
    rows = rows.join(plan, F.col(source_col).eqNullSafe(F.col(s)) & (F.col("size") == F.col(n))).drop(s, n)
    rows = rows.withColumn(slice_, F.pmod(F.shiftrightunsigned(h, 20), (F.col("__count") / SLICE).cast("long") + 1))
    in_slice = rows.groupBy(F.col(source_col).alias(s), F.col("size").alias(n), F.col(slice_).alias("l")).agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy(s, n).orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_slice.select(s, n, "l", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias(before)).where(F.col(before) > 0)
    same = F.col(source_col).eqNullSafe(F.col(s)) & (F.col("size") == F.col(n)) & (F.col(slice_) == F.col("l"))
    order = Window.partitionBy(source_col, "size", slice_).orderBy(h, id_col)
    ranked = rows.withColumn(rank, F.row_number().over(order)).join(offsets, same, "left")
    taken = F.col("__whole") + (F.col(rank) + F.coalesce(before, F.lit(0)) <= F.col("__take")).cast("int")
    return ranked.withColumn(copies, taken).select(*docs.columns, "size", "source_size", "target", copies)


def mix_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 1, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; no text is shuffled."""
    # words are counted once; what follows reads the few bytes a row that this writes
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words"), row_digest(docs).alias("a")), "mix-sizes")
    found = mixed(rows, F.col("words"), "copies", seed, **shares)
    return found.select("doc_id", "size", "source_size", "target", (F.col("words") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 1, **shares) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as it is taken.

    The plan is made on rows without text, known by two hashes of all their fields; texts are shuffled once, for the
    join with the number of copies. Rows equal in every field share one entry: their copies are added up.
    """
    a, b, copies, copy = fresh(docs, "a", "b", "copies", "copy")
    marks = {a: row_digest(docs), b: row_digest(docs, 2)}
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words"), *(v.alias(k) for k, v in marks.items()))
    found = mixed(written(narrow, "mix-rows"), F.col("words"), copies, seed, **shares)
    found = written(found.groupBy(a, b).agg(F.sum(copies).alias(copies), F.count(F.lit(1)).alias("rows")).where(F.col(copies) > 0), "mix-copies")
    marked = docs.withColumns(marks)
    if not found.where("rows > 1").isEmpty():
        marked = marked.dropDuplicates(list(marks))
    taken = marked.join(found.drop("rows"), list(marks))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)
