"""Operator 6: toxicity by class-conditional Kneser-Ney models, compared over a text's `TOP` most telling words.

Two models, one of toxic and one of ordinary text, spell every word as a path from the root: its first `PREFIXES[0]`
letters, its first `PREFIXES[1]`, the whole word. A unit's probability under its parent is

    P(unit | parent) = (max(c(unit) - D, 0) + left(parent) * S(unit | parent)) / c(parent)

c is the Kneser-Ney count of the class: in how many contexts (different words before) the unit was seen; D = `DISCOUNT`;
left(parent) is the mass that discounts took from the parent's units, all of it where the class never saw the parent.
S, the shared backoff, is the same in both models: from the documents that each word of the whole corpus occurs in,
labelled or not; 1 / (n + 1) of it is kept for units that no document holds. So every level of either model adds up to 1,
and an expression that a class has seen in few contexts falls back to what all documents say of it.

A word's evidence is the difference of its two log-probabilities. A document is as toxic as its most toxic expressions:
the `TOP` words that differ most, normalised by their number, so that length and ordinary text around them don't dilute
it. One logistic curve, fitted on a fifth of the sample that the counts leave out, maps that one figure to the score; an
ordinary row weighs 1 / `COST` of a toxic one there. (Pairs of words enter as contexts only. A level of pairs above the
words was measured and lowers the held-out ranking: it remembers ordinary sentences of few toxic texts.)

The sample is at most `MAX_ROWS` labelled rows, the first in hash order, and `MAX_BYTES` bytes of text (a text that doesn't
fit costs only itself); equal texts are one, toxic if any of them is.
The model holds units with more than D contexts in a class; all others have exactly the backed-off probability, so they
need no entry. It is bounded by the sample, whatever the size of the corpus; the shared counts are a written table that
grows with the corpus, of which the model's units are looked up.

Defined cases: null, empty and blank texts have no evidence (0); a text of fewer words than `TOP` is normalised by its
own number; a text of any length is taken in parts of about a megabyte, a longer one alone; with labels of one class
only, or none, every score is the base rate (0 where there is none). Reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import tidy, written
from quirefold.llm.labelled import fold, training_rows
from quirefold.llm.words import U, Words, buffer_of, chunks, hashes, mix, split

MAX_ROWS, MAX_BYTES, THRESHOLD = 20_000, 64 << 20, 0.5
DISCOUNT, TOP, COST = 2, 3, 4
PREFIXES = (4, 6)
LEVELS = len(PREFIXES) + 1
ROOT = np.uint64(1)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A task's counts are handed on when they reach this many units.
TALLY = 1 << 20


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each text of a part of a column: number of words before it; for each word a hash of its unit at every level, and
    of the pair with the word before it (the start of the text counts as one)."""
    data = data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    data[second] += 32  # capital letters of Latin-1
    words = split(data, offsets)
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):  # marks around a word don't make another word
        starts += (~_ALNUM[data[np.minimum(starts, len(data) - 1)]]) & (ends - starts > 1)
        ends -= (~_ALNUM[data[ends - 1]]) & (ends - starts > 1)
    letters = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    at = np.searchsorted(letters, starts)
    cuts = [np.minimum(ends, letters[np.minimum(at + k, len(letters) - 1)]) for k in PREFIXES]
    found = [hashes(Words(data, starts, np.maximum(end, starts + 1), words.first), lower=True) + U(i) for i, end in enumerate([*cuts, ends])]
    word = found[-1]
    before = np.concatenate([word[:1], word[:-1]])
    before[words.first[:-1][words.sizes > 0]] = ROOT
    return words.first, found, mix(before * U(0x9E3779B97F4A7C15) + word)


def _parts(column: pa.Array):
    data, offsets = buffer_of(column)
    for a, b in chunks(offsets):
        yield a, b, units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Models:
    keys: list[np.ndarray]  #: sorted units of each level
    gain: list[np.ndarray]  #: of each unit the difference of the two log-probabilities under its parent
    back: list[np.ndarray]  #: of each unit the same difference for the units under it that have no entry
    root: float  #: the same under the root
    weights: tuple[float, float] = (0.0, 1.0)  #: of the logistic curve

    def evidence(self, column: pa.Array) -> np.ndarray:
        """The length-normalised difference of log-likelihoods of each text's most telling words."""
        out = [_strongest(self.gains(levels), first) for _, _, (first, levels, _) in _parts(column)]
        return np.concatenate(out) if out else np.zeros(0)

    def gains(self, levels: list[np.ndarray]) -> np.ndarray:
        n = len(levels[0])
        total, open_, back = np.zeros(n), np.ones(n, bool), np.full(n, self.root)
        for keys, gain, more, want in zip(self.keys, self.gain, self.back, levels, strict=True):
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = open_ & (keys[at] == want) if len(keys) else np.zeros(n, bool)
            total += np.where(hit, gain[at] if len(keys) else 0.0, np.where(open_, back, 0.0))
            back, open_ = np.where(hit, more[at] if len(keys) else 0.0, 0.0), hit
        return total

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * self.evidence(column), -30, 30)))


def _strongest(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of each text's TOP largest gains; 0 without words."""
    size = np.diff(first)
    out, full = np.zeros(len(size)), np.flatnonzero(size)
    if not len(full):
        return out
    gain, at, doc = gain.copy(), first[:-1][full], np.repeat(np.arange(len(full)), size[full])
    total, place = np.zeros(len(full)), np.arange(len(gain))
    for _ in range(TOP):
        best = np.maximum.reduceat(gain, at)
        total += np.where(np.isfinite(best), best, 0)
        gain[np.minimum.reduceat(np.where(gain == best[doc], place, len(gain)), at)] = -np.inf
    out[full] = total / np.minimum(size[full], TOP)
    return out


def _contexts(rows: DataFrame) -> DataFrame:
    """y, pair and the units of its second word: once for each class and context."""

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b, (first, levels, pair) in _parts(batch.column(0)):
                label = y[a:b].repeat(np.diff(first))
                _, one = np.unique(pair ^ label.astype(np.uint64), return_index=True)
                columns = [pa.array(label[one], pa.int32()), *(pa.array(v[one].view(np.int64)) for v in (pair, *levels))]
                yield pa.RecordBatch.from_arrays(columns, ["y", "pair", *(f"u{i}" for i in range(LEVELS))])

    pieces = rows.select("text", "y").mapInArrow(run, "y int, pair long, " + ", ".join(f"u{i} long" for i in range(LEVELS)))
    return pieces.dropDuplicates(["y", "pair"])


def class_counts(rows: DataFrame) -> DataFrame:
    """level, unit, parent, and its contexts in toxic and ordinary text, of rows text, y."""
    counts = (F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("ordinary"))
    up = [F.first(f"u{i}").alias(f"u{i}") for i in range(LEVELS - 1)]
    words = written(_contexts(rows).groupBy(f"u{LEVELS - 1}").agg(*up, *counts), "toxic-words")
    root = F.lit(int(ROOT)).alias("u-1")
    sums = (F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = None
    for i in range(LEVELS):
        level = words.groupBy(f"u{i}").agg(F.first(f"u{i - 1}").alias("parent") if i else root.alias("parent"), *sums)
        level = level.select(F.lit(i).alias("level"), F.col(f"u{i}").alias("unit"), "parent", "toxic", "ordinary")
        found = level if found is None else found.unionAll(level)
    return found


def _tallied(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums counts by unit, in bounded memory: what reaches TALLY units is handed on."""
    units_, counts, size = [], [], 0

    def summed():
        unit, back = np.unique(np.concatenate(units_), return_inverse=True)
        return unit, np.bincount(back, np.concatenate(counts), len(unit)).astype(np.int64)

    for unit, n in parts:
        units_.append(unit)
        counts.append(n)
        size += len(unit)
        if size > 2 * TALLY:
            unit, n = summed()
            if len(unit) > TALLY:
                yield unit, n
                units_, counts, size = [], [], 0
            else:
                units_, counts, size = [unit], [n], len(unit)
    if units_:
        yield summed()


def shared_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """unit and n: for words the documents that hold them, for the units above, and the root, the sum of their words' figures."""

    def run(batches):
        def parts():
            for batch in batches:
                for _, _, (first, levels, _) in _parts(batch.column(0)):
                    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
                    _, one = np.unique(mix(levels[-1] + doc * U(0xD1342543DE82EF95)), return_index=True)
                    yield np.array([ROOT]), np.array([len(one)])
                    for values in levels:
                        yield np.unique(values[one], return_counts=True)

        for unit, n in _tallied(parts()):
            for low in range(0, len(unit), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(unit[low : low + (1 << 16)].view(np.int64)), pa.array(n[low : low + (1 << 16)])], ["unit", "n"])
        tidy()

    return docs.select(text_col).mapInArrow(run, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model's units (level, unit, parent, toxic, ordinary, and the discounted mass of what is under them), with the
    shared count n; and the same two masses and sums for the root."""
    taken = [F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"left_{c}") for c in ("toxic", "ordinary")]
    under = counts.groupBy((F.col("level") - 1).alias("level"), F.col("parent").alias("unit")).agg(*taken)
    own = counts.where((F.col("toxic") > DISCOUNT) | (F.col("ordinary") > DISCOUNT))
    known = own.join(under.where("level >= 0"), ["level", "unit"], "left").fillna(0, ["left_toxic", "left_ordinary"]).join(shared, "unit", "left").fillna(0, ["n"])
    root = counts.where("level = 0").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), *taken)
    return known, root


def probabilities(c: np.ndarray, total: np.ndarray, left: np.ndarray, share: np.ndarray) -> np.ndarray:
    """P(unit | parent) of one class; where the class never saw the parent, the shared backoff alone."""
    seen = total > 0
    return np.where(seen, (np.maximum(c - DISCOUNT, 0) + left * share) / np.maximum(total, 1), share)


def _backed_off(total: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The factor that a class gives the shared backoff under each unit."""
    return np.where(total > 0, left / np.maximum(total, 1), 1.0)


def kneser_ney(level: np.ndarray, unit: np.ndarray, parent: np.ndarray, counts: np.ndarray, left: np.ndarray, shared: np.ndarray, root: np.ndarray, root_left: np.ndarray, everything: float) -> Models:
    """Units, gains and backoffs; counts, left, root and root_left have a row a class, the toxic one first."""
    keys, gains, backs, up = [], [], [], None
    least = 1e-12
    for i in range(LEVELS):
        some = np.flatnonzero(level == i)
        some = some[np.argsort(unit[some])]
        n = shared[some].astype(float)
        if i == 0:
            total, mass, around = np.repeat(root[:, None], len(some), 1), np.repeat(root_left[:, None], len(some), 1), np.full(len(some), float(everything))
        else:
            at = np.minimum(np.searchsorted(keys[-1], parent[some]), max(len(keys[-1]) - 1, 0))
            total, mass, around = counts[:, up][:, at], left[:, up][:, at], shared[up][at].astype(float)
        share = np.maximum(n, 1) / (np.maximum(around, n) + 1)
        p = np.stack([probabilities(counts[c][some], total[c], mass[c], share) for c in (0, 1)])
        b = np.maximum(np.stack([_backed_off(counts[c][some], left[c][some]) for c in (0, 1)]), least)
        keys.append(unit[some])
        gains.append(np.log(np.maximum(p[0], least)) - np.log(np.maximum(p[1], least)))
        backs.append(np.log(b[0]) - np.log(b[1]))
        up = some
    b = np.maximum(_backed_off(root, root_left), least)
    return Models(keys, gains, backs, float(np.log(b[0]) - np.log(b[1])))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """The logistic curve of one figure, by Newton steps; an ordinary row weighs 1 / COST."""
    mean, scale, weight = x.mean(), x.std() + 1e-9, np.where(y > 0, 1.0, 1 / COST)
    z, w, keep = np.stack([np.ones(len(x)), (x - mean) / scale], axis=1), np.zeros(2), np.array([1e-6, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * (p * (1 - p) + 1e-9))[:, None]) + np.diag(keep), z.T @ (weight * (y - p)) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Models:
    rows = training_rows(docs, labels, "toxic", max_rows, id_col, text_col, max_bytes)
    rows = written(rows.groupBy("text").agg(F.max("y").alias("y"), F.min("h").alias("h")), "toxic-sample")
    tally = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, total = tally.get(1, 0), sum(tally.values())
    if not toxic or toxic == total:
        rate = np.clip(toxic / total, 1e-12, 1 - 1e-12) if total else 1e-12
        none = [np.zeros(0)] * LEVELS
        return Models([np.zeros(0, np.uint64)] * LEVELS, none, none, 0.0, (float(np.log(rate / (1 - rate))), 0.0))
    part = F.pmod("h", F.lit(5)) == 0
    aside = {r["y"] for r in rows.where(part).select("y").distinct().collect()}
    held = rows.where(part) if len(aside) == 2 else rows  # too few to set aside: the curve is fitted on all
    counts = written(class_counts(rows.where(~part) if len(aside) == 2 else rows), "toxic-counts")
    shared = written(shared_counts(docs, text_col), "toxic-shared")
    known, root = tables(counts, shared)
    top = root.first()
    everything = shared.where(F.col("unit") == int(ROOT)).agg(F.sum("n")).first()[0] or 0
    found = known.toArrow()  # bounded by MAX_BYTES: a unit has more than DISCOUNT contexts in the sample
    column = lambda c: found[c].to_numpy()
    pair = lambda c: np.stack([column(f"{c}toxic"), column(f"{c}ordinary")]).astype(float)
    model = kneser_ney(
        column("level"), column("unit").view(np.uint64), column("parent").view(np.uint64), pair(""), pair("left_"), column("n"),
        np.array([top["toxic"], top["ordinary"]], float), np.array([top["left_toxic"], top["left_ordinary"]], float), everything,
    )

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.evidence(batch.column(0)), pa.float64()), batch.column(1)], ["x", "y"])

    found = held.select("text", "y").mapInArrow(run, "x double, y int").toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    model.weights = calibrated(found["x"].to_numpy(), found["y"].to_numpy().astype(float))
    return model


def scored(docs: DataFrame, model: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.value.score(batch.column(2)))], ["doc_id", "held_out", "score"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
