"""Operator 4: a quality classifier of histogram gradient-boosted trees over document statistics.

Each whole text gives a row of statistics (character classes, word and line lengths, repetition of words, word pairs,
word five-grams and lines, entropy), worked out with numpy on the Arrow column's bytes. Trees of fixed depth are grown
on quantile bins with logistic loss from at most `MAX_ROWS` labelled rows (the first in hash order), then flattened
into arrays: one level of all trees for all rows is two array lookups and a comparison.

Defined cases: null, empty and blank texts have statistics of their own (zero words) and a score like any other; texts
are taken in parts of about a megabyte, a longer one alone and whole, in about twenty times its bytes; a null id is
never held out; with labels of one class only, or none, every score is the base rate (0.5 where there is none). Reruns
agree: the sample goes by hash, rows are sorted before fitting, and nothing is random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import tidy
from quirefold.llm.labelled import fold, training_rows
from quirefold.llm.words import buffer_of, chunks, grams, hashes, split

MAX_ROWS = 20_000
THRESHOLD = 0.3


def _byte_classes() -> tuple[list[str], np.ndarray]:
    groups = {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32], "line": [10, 13], "tab": [9], "stop": b".", "comma": b",;:",
        "shout": b"!?", "quote": b"'\"`", "dash": b"-_", "bar": b"|", "mark": b"#$%&*+=^~@", "slash": b"/\\", "bracket": b"()[]{}", "angle": b"<>", "high": range(128, 256),
    }
    table = np.full(256, len(groups), np.uint8)
    for i, members in enumerate(groups.values()):
        table[list(members)] = i
    return [*groups, "control"], table


CLASS_NAMES, _CLASS = _byte_classes()
_UPPER, _PUNCT = CLASS_NAMES.index("upper"), [CLASS_NAMES.index(x) for x in ("shout", "bar", "mark", "quote", "dash", "slash", "bracket", "angle")]
_IS_PUNCT = np.isin(_CLASS, _PUNCT)
_BLOCK = 1 << 20


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the number of values, of distinct values, and the count of the most frequent one."""
    total = np.bincount(doc, minlength=n_docs)
    if not len(values):
        return total, total, total
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner, runs = (key[first] >> np.uint64(40)).astype(np.int64), np.diff(np.append(first, len(key)))
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, owner, runs)
    return total, np.bincount(owner, minlength=n_docs), most


def _class_counts(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class of each text, worked out over blocks of bytes, so that a very long text costs no more."""
    n, many = len(offsets) - 1, len(CLASS_NAMES)
    counts = np.zeros(n * many, np.int64)
    for at in range(0, len(kinds), _BLOCK):
        part = kinds[at : at + _BLOCK]
        low, high = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + len(part), "left")
        inside = np.diff(np.clip(offsets[low : high + 1], at, at + len(part)))
        counts[low * many : high * many] += np.bincount(np.repeat(np.arange(high - low) * many, inside) + part, minlength=(high - low) * many)
    return counts.reshape(n, many)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a part of a column."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = _CLASS[data]
    counts = _class_counts(kinds, offsets)
    columns = [np.log1p(size), *(_ratio(counts[:, i], size) for i in range(len(CLASS_NAMES)))]
    words = split(data, offsets)
    many, length = words.sizes, words.ends - words.starts
    doc = np.repeat(np.arange(n), many)
    by_doc = lambda x: np.bincount(doc, x, minlength=n)
    mean = _ratio(by_doc(length), many)
    spread = np.sqrt(np.maximum(0, _ratio(by_doc(length.astype(float) ** 2), many) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    upper = np.flatnonzero(kinds == _UPPER)
    caps = (np.searchsorted(upper, words.ends) - np.searchsorted(upper, words.starts)) * 2 > length
    columns += [np.log1p(many), mean, spread, np.log1p(longest), _ratio(by_doc(length <= 3), many), _ratio(by_doc(length > 12), many), _ratio(by_doc(caps), many)]
    columns += [_ratio(by_doc(_IS_PUNCT[data[words.ends - 1]]), many), _ratio(by_doc(_IS_PUNCT[data[words.starts]]), many), _ratio(by_doc(length == 1), many)]
    h = hashes(words, lower=True)
    for k in (1, 2, 5):
        g = grams(h, k) if k > 1 else h
        inside = doc[: len(g)] == doc[k - 1 : k - 1 + len(g)]
        total, distinct, most = _repeats(doc[: len(g)][inside], g[inside], n)
        columns += [_ratio(distinct, total), _ratio(most, total)]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    columns.append(_ratio(by_doc(again), many))
    lines_edge = np.flatnonzero(data == 10)
    line_of = np.searchsorted(lines_edge, words.starts) if len(words.starts) else np.zeros(0, np.int64)
    if len(h):
        start = np.flatnonzero(np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])]))
        line_hash = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, len(h)))).astype(np.uint64) * np.uint64(1) + np.uint64(1)), start)
        total, distinct, most = _repeats(doc[start], line_hash, n)
    else:
        total = distinct = most = np.zeros(n, np.int64)
    columns += [np.log1p(total), _ratio(many, total), _ratio(distinct, total), _ratio(most, total)]
    share = _ratio(counts, size[:, None])
    columns.append(-(share * np.log(np.maximum(share, 1e-12))).sum(axis=1))
    return np.stack(columns, axis=1).astype(np.float32)


def features(column: pa.Array) -> np.ndarray:
    data, offsets = buffer_of(column)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)


@dataclass
class Trees:
    """Complete trees of one depth: node 2i+1 follows where the feature is at most the cut, else 2i+2."""

    feature: np.ndarray  #: trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  #: trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, inner = np.arange(len(self.feature)), self.feature.shape[1]
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int64)
                for _ in range((inner + 1).bit_length() - 1):
                    node = 2 * node + 1 + (part[row, self.feature[trees, node]] > self.cut[trees, node])
                total[at : at + 4096] += self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Boosting with logistic loss over quantile bins."""
    inner, p = 2**depth - 1, float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        empty = np.zeros((0, inner))
        return Trees(empty.astype(np.int64), empty.astype(np.float32), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for c in x.T]
    width = bins + 1
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    flat = binned + np.arange(x.shape[1]) * width
    features, f, out = x.shape[1], np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        grad, hess = q - y, q * (1 - q)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            index = ((node - first)[:, None] * (features * width) + flat).ravel()
            g, h = (np.bincount(index, np.repeat(v, features), minlength=wide * features * width).reshape(wide, features, width) for v in (grad, hess))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k, at in enumerate(best):
                j, b = divmod(int(at), width)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        step = -rate * np.bincount(leaf, grad, minlength=inner + 1) / (np.bincount(leaf, hess, minlength=inner + 1) + ridge)
        f = f + step[leaf]
        out.append((feature, cut, step))
    return Trees(*(np.stack(v) for v in zip(*out, strict=True)), base)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **names) -> Trees:
    """Learns from a bounded sample of labelled rows; only their statistics reach the driver."""

    def run(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "h"])

    rows = training_rows(docs, labels, "quality", max_rows, **names).select("text", "y", "h").mapInArrow(run, "x binary, y int, h long").toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("x", "ascending")])
    if not len(rows):
        return grow(np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(rows), -1)
    return grow(x, rows["y"].to_numpy().astype(float))


def scored(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(features(batch.column(2))))], ["doc_id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_only(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns, without the rows that the classifier rejects; the rows themselves stay where they are."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= threshold))
        tidy()

    return docs.mapInArrow(run, docs.schema).select(names)
