"""Operator 7: removal of long repeated spans by compaction of a de Bruijn graph of words.

The graph's k-mers are the windows of `WINDOW` words; two windows that follow each other share a node, the words they
have in common. As in minimiser partitioned assemblers (Chikhi, Limasset, Medvedev, "Compacting de Bruijn graphs", 2016),
consecutive windows that share the place of their smallest `ANCHOR`-gram are one edge from the start, kept as source
coordinates (row, first window, number of windows), the anchor's hash, a hash of all its words, and those of the edges
before and after it in its document.

1. Edges whose anchor occurs once in the corpus repeat nothing and go (an aggregate and a join on the anchor).
2. Equal edges (anchor and content) are counted, with the smallest and largest hash of the edges before and after them:
   a node between two edges has one way in and one way out where these agree. Joined back, this tells each occurrence
   whether it continues the one before it, and runs of such occurrences are one span: nonbranching paths compact.
3. Where one anchor has several contents, each distinct content that is there once is taken apart into windows (one
   occurrence stands for the contents that are there more often). The same counts and joins on windows give their spans.
4. Every span's words, read at its source coordinates, are compared byte by byte with those of all spans that are the
   same path by hash (smallest and largest of a group: an aggregate with partial sums). Where the words of a path differ,
   hashes collided, and all is worked out again with other hashes: a collision never decides about a word. Edges and
   windows are told apart by 128 bits (anchor and content), so that this is a matter of theory.

Rows are told apart by a number that is written with them, so rows that repeat an id and a text are rows like any other.
No passage is gathered: a passage that a third of all documents share is one key of partial aggregates and of joins that
adaptive execution splits. Per row there is one list of spans, as long as its own text.

Every word in a window that also starts elsewhere - in any document, the same included - is removed; windows are
judged on the input. Defined cases: null, empty and blank texts have no words; documents of fewer than 35 words repeat
nothing; rows that repeat a document's id and text repeat all their windows; a null id is an id like any other; a very
long text is taken alone, its arrays are some forty times its bytes; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import discard, split_join, tidy, written
from quirefold.llm.words import U, Words, buffer_of, chunks, grams, hashes, mix, powers, split

WINDOW, ANCHOR = 35, 10
_BASE = 0xB5297A4D3F84D5B5
_OTHER = U(0xC2B2AE3D27D4EB4F)


def _prefix(h: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + _OTHER) * powers(_BASE, len(h)), out=sums[1:])
    return sums


def _content(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(pow(_BASE, -1, 2**64), len(sums))[a] + (b - a).astype(np.uint64))


def smallest(g: np.ndarray, n: int) -> np.ndarray:
    """The place of the leftmost smallest of every n values in a row."""
    at, size = np.arange(len(g)), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[: len(at) - step], at[step:]
        at, size = np.where(g[a] <= g[b], a, b), size + step
    return at


def paths_of(h: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """document, first window (word offset in the document), number of windows, anchor and content of every edge."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = grams(h, anchor)
    place = smallest(g, window - anchor + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(place))
    at = at[doc[at] == doc[at + window - 1]]
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    cut = np.flatnonzero((np.diff(place[at]) != 0) | (np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
    low, high = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return doc[low], low - first[doc[low]], high - low + 1, g[place[low]], _content(_prefix(h), low, high + window)


def _beside(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value before and after each one in the same document; 0 at its ends."""
    before, after = np.zeros(len(values), np.uint64), np.zeros(len(values), np.uint64)
    if len(values) > 1:
        same = doc[1:] == doc[:-1]
        before[1:][same], after[:-1][same] = values[:-1][same], values[1:][same]
    return before, after


def _signed(values: np.ndarray, bits: int) -> pa.Array:
    return pa.array((values >> U(64 - bits)).view(np.int64))


def _hashed(words: Words, salt: int) -> np.ndarray:
    h = hashes(words)
    return mix(h + U(salt) * _OTHER) if salt else h


def _edges(docs: DataFrame, window: int, anchor: int, bits: int, salt: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for a, b in chunks(offsets):
                words = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc, at, n, anchors, content = paths_of(_hashed(words, salt), words.first, window, anchor)
                values = (anchors, content, *_beside(doc, content))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), *(_signed(v, bits) for v in values)],
                    ["t", "at", "n", "anchor", "content", "before", "after"],
                )
        tidy()

    return docs.select("t", "text").mapInArrow(run, "t long, at int, n int, anchor long, content long, before long, after long")


def _windows(docs: DataFrame, window: int, bits: int, salt: int) -> DataFrame:
    """The windows of each row's list of edges, with the hashes of the windows before and after them in the same edge."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            lists = batch.column(2)
            for a, b in chunks(offsets):
                words = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = lists[a:b]
                row = np.repeat(np.arange(b - a), np.diff(some.offsets.to_numpy()))
                flat = some.flatten()
                n = flat.field("n").to_numpy()
                low = flat.field("at").to_numpy().astype(np.int64) + words.first[row]
                edge = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + low[edge]
                x = grams(_hashed(words, salt), window)[at] if len(at) else np.zeros(0, np.uint64)
                values = (x, *_beside(edge, x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[edge] + a)), pa.array((at - words.first[row[edge]]).astype(np.int32)), flat.field("at").take(pa.array(edge)), flat.field("anchor").take(pa.array(edge)), *(_signed(v, bits) for v in values)],
                    ["t", "at", "edge", "anchor", "x", "before", "after"],
                )
        tidy()

    return docs.select("t", "text", "edges").mapInArrow(run, "t long, at int, edge int, anchor long, x long, before long, after long")


def _node(side: str) -> Column:
    """Whether all occurrences have the same neighbour on that side, and have one: the node there has one way."""
    return (F.min(side) == F.max(side)) & (F.min(side) != 0)


def _compacted(found: DataFrame, path: list[str]) -> DataFrame:
    """t, at, n, a, b: runs of occurrences along nonbranching nodes; found has t, at, n, a, b, enters, leaves, and path,
    within which runs are sought.

    `leaves`: all occurrences of the edge are followed by the same edge, `enters`: all are preceded by the same one. An
    occurrence continues the one before it where both hold, and so it does wherever the path occurs: the run's first
    edge a, b names it.
    """
    order = Window.partitionBy(*path).orderBy("at")
    next_to = F.lag(F.col("at") + F.col("n")).over(order) == F.col("at")
    again = F.coalesce(next_to & (F.lag("a").over(order) == F.col("a")) & (F.lag("b").over(order) == F.col("b")), F.lit(False))
    marked = found.withColumn("again", again).withColumn("loop", F.col("again") | F.lead("again", 1, False).over(order))
    apart = ~F.col("loop") & ~F.lag("loop", 1, False).over(order)
    joins = F.col("again") | (F.col("enters") & F.lag("leaves").over(order) & next_to & apart)
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("run", run).groupBy(*path, "run")
    runs = runs.agg(F.min(F.struct("at", "a", "b")).alias("first"), F.sum("n").cast("int").alias("n"), F.max("loop").alias("loop"), F.count(F.lit(1)).alias("turns"))
    return runs.select("t", "first.at", "n", "first.a", F.when(F.col("loop"), F.xxhash64("first.b", "turns")).otherwise(F.col("first.b")).alias("b"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64, salt: int = 0) -> DataFrame:
    """t, at, n, a, b: the compacted spans of repeated windows of the rows t, text, by hash; a, b name the path."""
    edges = written(_edges(docs, window, anchor, bits, salt), "edges")
    anchors = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), (F.min("content") != F.max("content")).alias("branches")).where("k > 1")
    some = written(split_join(edges, anchors.drop("k"), "anchor"), "repeated-edges")
    discard(edges)
    counted = some.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("t", "at")).alias("one"), _node("before").alias("enters"), _node("after").alias("leaves"))
    counted = written(split_join(some.drop("before", "after"), counted, ["anchor", "content"]), "counted-edges")
    discard(some)
    whole = counted.where("copies > 1").select("t", "at", "n", F.col("anchor").alias("a"), F.col("content").alias("b"), "enters", "leaves")
    spans = written(_compacted(whole, ["t"]), "spans")
    apart = counted.where("branches").where((F.col("copies") == 1) | (F.struct("t", "at") == F.col("one")))
    apart = written(apart.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", "n", "anchor"))).alias("edges")), "branching-edges")
    discard(counted)
    if apart.isEmpty():
        return spans
    windows = written(_windows(docs.join(apart, "t"), window, bits, salt), "windows")
    discard(apart)
    twice = windows.groupBy("anchor", "x").agg(F.count(F.lit(1)).alias("k"), _node("before").alias("enters"), _node("after").alias("leaves")).where("k > 1").drop("k")
    found = split_join(windows.drop("before", "after"), twice, ["anchor", "x"]).select("t", "edge", "at", F.lit(1).alias("n"), F.col("anchor").alias("a"), F.bitwise_not("x").alias("b"), "enters", "leaves")
    more = written(_compacted(found, ["t", "edge"]), "window-spans")
    discard(windows)
    return spans.unionByName(more)


def _cut(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """id, n_words, n_removed, kept of every row t, id, text, and the words of each of its spans."""
    lists = spans.groupBy("t").agg(F.collect_list(F.struct("at", "n", "a", "b")).alias("spans"))
    kind = docs.schema["id"].dataType.simpleString()
    held = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.binary())]))

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            words = split(data, offsets)
            removed, kept, read = [], [], []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                size = int(words.sizes[i])
                if not spans:
                    removed.append(0)
                    kept.append(words.bytes_of(i))
                    read.append(None)
                    continue
                edge = np.zeros(size + 1, np.int64)
                at, n = np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + window - 1, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(size - int(stays.sum()))
                kept.append(words.bytes_of(i, stays))
                text = words.bytes_of(i).split(b" ")
                read.append([{"a": s["a"], "b": s["b"], "words": b" ".join(text[s["at"] : s["at"] + s["n"] + window - 1])} for s in spans])
            columns = [batch.column(1), pa.array(words.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(read, held)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept", "spans"])
        tidy()

    shape = f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<a: long, b: long, words: binary>>"
    return docs.join(lists, "t", "left").select("t", "id", "text", "spans").mapInArrow(run, shape)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    `bits` of every hash are used at first: fewer only make collisions, for tests.
    """
    # the number is fixed by the write: no rerun of a task upstream can give a row another
    rows = written(docs.select(F.monotonically_increasing_id().alias("t"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "numbered-rows")
    salt = 0
    while True:
        spans = written(repeated_spans(rows, window, anchor, bits, salt), "all-spans")
        found = written(_cut(rows, spans, window), "cut-rows")
        discard(spans)
        read = found.where("spans IS NOT NULL").select(F.explode("spans").alias("s"))
        unlike = read.groupBy("s.a", "s.b").agg(F.min("s.words").alias("low"), F.max("s.words").alias("high")).where("low <> high")
        if unlike.isEmpty():
            break
        discard(found)
        bits, salt = 64, salt + 1
    discard(rows)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM s) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 35) t(j)),
l AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT doc_id, ws[i] AS v, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, string_agg(p.v, ' ' ORDER BY p.i) AS t FROM p ANTI JOIN x ON p.doc_id = x.doc_id AND p.i = x.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
