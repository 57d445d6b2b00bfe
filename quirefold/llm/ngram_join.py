"""Operator 13: an exact similarity join on word n-grams, with token-combination prefixes.

A document's tokens are its distinct word n-grams, in one order for all documents: rare ones first. If two documents are
similar, one has at most `slack` tokens that the other lacks; so they share a token among the first slack + 1 of each. Where tokens
are frequent that prefix says little, so frequent tokens are indexed by k at a time (Wang et al., "Local Similarity Search
for Unstructured Text", 2016): tokens fall into classes by frequency (`LIMITS`: single tokens, pairs, triples), those
of the upper classes into groups by hash, and a group with m tokens in the prefix must lose m - k + 1 of them before two
documents share no k of it. The prefix is extended until the losses that sharing nothing would need add up to more than slack;
then similar documents share a rare token or a combination of k of a group, and the index has about `WIDTH` combinations
a token however long the document. Groups depend on the length: a length range has its own number of groups, and a
document that may have partners in the next range has keys for both.

Frequencies are counted over all documents, and a document must learn those of its own tokens: batches send their tokens,
packed, to the range of hashes they fall in; each range counts its tokens and sends what two or more documents have,
packed again, to the range of documents that they are of. Tokens of one document alone need no answer, they just come
first. Documents whose prefix holds only such tokens, the bulk of a corpus, are done then. Where a corpus has so many
documents that one token's could fill a task, a token that more than its share of a batch has goes its own way: a count
to its range, its documents spread by hash, and its frequency joined to them later.

Candidates are verified on full sets (`links`): classes of documents, not pairs, are the result.

Defined cases: a document with fewer words than n is one token, its whole sequence; null, empty and blank texts have none
and are linked with nothing; equal sets are one vertex; a null doc_id can be in a component but never names one that has
other ids; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import split_join, tidy, written
from quirefold.llm.links import confirmed_links, members_of, named, shingle_sets, text_digest, vertex_of, vertices_of
from quirefold.llm.words import U, mix

WORDS = 4
#: Below the first frequency tokens are indexed one by one, below the second in pairs, from there on in triples.
LIMITS = (64, 2048)
#: A group of pairs per so many tokens of a document's length range, and of triples.
WIDTH = (32, 16)
#: Tokens that one task counts. A token that a quarter of that many documents could have is looked out for.
TASK = 4 << 20
NORMAL, SPREAD, COUNTS = 0, 1, 2
_PACKED = "part int, kind int, vertices binary, sizes binary, runs binary, tokens binary, counts binary"


def slack(size: int, percent: int) -> int:
    """How many tokens of a document a similar one can lack."""
    return size - -(-percent * size // 100)


def ranges(size: int, percent: int) -> list[int]:
    """The length ranges (powers of two) a document has keys for: its own, and the next where a partner may be in it."""
    own = size.bit_length() - 1
    return [own, own + 1] if 100 * size >= percent * (2 << own) else [own]


def keys_of(tokens: np.ndarray, counts: np.ndarray, size: int, percent: int, limits: tuple[int, int] = LIMITS, width: tuple[int, int] = WIDTH) -> np.ndarray:
    """The keys of a document of `size` tokens, of which tokens, with their frequencies, are shared with others."""
    tokens, at = np.unique(tokens, return_index=True)
    counts = counts[at]
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    k = 1 + (counts >= limits[0]) + (counts >= limits[1])
    need, alone, found = slack(size, percent) + 1, size - len(tokens), set()
    if alone >= need:
        return np.zeros(0, np.int64)
    for n in ranges(size, percent):
        groups = np.array([1, 1, max(1, (1 << n) // width[0]), max(1, (1 << n) // width[1])])
        group = np.where(k > 1, (tokens % groups[k].astype(np.uint64)).astype(np.int64) * 4 + k, 0)
        # how many of its group a token follows
        by = np.argsort(group, kind="stable")
        new = np.append(True, group[by][1:] != group[by][:-1])
        before = np.empty(len(by), np.int64)
        before[by] = np.arange(len(by)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        losses = alone + np.cumsum(before >= k - 1)
        end = min(int(np.searchsorted(losses, need)) + 1, len(tokens))
        single = k[:end] == 1
        found.update(mix(tokens[:end][single]).view(np.int64).tolist())
        held: dict[int, list[int]] = {}
        for g, token in zip(group[:end][~single].tolist(), tokens[:end][~single].tolist(), strict=True):
            held.setdefault(g, []).append(token)
        for g, some in held.items():
            sets = np.array(list(combinations(sorted(some), g % 4)), np.uint64).reshape(-1, g % 4)
            total = np.full(len(sets), U(n * 4 + g % 4))
            for column in sets.T:
                total = mix(total + column)
            found.update(total.view(np.int64).tolist())
    return np.array(sorted(found), np.int64)


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, n_shingles, vertex."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([vertex_of(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "digest", "n_shingles", "vertex"],
            )
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")).mapInArrow(run, f"doc_id {kind}, digest binary, n_shingles long, vertex binary")


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["part", "kind", "vertices", "sizes", "runs", "tokens", "counts"])


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _packed(kind: int, part: np.ndarray, owner: np.ndarray, tokens: np.ndarray, names: np.ndarray, sizes: np.ndarray, counts: np.ndarray | None = None):
    """A row for each part: its vertices (16 bytes, and their sizes), how many tokens of each follow, the tokens and their counts."""
    if not len(part):
        return
    order = np.lexsort((tokens, owner, part))
    part, owner, tokens = part[order], owner[order], tokens[order]
    counts = counts[order].astype("<u4") if counts is not None else None
    heads = _cuts(part, owner)
    runs, ends = np.diff(np.append(heads, len(part))).astype("<u4"), _cuts(part[heads])
    for a, b in zip(ends.tolist(), [*ends[1:].tolist(), len(heads)], strict=True):
        some, low, high = owner[heads[a:b]], heads[a], heads[b] if b < len(heads) else len(part)
        yield int(part[low]), kind, names[some].tobytes(), sizes[some].astype("<u4").tobytes(), runs[a:b].tobytes(), tokens[low:high].tobytes(), b"" if counts is None else counts[low:high].tobytes()


def _gathered(rows: list[tuple]):
    """Of packed rows the distinct vertices in order, their sizes, and of each distinct pair of vertex and token the vertex's
    place, the token and its count; tokens ascend, and vertices within them."""
    if not rows:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, sizes, runs, tokens = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in enumerate(("<u8", "<u4", "<u4", "<u8")))
    counts = np.concatenate([np.frombuffer(r[4], "<u4") if r[4] else np.zeros(len(r[3]) // 8, "<u4") for r in rows])
    names = names.reshape(-1, 2)
    order = np.lexsort((names[:, 1], names[:, 0]))
    heads = _cuts(names[order, 0], names[order, 1])
    place = np.empty(len(names), np.int64)
    place[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    owner = np.repeat(place, runs)
    first = np.lexsort((owner, tokens))
    first = first[_cuts(tokens[first], owner[first])]
    return names[order[heads]], sizes[order[heads]].astype(np.int64), owner[first], tokens[first], counts[first].astype(np.int64)


def _sent(docs: DataFrame, words: int, parts: int, share: float) -> DataFrame:
    """The tokens of each batch for each range; those that more than `share` of its documents have as SPREAD and COUNTS."""

    def run(batches):
        for batch in batches:
            sets = {vertex_of(s): s for s in shingle_sets(batch.column(0), words) if len(s)}
            if not sets:
                continue
            names, sizes = np.frombuffer(b"".join(sets), np.uint64).reshape(-1, 2), np.array([len(s) for s in sets.values()])
            tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
            rows = []
            if share < 1:
                heads, of, n = np.unique(tokens, return_inverse=True, return_counts=True)
                hot = n > max(1, share * len(sets))
                wide = hot[of]
                if wide.any():
                    none = np.zeros(hot.sum(), np.int64)
                    rows += _packed(COUNTS, _range_of(heads[hot], parts), none, heads[hot], names[:1], sizes[:1], n[hot])
                    rows += _packed(SPREAD, _range_of(mix(tokens[wide] ^ names[owner[wide], 0]), parts), owner[wide], tokens[wide], names, sizes)
                    tokens, owner = tokens[~wide], owner[~wide]
            yield _batch([*_packed(NORMAL, _range_of(tokens, parts), owner, tokens, names, sizes), *rows])
        tidy()

    return docs.select("text").mapInArrow(run, _PACKED)


def _counted(sent: DataFrame, parts: int) -> DataFrame:
    """For each range of vertices, the tokens of a range that several documents have, with their counts (NORMAL); the counts of
    tokens that went their own way (COUNTS), and their documents (SPREAD), each once."""

    def run(batches):
        rows: dict[int, list] = {NORMAL: [], SPREAD: [], COUNTS: []}
        for batch in batches:
            for kind, *row in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                rows[kind].append(row)
        names, sizes, owner, tokens, _ = _gathered(rows[NORMAL])
        heads = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows[COUNTS]]) if rows[COUNTS] else np.zeros(0, np.uint64)
        more = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows[COUNTS]]) if rows[COUNTS] else np.zeros(0, np.uint32)
        heads, at = np.unique(heads, return_inverse=True)
        more = np.bincount(at, more, len(heads)).astype(np.int64)
        known, of, count = np.unique(tokens, return_inverse=True, return_counts=True)
        if len(heads) and len(known):
            place = np.minimum(np.searchsorted(known, heads), len(known) - 1)
            both = known[place] == heads
            count[place[both]] += more[both]
            more[both] = count[place[both]]
        keep = np.flatnonzero(count[of] > 1) if len(tokens) else np.zeros(0, np.int64)
        owner, tokens, count = owner[keep], tokens[keep], count[of[keep]]
        yield _batch(list(_packed(NORMAL, _range_of(names[owner, 0], parts), owner, tokens, names, sizes, count)))
        if len(heads):
            yield _batch(list(_packed(COUNTS, np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), heads, np.zeros((1, 2), np.uint64), np.zeros(1, np.int64), more)))
        if rows[SPREAD]:
            names, sizes, owner, tokens, _ = _gathered(rows[SPREAD])
            yield _batch(list(_packed(SPREAD, np.zeros(len(owner), np.int64), owner, tokens, names, sizes)))
        tidy()

    return sent.repartitionById(parts, "part").mapInArrow(run, _PACKED)


def _joined(found: DataFrame, parts: int) -> DataFrame:
    """SPREAD tokens with their counts, packed for their ranges of vertices."""

    def flat(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                names, size = [row[0][16 * i : 16 * i + 16] for i in range(len(row[0]) // 16)], np.frombuffer(row[1], "<u4")
                of = np.repeat(np.arange(len(names)), np.frombuffer(row[2], "<u4"))
                tokens = pa.array(np.frombuffer(row[3], "<i8"))
                counts = pa.array(np.frombuffer(row[4], "<u4").astype(np.int64)) if row[4] else pa.nulls(len(tokens), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(pa.array(of)), pa.array(size[of].astype(np.int64)), tokens, counts], ["vertex", "size", "token", "count"])

    def packed(batches):
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            tokens = batch.column(2).to_numpy().view(np.uint64)
            yield _batch(list(_packed(NORMAL, _range_of(names[:, 0], parts), np.arange(len(names)), tokens, names, batch.column(1).to_numpy(), batch.column(3).to_numpy())))

    rows = {kind: found.where(F.col("kind") == kind).mapInArrow(flat, "vertex binary, size long, token long, count long") for kind in (SPREAD, COUNTS)}
    joined = split_join(rows[SPREAD].drop("count"), rows[COUNTS].select("token", "count"), "token")
    return joined.select("vertex", "size", "token", "count").mapInArrow(packed, _PACKED)


def _keyed(shared: DataFrame, parts: int, percent: int) -> DataFrame:
    """vertex, size, key of the vertices whose prefix holds tokens of others."""

    def run(batches):
        rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)]
        names, sizes, owner, tokens, counts = _gathered(rows)
        del rows
        order = np.argsort(owner, kind="stable")
        owner, tokens, counts = owner[order], tokens[order], counts[order]
        cut = np.append(_cuts(owner), len(owner))
        for low in range(0, len(cut) - 1, 4096):
            vertices, keys = [], []
            for a, b in zip(cut[low : low + 4096], cut[low + 1 : low + 4097], strict=False):
                size = int(sizes[owner[a]])
                if size - (b - a) <= slack(size, percent):
                    vertices.append(owner[a])
                    keys.append(keys_of(tokens[a:b], counts[a:b], size, percent))
            yield pa.RecordBatch.from_arrays([pa.array([names[v].tobytes() for v in vertices], pa.binary()), pa.array(sizes[vertices] if vertices else [], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["vertex", "size", "keys"])
        tidy()

    return shared.repartitionById(parts, "part").mapInArrow(run, "vertex binary, size long, keys array<long>").select("vertex", "size", F.explode("keys").alias("key"))


def keyed(docs: DataFrame, documents: int, total: int, percent: int, words: int, task: int = TASK) -> DataFrame:
    """vertex, size, key of docs (text), of which there are so many, with so many tokens."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task))
    share = task / 4 / max(documents, 1)
    counted = _counted(_sent(docs, words, parts, share), parts)
    if share < 1:
        counted = written(counted, "ngram-shared")
        counted = counted.where(F.col("kind") == NORMAL).unionByName(_joined(counted, parts))
    return _keyed(counted, parts, percent)


def similar_documents(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", task: int = TASK) -> DataFrame:
    """doc_id, n_shingles, component_id - one row per row of docs; linked are 100 * common >= percent * united."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(_rows(docs, words), "ngram-rows")
    vertices = written(vertices_of(rows), "ngram-vertices")
    n = vertices.agg(F.sum("n").alias("documents"), F.sum(F.col("size") * F.col("n")).alias("tokens")).first()
    keys = written(keyed(docs, n.documents or 0, n.tokens or 0, percent, words, task), "ngram-keys")
    members = written(members_of(keys), "ngram-members")
    found = named(rows, vertices, confirmed_links(docs, vertices, members, percent, words))
    component = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))
