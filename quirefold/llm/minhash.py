"""Operator 1: near-duplicate classes by circulant MinHash.

Words are lower-cased (A-Z) and cut into 5-word shingles; a shingle is a point of the ring of 64-bit integers. Two
permutations of that ring give all coordinates: the first scatters the set, the second is shifted circularly, once per
coordinate, and its minimum over the set is the coordinate (Li and Li, "C-MinHash", 2022). Coordinates are banded; the
number of bands follows from the similarity sought, so that a pair at the threshold misses all bands with a chance
below one in a million. Every link is confirmed by the exact Jaccard similarity of the two full sets (`links`).

Defined cases: a document of 1-4 words is one shingle (its whole sequence); null, empty and blank texts have none, are
linked with nothing and kept; a null doc_id can be in a component but never names one that has other ids. Rows that share
an id, or have none, are told apart by their texts throughout. An empty table
gives none. `near_duplicates` tells by doc_id, so all rows of a component that have its name are `kept`;
`without_near_duplicates` tells rows apart by id and text, and of those that share the name leaves one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import fresh, tidy, written
from quirefold.llm.links import confirmed_links, members_of, named, shingle_sets, text_digest, vertex_of, vertices_of
from quirefold.llm.words import U, mix

SHINGLE, ROWS, MISS = 5, 4, 1e-6
_STEP = U(0x9E3779B97F4A7C15)
_FIRST = U(0x6A09E667F3BCC909)


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of coordinates for each non-empty set."""
    points = mix(np.concatenate(sets) ^ _FIRST)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, shifts = np.empty((len(sets), coordinates), np.uint64), np.arange(coordinates, dtype=np.uint64) * _STEP
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(mix(points + shifts[k]), at)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), (len(sig), bands)).copy()
    for r in range(rows):
        total = mix(total + sig[:, r::rows][:, :bands])
    return total.view(np.int64)


def _sketch(docs: DataFrame, bands: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), SHINGLE))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                for i, row in zip(some, band_keys(signatures([sets[i] for i in some], bands * ROWS)), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([vertex_of(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "vertex", "bands"],
            )
            del sets, keys
        tidy()

    digested = docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return digested.mapInArrow(run, f"doc_id {kind}, digest binary, n_shingles long, vertex binary, bands array<long>")


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, digest, n_shingles, n (rows of the same set) and first (unknown, id, digest: the row that its component leaves)."""
    rows = written(_sketch(docs, n_bands(percent / 100)), "minhash-rows")
    vertices = written(vertices_of(rows, F.first("bands").alias("bands")), "minhash-vertices")
    members = written(members_of(vertices.select("vertex", "size", F.explode("bands").alias("key"))), "minhash-members")
    return named(rows.drop("bands"), vertices, confirmed_links(docs, vertices, members, percent, SHINGLE))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per row of docs; linked are 100 * common >= percent * united."""
    found = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), percent)
    component = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows and columns, one row of each class.

    A class leaves the row with the smallest id (null ids last), of its texts the one with the smallest digest, and of
    rows equal in both any one.
    """
    id_, want, most, rows, digest, key, row = fresh(docs, "id", "want", "wins", "rows", "digest", "key", "row")
    found = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), percent).where("n_shingles > 0")
    wins = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    told = found.where(~wins | (F.col("n") > 1)).groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(want)).agg(F.max(wins).alias(most), F.count(F.lit(1)).alias(rows))
    told = written(told.where(~F.col(most) | (F.col(rows) > 1)), "minhash-told")
    marked = docs.withColumn(digest, text_digest(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(want))
    kept = marked.join(told, same, "left_anti")
    again = told.where(most)
    if not again.isEmpty():
        one = marked.join(again, same, "left_semi").groupBy(F.col(id_col).alias(key), digest).agg(F.first(F.struct(*marked.columns)).alias(row))
        kept = kept.unionByName(one.select(f"{row}.*"))
    return kept.select(docs.columns)


def oracle(percent: int, words: int = SHINGLE, kept: bool = True) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(list_slice(ws, i, i + {words - 1}), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {percent} * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{', d.doc_id = m.component_id AS kept' if kept else ''}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
