"""Operator 9: exact deduplication, in DataFrame functions only.

Texts are equal when their bytes are equal after every character of `[\\x20\\x09-\\x0D]` is deleted. Rows are grouped by
a 128-bit hash of what is left; each row's bytes are then compared with those of its group's representative, and the
rows that differ (a collision of hashes) are grouped anew by the bytes themselves, so a collision never merges texts.
The counts and the row that stays come from aggregates with partial sums before each shuffle, so a text that holds a
third of all rows is added up where it lies; no group is gathered.

Defined cases: a null text counts as empty; empty and blank texts are equal to each other; of equal texts the one with
the most code points stays, then the smallest doc_id (null ids last); rows that repeat an id each count, and all that
equal the winner in text length and id are kept as one (`kept` is true on each of them). An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import fresh, row_digest, split_join, written

BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without its blanks."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    blank_free = normalised(F.col(text_col)).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        blank_free.alias("bytes"),
    ).withColumns({"h": F.unhex(F.md5("bytes")), "text_sha256": F.sha2("bytes", 256)})


def _best() -> Column:
    return F.min(F.struct((-F.col("points")).alias("least"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 - one row per row of docs."""
    return _marked(docs, id_col, text_col).drop("points")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    full = _rows(docs, id_col, text_col)
    rows = written(full.drop("bytes"), "exact-rows")
    groups = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best")), "exact-groups")
    found = split_join(rows, groups, "h")
    collided = written(_collisions(full), "exact-collisions")
    if not collided.isEmpty():
        own = full.join(collided, "h", "left_semi")
        again = own.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
        found = found.join(collided, "h", "left_anti").unionByName(own.join(again, ["h", "bytes"]).drop("bytes"))
    keep = F.col("best.id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(keep) & (F.col("points") == -F.col("best.least"))).alias("kept"),
        "text_sha256",
        "points",
    )


def _collisions(full: DataFrame) -> DataFrame:
    """The hashes whose rows differ in their bytes.

    A partial aggregate keeps the smallest and the largest bytes of each hash, before any shuffle; they are equal only if
    all are. A group that holds a third of all rows leaves each task as one row.
    """
    ends = full.groupBy("h").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return ends.where("low <> high").select("h")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs and no other.

    Where several rows share the winner's id, text and length, one of them stays, which is told by a hash of all fields.
    """
    names = fresh(docs, "points", "sha", "id", "want", "most", "key", "row")
    points, sha, id_, want, most, key, row = names
    marked = docs.withColumns({points: F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), sha: F.sha2(normalised(F.col(text_col)).cast("binary"), 256)})
    winners = _marked(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256", "points").agg(F.count(F.lit(1)).alias("n"))
    winners = written(winners, "exact-winners")
    sought = winners.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(want), F.col("points").alias(most))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(want)) & (F.col(points) == F.col(most))
    kept = marked.join(sought, same, "left_semi")
    if not winners.where("n > 1").isEmpty():
        longest = F.max_by(F.struct(*docs.columns), F.struct(points, F.xxhash64(text_col), row_digest(docs), row_digest(docs, 1)))
        return kept.groupBy(sha, F.col(id_col).alias(key)).agg(longest.alias(row)).select(f"{row}.*")
    return kept.select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM r
"""
