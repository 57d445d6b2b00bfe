"""What the two classifiers share: the labelled rows they may learn from, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 1: never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None) -> DataFrame:
    """text, y, h of the at most max_rows labelled documents outside fold 0 whose ids come first in hash order; with
    max_bytes, of these the ones whose texts together are no longer than that.

    Texts of at most a 64th of max_bytes come first, then the longer ones, both in hash order; one that no longer fits is
    left out alone, whatever comes after it. The sample of ids is bounded by max_rows, so its broadcast is too. An id that
    labels repeat has its largest label, and counts with all rows that documents have of it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("fold", fold(F.col("__id"))).where("fold <> 0")
    some = known.orderBy(F.xxhash64(F.lit(7), "__id"), "__id").limit(max_rows)
    if max_bytes is not None:
        sizes = docs.select(F.col(id_col).alias("__doc"), F.octet_length(text_col).alias("size")).join(F.broadcast(some), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
        left, fit = max_bytes, []
        # max_rows rows at most
        for row in sorted(sizes.withColumn("h", F.xxhash64(F.lit(7), "__id")).collect(), key=lambda r: (64 * r.size > max_bytes, r.h, r["__id"])):
            if row.size <= left:
                left -= row.size
                fit.append((row["__id"],))
        some = some.join(F.broadcast(docs.sparkSession.createDataFrame(fit, sizes.select("__id").schema)), "__id")
    return docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("__doc") == F.col("__id")).select("text", "y", F.xxhash64(F.lit(9), "__id").alias("h"))
