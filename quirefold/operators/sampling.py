"""Caps, samples, ids and orders, all with explicit total orders.

`row_number() <= k` filters are cut down before the shuffle (Spark's window group limit), so a source that holds a third
of all rows sends at most k of them from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.tables import fresh, row_digest, written

SEED = 42


def hash_order(key: Column, seed: int = SEED) -> Column:
    """The order that stands for a seeded shuffle."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def capped(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first rows of each group."""
    window, (n,) = Window.partitionBy(group).orderBy(order), fresh(df, "n")
    return df.withColumn(n, F.row_number().over(window)).where(F.col(n) <= cap).drop(n)


def project_capped(valid: DataFrame, group: str, order: str, cap: int, target: int | None = None) -> DataFrame:
    """Of the accepted rows the first `cap` of each project, of these the first `target` in order."""
    found = capped(valid, group, order, cap)
    return found if target is None else found.orderBy(order).limit(target)


def project_full(df: DataFrame, group: str, order: str, valid: Column, cap: int) -> DataFrame:
    """Rows, valid or not, that come after their project's last accepted one.

    The place where a project is full is one row a project, found by the capped form; no running count is needed.
    """
    last, n = fresh(df, "last", "n")
    full = capped(df.where(valid), group, order, cap).groupBy(group).agg(F.max(order).alias(last), F.count(F.lit(1)).alias(n)).where(F.col(n) == cap)
    return df.join(full.drop(n), group).where(F.col(order) > F.col(last)).drop(last)


def balanced(df: DataFrame, group: str, key: str, most: int, seed: int = SEED) -> DataFrame:
    """At most `most` rows of each group, chosen by seeded hash; reruns agree."""
    window, (n,) = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key), fresh(df, "n")
    return df.withColumn(n, F.row_number().over(window)).where(F.col(n) <= most).drop(n)


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Rows in seeded hash order."""
    return df.orderBy(hash_order(F.col(key), seed), key)


def first_after_filters(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def numbered(df: DataFrame, order: str, start: int = 0, name: str = "counter") -> DataFrame:
    """Rows numbered from start in order, without a window over all rows.

    Rows are range-partitioned and sorted, then written with their place in their partition, once: the numbers of rows
    before each partition are counted from that table, so both agree. Rows of one order value are told apart by a hash of
    all columns, so that a value which many rows share is spread over partitions too.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, place, before = fresh(df, "tie", "place", "before")
    placed = df.withColumn(tie, row_digest(df)).repartitionByRange(parts, order, tie).sortWithinPartitions(order, tie).drop(tie)
    placed = written(placed.withColumn(place, F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    # a row a partition
    sums = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("part", F.coalesce(sums, F.lit(0)).alias(before)))
    return placed.join(offsets, part == F.col("part")).withColumn(name, F.col(before) + at + start).select(*[c for c in df.columns if c != name], name)


def batched(df: DataFrame, order: str, size: int) -> DataFrame:
    """Batches of a fixed size in order."""
    (i,) = fresh(df, "i")
    return numbered(df, order, name=i).withColumn("batch", F.floor(F.col(i) / size).cast("long")).drop(i)


def in_group_split(group: Column, percent: int, seed: int = SEED) -> Column:
    """train or validation, the same for a whole group, so that no work leaks between the two."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), group.cast("string"))), 1, 4), 16, 10).cast("int")
    return F.when(share % 100 < percent, "validation").otherwise("train")
