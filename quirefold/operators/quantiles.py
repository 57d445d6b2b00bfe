"""Exact quantiles of a column, by selection: no task holds, or sorts, more than a range of the distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.tables import written


def quantiles(df: DataFrame, value: Column, **shares: float) -> DataFrame:
    """One row: n (values that aren't null) and, under each name, the value at that share of the way from the least to the
    largest, between two neighbours where it falls there; null without values.

    Equal values are counted first, before any shuffle of rows, so a value that most rows have is one row. The counts are
    range-partitioned by value and written; their sums, a row a partition, say which partitions hold the ranks that are sought, and
    only those are looked through.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    counted = df.select(value.cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "quantile-counts")
    sums = sorted((r.part, r.n) for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a partition
    total, before, at = sum(n for _, n in sums), {}, 0
    for part, n in sums:
        before[part] = at
        at += n
    places = {name: share * (total - 1) for name, share in shares.items()}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))}) if total else []
    holding = {max(p for p in before if before[p] <= r) for r in ranks}
    offset = F.element_at(F.create_map(*(F.lit(x) for p in holding for x in (p, before[p]))), F.col("part")) if holding else F.lit(0)
    last = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + offset
    found = counted.where(F.col("part").isin(list(holding))).select("v", (last - F.col("n")).alias("first"), last.alias("end"))
    at_rank = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("end") > r), F.col("v")))

    def between(place: float) -> Column:
        low, high = at_rank(math.floor(place)), at_rank(math.ceil(place))
        return low + (high - low) * (place - math.floor(place)) if place != math.floor(place) else low

    columns = [(between(p) if total else F.lit(None).cast("double")).alias(name) for name, p in places.items()]
    return found.agg(F.lit(total).cast("long").alias("n"), *columns)
