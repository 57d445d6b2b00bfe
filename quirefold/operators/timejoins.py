"""Joins in time (an extra of this engine): the last row before, and points in intervals.

Neither compares rows pair by pair. A key that a third of all rows have is cut by time: slices of it lie in different
partitions, and what a slice needs of those before it is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.tables import fresh

HOUR = 3_600_000_000


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, take: list[str], tie: str, within: int | None = None, width: int = 24 * HOUR) -> DataFrame:
    """left's rows, all of them, with the columns `take` of right's last row of the same key at or before their time; of right's
    rows of one time the one with the largest `tie`. Columns of right must have other names than left's.

    Both sides are united and cut into slices of `width` microseconds. In a slice the last row of right is carried forward by a
    window; what a slice inherits is the last row of the slices before it, found over one row a slice. `within` leaves out
    what is older than so many microseconds. Null keys and times match nothing; left's rows of one key and time all get the
    same row.
    """
    at, side, slice_, row, found, before, mine, same = fresh(left, "at", "side", "slice", "row", "found", "before", "mine", "same")
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    known = known.select(F.col(key), _micros(F.col(time)).alias(at), F.struct(_micros(F.col(time)).alias("at"), F.col(tie).alias("tie"), F.struct(*take).alias("taken")).alias(row))
    asked = left.select(F.col(key), _micros(F.col(time)).alias(at), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias(mine))
    both = asked.withColumns({side: F.lit(1), row: F.lit(None).cast(known.schema[row].dataType)}).unionByName(known.withColumns({side: F.lit(0), mine: F.lit(None).cast(asked.schema[mine].dataType)}))
    both = both.withColumn(slice_, F.floor(F.col(at) / width))
    # right's rows come first at one time, in the order of their tie
    order = Window.partitionBy(key, slice_).orderBy(at, side, F.col(row)["tie"]).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn(found, F.last(row, ignorenulls=True).over(order)).where(F.col(side) == 1)
    ends = known.withColumn(slice_, F.floor(F.col(at) / width)).groupBy(key, slice_).agg(F.max_by(row, F.struct(F.col(row)["at"].alias("at"), F.col(row)["tie"].alias("tie"))).alias(before))
    slices = asked.select(key, F.floor(F.col(at) / width).alias(slice_)).distinct().withColumn(before, F.lit(None).cast(known.schema[row].dataType)).withColumn(side, F.lit(0))
    # a row a slice and key: what each inherits is the last end before it
    earlier = Window.partitionBy(key).orderBy(slice_, side).rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.withColumn(side, F.lit(1)).unionByName(slices).withColumn(before, F.last(before, ignorenulls=True).over(earlier)).where(F.col(side) == 0).drop(side)
    inherited = inherited.withColumnsRenamed({key: same, slice_: f"{same}_slice"})
    joined = carried.join(inherited, (F.col(key) == F.col(same)) & (F.col(slice_) == F.col(f"{same}_slice")), "left")
    last = F.coalesce(found, before)
    if within is not None:
        last = F.when(F.col(at) - last["at"] <= within, last)
    last = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), last)
    return joined.withColumn(found, last).select(*(F.col(mine)[c].alias(c) for c in left.columns), *(F.col(found)["taken"][c].alias(c) for c in take))


def points_in(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, unit: int = HOUR) -> DataFrame:
    """Pairs of an interval [start, end) and a point of the same key that lies in it; columns must have different names but for
    the key, which stays once.

    An interval is filed under bins about as wide as itself, two at most, whatever its length; a point under its bin at
    each width that occurs. Pairs of one key and bin are held against the exact bounds. Empty and backward intervals, null keys
    and null times match nothing.
    """
    level, bin_, low, high, at = fresh(intervals, "level", "bin", "low", "high", "at")
    spans = intervals.withColumns({low: _micros(F.col(start)), high: _micros(F.col(end))}).where(F.col(key).isNotNull() & (F.col(high) > F.col(low)))
    # the least level whose bins are no shorter than the interval
    units = F.floor((F.col(high) - F.col(low) - 1) / unit)
    spans = spans.withColumn(level, F.when(units == 0, 0).otherwise(F.length(F.bin(units))).cast("int"))
    width = F.call_function("shiftleft", F.lit(unit).cast("long"), F.col(level))
    ends = F.array_distinct(F.array(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    filed = spans.withColumn(bin_, F.explode(ends))
    levels = sorted(r[0] for r in spans.select(level).distinct().collect())  # a number a power of two: forty at most
    known = points.withColumn(at, _micros(F.col(time))).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    known = known.withColumn(level, F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>")))
    known = known.withColumn(bin_, F.floor(F.col(at) / F.call_function("shiftleft", F.lit(unit).cast("long"), F.col(level))))
    joined = filed.join(known, [key, level, bin_]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return joined.drop(level, bin_, low, high, at)
