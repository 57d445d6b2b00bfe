"""What the operators share: reading, written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.tables import BATCH_BYTES, BATCH_ROWS, bounded, dealt, discard, fresh, own_folder, row_digest, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "dealt", "discard", "fresh", "own_folder", "row_digest", "split_join", "table", "tidy", "tune", "written"]


def tune(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and lets Spark drop a query's shuffle files when it ends: what outlives it is a written table."""
    bounded(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(tune(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def split_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """An equi-join that adaptive execution can split where a key is hot.

    It splits a hot partition only where both sides were shuffled for the join itself. A side that comes out of an
    aggregate on the same key is not: its task would read all rows of a hot key. So the join goes by a one-to-one image
    of the key, which makes Spark shuffle both sides, the aggregated one being small.
    """
    on = [on] if isinstance(on, str) else on

    def image(df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return F.bitwise_not(F.col(name))
        return F.concat(F.col(name), F.lit(bytearray(b"\0")) if kind == "binary" else F.lit("\0"))

    left = left.withColumns({f"__left_{c}": image(left, c) for c in on})
    right = right.select(*(image(right, c).alias(f"__right_{c}") for c in on), *(c for c in right.columns if c not in on))
    match = reduce(lambda a, b: a & b, (F.col(f"__left_{c}") == F.col(f"__right_{c}") for c in on))
    return left.join(right, match, how).drop(*(f"__left_{c}" for c in on), *(f"__right_{c}" for c in on))


def tidy() -> None:
    """In a Python worker, at the end of a task: gives freed memory back, as workers live on and share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
