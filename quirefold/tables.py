"""Written intermediate tables, and names and digests that never clash with a caller's columns."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.session import shared_folder

#: Arrow batches that reach Python hold at most this much text (a single longer row still goes alone).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000

_own: dict[str, str] = {}


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, so that very long texts never pile up in one Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def own_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; it is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{shared_folder(spark)}/quirefold-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM is gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: a lost executor costs a reread, not a recomputation."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quirefold-" in path:
                _remove(df.sparkSession, path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where few files are read in fewer tasks (a file of one row group can't be split).

    The names of the files stay in the JVM, as a large table has very many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = f"__{name}"
        while free in taken:
            free = f"_{free}"
        taken.add(free)
        out.append(free)
    return tuple(out)


def _hash(value: Column, kind: T.DataType) -> Column:
    """A 64-bit hash of a value of any type. Nested values are walked part by part, so that a null, an order or a fraction
    of a second is never lost on the way."""
    null = value.isNull()
    if isinstance(kind, T.StructType):
        return F.xxhash64(null, *(_hash(value.getField(f.name), f.dataType) for f in kind)) if len(kind) else F.xxhash64(null)
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: _hash(x, kind.elementType))
        return F.xxhash64(null, F.aggregate(parts, F.size(value).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    if isinstance(kind, T.MapType):  # a map's entries have no order
        parts = F.array_sort(F.transform(F.map_entries(value), lambda e: F.xxhash64(_hash(e["key"], kind.keyType), _hash(e["value"], kind.valueType))))
        return F.xxhash64(null, F.aggregate(parts, F.size(value).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    if isinstance(kind, T.VariantType):
        return F.xxhash64(null, F.schema_of_variant(value), F.to_json(value))
    if isinstance(kind, T.StringType):  # its bytes, whatever its collation holds equal
        return F.xxhash64(null, value.cast("binary"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):  # tells 0.0 from -0.0
        return F.xxhash64(null, value.cast("string"))
    return F.xxhash64(null, value)


def row_digest(df: DataFrame, *seeds: int) -> Column:
    """A 64-bit hash of all fields of a row. A null is told from every value, and from a null of another column."""
    quoted = (f"`{field.name.replace('`', '``')}`" for field in df.schema)
    fields = [_hash(F.col(name), field.dataType) for name, field in zip(quoted, df.schema, strict=True)]
    return F.xxhash64(*(F.lit(seed) for seed in seeds), *fields)
