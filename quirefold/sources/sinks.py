"""Sinks: corpora, page texts and staged replacement."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.stores import opened, put

# Without charToEscapeQuoteEscaping, Spark takes NUL for one and loses those beside quotes and line breaks.
_QUOTED = {"header": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "escapeQuotes": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A page corpus as CSV that `read_corpus` gives back: a null is nothing, an empty text is `""`. With mode append each part
    still has its own header."""
    df.write.mode(mode).options(**_QUOTED, nullValue="", emptyValue='""').csv(path)


def append_rows(df: DataFrame, path: str, columns: tuple[str, ...] = ("failinimi", "transkriptsioon", "allikas")) -> None:
    """Rows appended under one schema; a column that df lacks is null, so no ragged rows arise."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("append").parquet(path)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Renames old where it exists; a rename that the store refuses is an error, nothing is deleted for it."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    store = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(a):
        return False
    if store.exists(b):
        raise FileExistsError(new)
    if not store.rename(a, b):
        raise OSError(f"could not rename {old} to {new}")
    return True


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replace_with_backup(df: DataFrame, path: str) -> None:
    """The table is written beside the live one, the live one becomes .bak, and the new one takes its place.

    The backup before goes last: at every moment the live table or a whole copy of it exists, and a rename that fails puts
    the live table back.
    """
    path, spark = path.rstrip("/"), df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    _delete(spark, f"{path}.bak.old")
    move(spark, f"{path}.bak", f"{path}.bak.old")
    had = move(spark, path, f"{path}.bak")
    try:
        move(spark, f"{path}.tmp", path)
    except Exception:
        if had:
            move(spark, f"{path}.bak", path)
        raise
    if had:
        _delete(spark, f"{path}.bak.old")
    else:
        move(spark, f"{path}.bak.old", f"{path}.bak")


def beside(path: Column) -> Column:
    """Where the text of an image goes: the same name with .txt."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".txt"))


def write_page_texts(df: DataFrame, folder: str | None = None, name: str = "stem", text: str = "text") -> int:
    """Writes each page's text as it is to a file of its own, `<folder>/<name>.txt`; without a folder `name` is the whole
    path. An empty text is written too, so its page counts as done; a rerun writes the same files again. Gives their number.
    """

    def run(batches):
        task = TaskContext.get()
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"], strict=True):
                store, at = opened(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                put(store, at, (body or "").encode(), str(task.taskAttemptId()))
            yield pd.DataFrame({"n": [len(batch)]})

    path = F.col(name) if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name), F.lit(".txt"))
    pages = df.select(path.alias("path"), F.col(text).alias("body"))
    return pages.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save(df: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """Writes df unless dry; gives the counts that are reported either way."""
    if not dry:
        df.write.mode("overwrite").parquet(path)
    return df.agg(F.count(F.lit(1)).alias("rows"))
