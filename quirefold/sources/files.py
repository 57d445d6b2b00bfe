"""Directories of pages: images with sidecar files, JSON documents, inboxes."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import natural_key, stem

IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents stay unread."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    read = read.option("pathGlobFilter", glob) if glob else read
    return read.load(folder).select("path", "length", "modificationTime")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def located(files: DataFrame) -> DataFrame:
    """With the folder's name (work), the file's name and stem, and the suffix in lower case."""
    parts = F.split("path", "/")
    return files.withColumns({"work": F.element_at(parts, -2), "name": F.element_at(parts, -1), "stem": stem(F.col("path")), "suffix": suffix(F.col("path"))})


def images(files: DataFrame, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    return located(files).where(F.col("suffix").isin(list(suffixes)))


def work_pages(files: DataFrame, skip: tuple[str, ...] = ("config",)) -> DataFrame:
    """Page images of works: .jpg files not named `_...`, in folders not named `_...`, `.../` or in skip."""
    hidden = F.col("work").rlike(r"^[_.]") | F.col("work").isin(list(skip))
    return located(files).where((F.col("suffix") == ".jpg") & ~F.startswith("name", F.lit("_")) & ~hidden)


def in_natural_order(files: DataFrame) -> DataFrame:
    return files.orderBy(natural_key(F.col("path")), "path")


def pending(files: DataFrame) -> DataFrame:
    """Images without a sibling .txt: a.jpg and a.png share one."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    done = files.where(suffix(F.col("path")) == ".txt").select(bare.alias("bare"))
    return images(files).withColumn("bare", bare).join(done, "bare", "left_anti").drop("bare")


def texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """path and whole text of each file."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """path, text and readable of each JSON file; unreadable ones stay, with readable false."""
    return texts(spark, folder, glob).withColumn("readable", F.try_parse_json("text").isNotNull())


def expanded(documents: DataFrame, render: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """path, page, image, failed: each document's pages, by a function that turns a document into images.

    The function is a slot: no PDF library is part of this package. A document that it fails on gives one failed row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, n, image, False) for n, image in enumerate(render(content), 1)]
                except Exception:
                    rows = [(path, None, None, True)]
                yield pd.DataFrame(rows, columns=["path", "page", "image", "failed"]).astype({"page": "Int32", "failed": bool})

    return documents.select("path", "content").mapInPandas(run, "path string, page int, image binary, failed boolean")


def reencoded(pages: DataFrame, encode: Callable[[bytes], bytes], column: str = "image") -> DataFrame:
    """Images run through an encoder (a slot, as above); null where it fails."""

    def one(image: bytes | None) -> bytes | None:
        try:
            return None if image is None else encode(image)
        except Exception:
            return None

    return pages.withColumn(column, F.pandas_udf(_mapper(one), "binary")(column))


def _mapper(function: Callable) -> Callable[[pd.Series], pd.Series]:
    def series(values: pd.Series) -> pd.Series:
        return values.map(function)

    return series


def mirrored(path: str, rules: list[tuple[str, str]]) -> bool:
    """Whether a mirror takes a path: the first (take|leave, pattern) that fits decides; without one it does."""
    return next((verdict == "take" for verdict, pattern in rules if fnmatch.fnmatch(path, pattern)), True)


def mirror_filter(path: Column, rules: list[tuple[str, str]]) -> Column:
    """`mirrored` as an expression."""
    hits = [F.when(path.rlike(fnmatch.translate(pattern).replace(r"\z", r"\Z")), verdict == "take") for verdict, pattern in rules]
    return F.coalesce(*hits, F.lit(True))
