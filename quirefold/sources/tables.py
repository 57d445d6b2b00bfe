"""Tables: the page corpus as CSV, rows with images as Parquet, number ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quirefold.functions.text import file_name

CORPUS = StructType([StructField(c, StringType()) for c in ("failinimi", "transkriptsioon", "allikas")])
_QUOTED = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_corpus(spark: SparkSession, *paths: str, schema: StructType = CORPUS) -> DataFrame:
    """Page corpora: quoted fields may hold line breaks and doubled quotes; short rows are filled with nulls. A field without
    anything is null, a quoted one without anything an empty text."""
    # Spark reads fields that equal nullValue as null, quoted ones too; no text equals a name made up now
    return spark.read.options(**_QUOTED, nullValue=f"null-{uuid.uuid4().hex}").schema(schema).csv(list(paths))


def relocated(path: Column, folder: str) -> Column:
    """The file of a stored path in another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), file_name(path))


def read_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows image{bytes, path}, xml_content, filename, project_name. The image is read only where it is used."""
    return spark.read.parquet(*paths)


def image_bytes(image: Column) -> Column:
    """The bytes of an image field, null where there are none."""
    return F.when(F.octet_length(image["bytes"]) > 0, image["bytes"])


def number_range(spark: SparkSession, spec: str, width: int = 5) -> DataFrame:
    """`00100..00200`, both ends included, as zero-padded names; a single number is itself."""
    first, _, last = spec.partition("..")
    return spark.range(int(first), int(last or first) + 1).select(F.format_string(f"%0{width}d", "id").alias("page"))
