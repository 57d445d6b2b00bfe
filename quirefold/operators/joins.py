"""Joins of pages with their documents, metadata and transcriptions, all on stems.

Spark picks broadcast or sort-merge by the sizes it knows; nothing here forces a side into memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import has_text
from quirefold.tables import fresh


def fresh_of(left: DataFrame, right: DataFrame, name: str) -> tuple[str, ...]:
    """A helper name that neither side has."""
    return fresh(left.join(right.limit(0), F.lit(True)), name)


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last in order: an aggregate with partial sums, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    (row,) = fresh(df, "row")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias(row)).select(*keys, f"{row}.*")


def with_document(images: DataFrame, documents: DataFrame, key: str, order: str) -> DataFrame:
    """Images with the last document of their stem; has_document tells the misses. Documents without image go."""
    (there,) = fresh_of(images, documents, "there")
    return images.join(last_of(documents, [key], order).withColumn(there, F.lit(True)), key, "left").withColumn("has_document", F.coalesce(there, F.lit(False))).drop(there)


def pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with the same stem."""
    return left.join(right, key)


def with_sidecars(pages: DataFrame, key: str, **sidecars: DataFrame) -> DataFrame:
    """Pages with their sidecars, each left-joined on the stem."""
    return reduce(lambda found, side: found.join(side, key, "left"), sidecars.values(), pages)


def with_work(pages: DataFrame, works: DataFrame, key: str = "work") -> DataFrame:
    """Pages with what is known of their work."""
    return pages.join(works, key, "left")


def having(df: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Rows whose asset exists."""
    return df.join(assets.select(key), key, "left_semi")


def lacking(df: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Rows whose asset doesn't exist yet: the work that is left."""
    return df.join(assets.select(key), key, "left_anti")


def with_guess(truth: DataFrame, guesses: DataFrame, key: str, truth_text: Column) -> DataFrame:
    """Reference texts that aren't empty with the guess for them (null: missing) and a status."""
    (there,) = fresh_of(truth, guesses, "there")
    found = truth.where(has_text(truth_text)).join(guesses.withColumn(there, F.lit(True)), key, "left")
    return found.withColumn("status", F.when(F.col(there), "ok").otherwise("puudub")).drop(there)


def every_model(truth: DataFrame, guesses: DataFrame, key: str, truth_text: Column, model: str = "model") -> DataFrame:
    """Each reference text with the guess of each model that left any.

    Each text is repeated once a model, however many there are, which is the result's own size.
    """
    (there,) = fresh_of(truth, guesses, "there")
    wide = truth.where(has_text(truth_text)).join(guesses.select(model).distinct(), F.lit(True))
    found = wide.join(guesses.withColumn(there, F.lit(True)), [key, model], "left")
    return found.withColumn("status", F.when(F.col(there), "ok").otherwise("puudub")).drop(there)
