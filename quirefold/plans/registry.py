"""Queries over the driver tables and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.tables import bounded, dealt

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("curation", "pairing", "texts", "audits", "documents", "streams", "times")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that must agree."""

    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql:
            _oracles[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """For queries whose Python functions cost far more than the reading: rows dealt out where a table is few files."""
    return dealt(read(spark, sf_dir, table))


def trimmed(text: str) -> str:
    """SQL for the text without Unicode blanks at either end."""
    blank = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace({text}, '^{blank}+|{blank}+$', '', 'g')"


def by_bytes(a: str, b: str) -> str:
    """SQL for the edit distance by code points, with DuckDB's levenshtein, which counts bytes."""
    both = f"({a} || coalesce({b}, ''))"
    odd = rf"list_sort(list_distinct(regexp_extract_all({both}, '[^\x00-\x7F]')))"
    free = f"list_filter(list_transform(range(1, 128), lambda i: chr(i::INT)), lambda c: NOT contains({both}, c))"
    ascii_of = lambda x: f"translate({x}, array_to_string({odd}, ''), array_to_string({free}, ''))"
    return f"CASE WHEN len({odd}) > len({free}) THEN error('too many distinct characters') ELSE levenshtein({ascii_of(a)}, {ascii_of(b)}) END"


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quirefold.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
