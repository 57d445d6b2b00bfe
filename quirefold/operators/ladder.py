"""First-match ladders: every row gets the first test it fails, or ok."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import has_text, long_enough

OK = "ok"


def reason(tests: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first test that is true; tests that are null count as false."""
    return F.coalesce(*(F.when(test, name) for name, test in tests), F.lit(OK))


def page_tests(document: Column, status: Column, text: Column, kept: Column, cleaned: Column, done: Sequence[str] = ("Valmis",)) -> list[tuple[str, Column]]:
    """The order in which pages of works are judged."""
    return [
        ("no_json", document.isNull()),
        ("status", ~F.coalesce(status.isin(list(done)), F.lit(False))),
        ("no_txt", text.isNull()),
        ("empty", ~has_text(text)),
        ("wrong_type", ~kept),
        ("empty", ~has_text(cleaned)),
    ]


def archive_tests(has_document: Column, text: Column, readable: Column, lines: int) -> list[tuple[str, Column]]:
    """The order in which pages of archives and data sets are judged."""
    return [("xml_puudub", ~has_document), ("xml_viga", text.isNull()), ("liiga_lühike", ~long_enough(text, lines)), ("pildi_viga", ~readable)]


def census(df: DataFrame, column: str = "reason") -> DataFrame:
    """Rows per reason; the counts add up to the input."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def changed(before: Column, after: Column) -> Column:
    """Number of rows that a cleaning step changed."""
    return F.count_if(~before.eqNullSafe(after))
