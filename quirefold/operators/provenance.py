"""Where a page comes from and what it is: sources from file names, materials from work metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import file_name

UNKNOWN = "tundmatu"

# Fixed values of the corpus: (start of the file name after its number, source), tested in this order.
NAME_RULES = [
    (r"08\d{4}_", "kurrent_xix"),
    ("aaeb_", "aaeb_xiv_xvii"),
    ("bullinger_", "bullinger_autoren"),
    ("koenigsfelde", "koenigsfelden_adhr"),
    ("svea_", "svea_hovratt_seg"),
    ("bergskollegium_a", "bergskollegium_adv_seg"),
    ("bergskollegium_r", "bergskollegium_rel_seg"),
    ("bergskollegium_", "bergskollegium_seg"),
    ("gota_", "gota_hovratt_seg"),
    ("krigshovrattens_", "krigshovrattens_seg"),
    ("trolldomskommiss", "trolldomskommissionen_seg"),
    ("jonkopings_", "jonkopings_seg"),
    ("jonk_", "jonkopings_seg"),
    ("hanse_", "hanse_kurrent_xvi"),
]

# The identifiers of printed and handwritten works, and words in their labels.
PRINT_ID, HAND_ID = "Q1261026", "Q87167"
HAND_WORDS, PRINT_WORDS = ("käsikiri", "manuscript"), ("trükis", "printed")

#: Spellings of one source that different builders wrote.
CANONICAL = {"krigshovrattens_dombocker_seg": "krigshovrattens_seg"}


def source_of(path: Column, rules: Iterable[tuple[str, str]] = tuple(NAME_RULES)) -> Column:
    """The source a file name stands for: the first rule that fits, else unknown; null where there is no name.

    A counter has five digits, or from 100,000 on as many as it takes; then none of them leads with a zero, as identifiers do.
    """
    rest = F.regexp_replace(file_name(path), r"^(?:\d{5}|[1-9]\d{5,})_", "")
    hits = [F.when(rest.rlike("^" + start), source) for start, source in rules]
    return F.when(path.isNotNull(), F.coalesce(*hits, F.lit(UNKNOWN)))


def filled_source(source: Column, path: Column) -> Column:
    """The source, derived from the file name where it is null or empty."""
    return F.coalesce(F.nullif(source, F.lit("")), source_of(path))


def canonical_source(source: Column) -> Column:
    return F.coalesce(*(F.when(source == old, new) for old, new in CANONICAL.items()), source)


def only_sources(df: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), source_col: str = "source") -> DataFrame:
    """Rows of the included sources (all where none is named) without the excluded ones."""
    include, exclude = list(include), list(exclude)
    if include:
        df = df.where(F.col(source_col).isin(include))
    return df.where(~F.coalesce(F.col(source_col).isin(exclude), F.lit(False))) if exclude else df


def _mentions(label: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(label, F.lit(word))
    return found


def material_of(metadata: Column) -> Column:
    """print, hand or unknown, of a work's JSON metadata: `type` is an object with id and label, a string, or absent."""
    kind = F.get_json_object(metadata, "$.type")
    known = F.get_json_object(metadata, "$.type.id")
    is_object = F.coalesce(F.startswith(F.ltrim(kind), F.lit("{")), F.lit(False))
    label = F.lower(F.when(is_object, F.get_json_object(metadata, "$.type.label")).otherwise(kind))
    return (
        F.when(is_object & (known == PRINT_ID), "print")
        .when(is_object & (known == HAND_ID), "hand")
        .when(_mentions(label, HAND_WORDS), "hand")
        .when(_mentions(label, PRINT_WORDS), "print")
        .otherwise("unknown")
    )


def wanted_material(material: Column, wanted: str = "print", include_unknown: bool = False) -> Column:
    if wanted == "all":
        return F.lit(True)
    return (material == wanted) | F.lit(include_unknown) & (material == "unknown")


def page_status(document: Column) -> Column:
    """The status of a page's JSON: empty where the key is missing, null where the document can't be read."""
    return F.when(F.try_parse_json(document).isNotNull(), F.coalesce(F.get_json_object(document, "$.status"), F.lit("")))


def of_kind(pages: DataFrame, *kinds: str, column: str = "kind") -> DataFrame:
    """Pages of the given kinds (diary entries, unless told otherwise)."""
    return pages.where(F.col(column).isin(list(kinds or ("diaryEntry",))))
