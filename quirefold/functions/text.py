"""Scalar text functions, as Column expressions that stay inside code generation."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII-only unless asked, and even then leaves out the separators 1C-1F; the corpus has no-break spaces, so
# blanks are all of these everywhere here.
_EDGE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
_SOLID = r"(?U)[^\s\x1C-\x1F]"


def trim_u(text: Column) -> Column:
    """The text without Unicode blanks at either end."""
    return F.regexp_replace(text, _EDGE, "")


def has_text(text: Column) -> Column:
    """True where something is left of the text after trimming; null counts as empty."""
    return F.coalesce(text.rlike(_SOLID), F.lit(False))


def n_lines(text: Column) -> Column:
    """Number of lines that hold more than blanks (null: 0)."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(_SOLID))), F.lit(0))


def long_enough(text: Column, lines: int) -> Column:
    return n_lines(text) >= lines


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", "")


def safe_part(name: Column, cut: int | None = None) -> Column:
    """Letters, digits, underscores and hyphens stay; the rest becomes underscores."""
    safe = F.regexp_replace(name, r"(?U)[^\w\-]", "_")
    return safe if cut is None else F.substring(safe, 1, cut)


def image_name(counter: Column, tag: Column | str, path: Column) -> Column:
    """00042_tag_stem.jpg"""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.format_string("%05d_%s_%s.jpg", counter, tag, safe_part(stem(path)))


def tag_cut_first(name: Column) -> Column:
    """The short tag of a data set name: twelve characters, hyphens to underscores."""
    return F.translate(F.substring(name, 1, 12), "-", "_")


def tag_replace_first(name: Column) -> Column:
    """The short tag of a data set name: unsafe characters to underscores, then sixteen characters."""
    return F.substring(F.regexp_replace(name, r"(?U)[^\w]", "_"), 1, 16)


def page_number(facs: Column, fallback: Column) -> Column:
    """The digits before `.tif`, else a five-digit counter."""
    return F.coalesce(F.nullif(F.regexp_extract(facs, r"(\d+)\.tif", 1), F.lit("")), F.format_string("%05d", fallback))


def natural_key(path: Column, width: int = 20) -> Column:
    """A string that sorts as people number files: every run of digits padded with zeros."""
    padded = F.regexp_replace(F.lower(path), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, r"0*(\d{" + str(width) + r"})(?!\d)", "$1")


def display(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)


# What precedes an answer in the chat formats, tested in this order.
_MARKERS = ("</assistant>", "<|assistant|>", "<|im_start|>assistant", "assistant\n")


def model_text(output: Column, special_tokens: bool = False) -> Column:
    """A model's answer: no thoughts, only what follows the chat markers, no code fence, no outer blanks."""
    text = F.regexp_replace(output, r"(?s)<think>.*?</think>", "")
    for marker in _MARKERS:
        at = F.locate(marker, text)
        text = F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)
    if special_tokens:
        text = F.regexp_replace(text, r"<\|.*?\|>", "")
    text = F.regexp_replace(trim_u(text), r"^```[a-z]*\n?", "")
    return trim_u(F.regexp_replace(text, r"\n?```$", ""))


def unfenced(output: Column) -> Column:
    """An API's answer without the code fence around it."""
    text = F.regexp_replace(trim_u(output), r"^```(markdown)?", "")
    return trim_u(F.regexp_replace(trim_u(text), r"```$", ""))


_SPELLED = {"ß": "ss", " ": "_"}
_PLAIN = frozenset(string.ascii_letters + string.digits + "_-.")


def ascii_name(name: str) -> str:
    """The name in letters, digits, `_`, `-` and `.`: one walk over its decomposed characters."""
    out: list[str] = []
    for mark in unicodedata.normalize("NFD", name):
        for c in _SPELLED.get(mark, mark):
            if c in _PLAIN and not (c == "_" and out[-1:] in ([], ["_"])):
                out.append(c)
    while out[-1:] == ["_"]:
        out.pop()
    return "".join(out)


def _ascii_series(names: pd.Series) -> pd.Series:
    return names.map(ascii_name, na_action="ignore")


def ascii_names(names: Column) -> Column:
    """ASCII file names: accents dropped, sharp s spelled out, blanks to underscores. Spark has no decomposition."""
    return F.pandas_udf(_ascii_series, "string")(names)
