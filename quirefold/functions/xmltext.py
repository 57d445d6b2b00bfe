"""Text in reading order from PAGE, ALTO and TEI documents."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that a batch of pages holds before it is handed on; bytes that a parser gets at a time.
BATCH, FEED = 4 << 20, 1 << 20


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _child(node: ET.Element | None, name: str) -> ET.Element | None:
    return None if node is None else next((c for c in node if _local(c.tag) == name), None)


def page_parts(xml: str) -> tuple[str | None, bool]:
    """text and malformed of a PAGE document.

    Regions come in the order of the references in Page's own ReadingOrder (as often as referenced), then the others in
    file order; of regions with the same id the last counts, at the first's place. A line is the first Unicode of its
    first TextEquiv, up to the first element in it, trimmed; blank lines go; no lines at all is null.
    """
    try:
        page = _child(ET.fromstring(xml), "Page")
    except ET.ParseError:
        return None, True
    if page is None:
        return None, False
    regions = {r.get("id", ""): r for r in page if _local(r.tag) == "TextRegion"}
    order = _child(page, "ReadingOrder")
    asked = [] if order is None else [n.get("regionRef") for n in order.iter() if _local(n.tag) == "RegionRefIndexed"]
    named = set(asked)
    ordered = [r for r in asked if r in regions] + [r for r in regions if r not in named]
    nodes = (_child(_child(line, "TextEquiv"), "Unicode") for r in ordered for line in regions[r] if _local(line.tag) == "TextLine")
    return "\n".join(t for n in nodes if n is not None and (t := (n.text or "").strip())) or None, False


def page_xml(xml: Column) -> Column:
    """struct(text, malformed) of a column of PAGE documents, a page each: `page_parts`. Mixed content, and references that
    count in one place only, are more than a fixed schema can say."""

    def parts(some: pd.Series) -> pd.DataFrame:
        found = [page_parts(x) if x is not None else (None, None) for x in some]
        return pd.DataFrame({"text": pd.Series([t for t, _ in found], dtype=object), "malformed": pd.Series([m for _, m in found], dtype=object)})

    return F.pandas_udf(parts, "text string, malformed boolean")(xml)


class _Page:
    """A page's lines, each a list of cells that text flows into; some may be waiting for text that comes later in the file."""

    def __init__(self, facs: str, kind: str):
        self.facs, self.kind, self.lines, self.waiting, self.over = facs, kind, [[]], 0, False

    def row(self) -> tuple[str, str, str]:
        lines = ([t for cell in line if (t := "".join(cell).strip())] for line in self.lines)
        return self.facs, self.kind, "\n".join(" ".join(line) for line in lines if line)


class _Tei:
    """Events of a TEI document, as they are parsed, into pages that are handed on once nothing can be added to them."""

    def __init__(self, strict: bool):
        self.strict, self.ready = strict, []
        self.page: _Page | None = None
        self.open: list[tuple] = []  # of each open element of the body: whether its children count, and where its tail goes
        self.sink: list[str] | None = None
        self.body = self.ended = False
        self.skipped = 0  # open elements below one whose content is left out

    def _cell(self, page: _Page | None) -> list[str] | None:
        if page is None:
            return None
        cell: list[str] = []
        page.lines[-1].append(cell)
        return cell

    def _settle(self, page: _Page | None) -> None:
        if page is not None and page.over and not page.waiting:
            self.ready.append(page.row())

    def start(self, name: str, attributes: dict) -> None:
        name = _local(name)
        if self.ended:
            self.sink = None
        if self.ended or not self.body and name != "body":
            return
        self.body = True
        if self.skipped:
            self.skipped += 1
            return
        if name == "pb" and attributes.get("facs"):
            before, self.page = self.page, _Page(attributes["facs"], attributes.get("type", ""))
            if before is not None:
                before.over = True
                self._settle(before)
            self.open.append((None, None, "page"))
            self.sink, self.skipped = None, 1
            return
        if name == "lb":
            if self.page is not None:
                self.page.lines.append([])
            self.sink = None
        else:
            self.sink = self._cell(self.page) if name != "note" else None
        tail, page = None, self.page
        if not self.strict:  # the text after an element stands before its children's
            tail = self._cell(page)
            if page is not None:
                page.waiting += 1
        self.open.append((page, tail, name))
        if self.strict and name == "note":
            self.sink, self.skipped = None, 1

    def end(self, _: str) -> None:
        if self.ended:
            self._tail_over()
            self.sink = None
        if not self.body or self.ended:
            return
        if self.skipped > 1:
            self.skipped -= 1
            return
        self.skipped = 0
        self._tail_over()
        page, tail, name = self.open.pop()
        # the text after pb is dropped with what the page before it held, or belongs to the new page
        self.sink = self._cell(self.page) if self.strict else tail
        self.after = page if tail is not None else None
        if not self.open:
            self.ended = True

    after: _Page | None = None  # the page that the text after the last element goes to, until that text ends

    def _tail_over(self) -> None:
        if self.after is not None:
            page, self.after = self.after, None
            page.waiting -= 1
            self._settle(page)

    def text(self, data: str) -> None:
        if self.sink is not None and not self.skipped:
            self.sink.append(data)

    def finish(self) -> None:
        self._tail_over()
        if self.page is not None:
            self.page.over = True
            self._settle(self.page)


def _parsed(xml: str, found: _Tei | None) -> Iterator[None]:
    """Feeds a parser piece by piece; found gets the events."""
    parser = expat.ParserCreate("utf-8", "}")

    def other(data: str) -> None:
        if data.startswith("&"):
            raise ET.ParseError(f"undefined entity {data}")

    parser.DefaultHandlerExpand, parser.CharacterDataHandler = other, lambda _: None
    if found is not None:
        parser.buffer_text = True

        def start(name: str, attributes: dict) -> None:
            found._tail_over()
            found.start(name, attributes)

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, found.end, found.text
    for at in range(0, len(xml), FEED):
        parser.Parse(xml[at : at + FEED].encode("utf-8", "surrogatepass"), False)
        yield
    parser.Parse(b"", True)


def tei_pages(xml: str, strict_order: bool = False) -> Iterator[tuple[str, str, str]]:
    """Image address, kind and text of each page of a TEI body, each as soon as nothing can be added to it; none where the
    document is broken, which a first pass finds out.

    A page runs from its `pb` to the next; `lb` starts a line; a note's own text and the text after `pb` are left out.
    By default an element's following text is put before its children's text, as in the corpora made so far: a page waits
    for the end of the elements that were opened on it. strict_order gives document order instead. No tree is built: what is
    held is the pages that wait, at most one an open element.
    """
    try:
        for _ in _parsed(xml, None):
            pass
    except (ET.ParseError, expat.ExpatError, UnicodeError):
        return
    found = _Tei(strict_order)
    for _ in _parsed(xml, found):
        yield from found.ready
        found.ready.clear()
    found.finish()
    yield from found.ready


class TeiPages:
    """Handler of the lateral table function of SQL: one row a page."""

    def eval(self, xml: str):
        if xml is not None:
            yield from tei_pages(xml)


def tei_function():
    """The table function, for spark.udtf.register or direct calls; `tei_table` hands whole batches on."""
    return F.udtf(TeiPages, returnType="facs string, kind string, text string")


def tei_table(df: DataFrame, xml: str, *keys: str, strict_order: bool = False) -> DataFrame:
    """keys, facs, kind, text: a row for each page of each document, handed on in batches while the document is parsed."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "facs", "kind", "text"]

    def run(batches):
        for batch in batches:
            for i, document in enumerate(batch.column(len(keys))):
                rows, size = [], 0

                def out():
                    own = [pa.concat_arrays([batch.column(k).slice(i, 1)] * len(rows)) for k in range(len(keys))]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*own, *(pa.array([r[c] for r in rows], pa.string()) for c in range(3))], names)  # noqa: B023

                for row in tei_pages(document.as_py() or "", strict_order):
                    rows.append(row)
                    size += len(row[2])
                    if size > BATCH:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()

    return df.select(*keys, xml).mapInArrow(run, f"{kinds}, facs string, kind string, text string")


def _place(text: str) -> float:
    """A vertical place; nought where it can't be read."""
    try:
        value = float(text)
    except ValueError:
        return 0.0
    return value if math.isfinite(value) else 0.0


def alto_text(xml: str) -> str | None:
    """The text of an ALTO document: the lines of all text blocks, however deep they lie, by their vertical place (nought
    where it can't be read; ties in file order); the contents of a line's strings joined by a blank. None without lines, or where the document is broken."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    placed: list[tuple[float, str]] = []

    def walk(node: ET.Element, inside: bool) -> None:
        name = _local(node.tag)
        if name == "TextLine" and inside:
            words = [s.get("CONTENT", "") for s in node.iter() if _local(s.tag) == "String"]
            if text := " ".join(w for w in words if w.strip()):
                placed.append((_place(node.get("VPOS", "0")), text))
        else:
            for child in node:
                walk(child, inside or name == "TextBlock")

    walk(root, False)
    return "\n".join(text for _, text in sorted(placed, key=lambda p: p[0])) or None


def _alto_series(xml: pd.Series) -> pd.Series:
    return xml.map(alto_text, na_action="ignore")


def alto_xml(xml: Column) -> Column:
    """`alto_text` of a column: blocks lie at any depth, which a fixed schema can't say."""
    return F.pandas_udf(_alto_series, "string")(xml)


class TeiPages:
    """Handler of the lateral table function: one row a page."""

    def eval(self, xml: str):
        if xml is not None:
            yield from tei_pages(xml)


def tei_function():
    """The table function, for spark.udtf.register or direct calls."""
    return F.udtf(TeiPages, returnType="facs string, kind string, text string")
