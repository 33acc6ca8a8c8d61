"""Rows of HTML tables: the one place where markup nesting needs a parser instead of expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.tables import computed_once

TABLES_SCHEMA = "page_id bigint, table_rows array<struct<table_no:int,row_no:int,cells:array<string>>>"

# Words that mark the wanted table and its header row, and the row date shape.
NAME_WORDS = ("şirket", "sirket")
DATE_WORDS = ("tarih",)
DATE_SHAPE = r"^\d{1,2}\.\d{1,2}\.\d{4}$"

OPENING, CLOSING = frozenset(("table", "tr", "td", "th")), frozenset(("/table", "/tr", "/td", "/th"))
# A plain tag, its attributes quoted; the group holds the name, with a slash before it where the tag closes.
PLAIN_TAG = re.compile(r"""<(/?[a-zA-Z][a-zA-Z0-9]*)(?:>|(?:[ \t\r\n\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*[ \t\r\n\f]*>)""")
# Elements whose content is no markup for the parser, in any of its versions.
RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "noscript", "plaintext", "svg", "math"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.tables = 0
        self.open_tables: list[int] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.row_counts: dict[int, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open_tables.append(self.tables)
            self.tables += 1
        elif tag == "tr" and self.open_tables:
            self.close_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "table" and self.open_tables:
            self.close_row()
            self.open_tables.pop()

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append("".join(self.cell))
        self.cell = None

    def close_row(self):
        self.close_cell()
        if self.row is not None and self.open_tables:
            number = self.open_tables[-1]
            self.row_counts[number] = self.row_counts.get(number, 0) + 1
            self.rows.append((number, self.row_counts[number], self.row))
        self.row = None


def read_tables(page: str) -> list[tuple[int, int, list[str]]]:
    """(table_no, row_no, cells) of every table row of one page.

    Where every ``<`` opens a plain tag, the page is split at its tags; any other page (comments, scripts, stray or unclosed signs) is left to the parser.
    """
    tables = _Tables()
    parts = PLAIN_TAG.split(page)
    tags = [t.lower() for t in parts[1::2]]
    if len(tags) != page.count("<") or not RAW_TEXT.isdisjoint(tags):
        tables.feed(page)
        tables.close()
        return tables.rows
    for tag, text in zip(tags, parts[2::2], strict=True):
        if tag in OPENING:
            tables.handle_starttag(tag, ())
        elif tag in CLOSING:
            tables.handle_endtag(tag[1:])
        if text and tables.cell is not None:
            tables.handle_data(unescape(text) if "&" in text else text)
    return tables.rows


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_rows): all table rows of a page, bounded by the page. Texts of pages without a table never reach Python."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, places, cells, cell_ends, row_ends = [], [], [], [0], [0]
            for page in batch.column("html").to_pylist():
                for number, place, row in read_tables(page) if page else ():
                    numbers.append(number)
                    places.append(place)
                    cells += row
                    cell_ends.append(len(cells))
                row_ends.append(len(numbers))
            texts = pa.ListArray.from_arrays(pa.array(cell_ends, pa.int32()), pa.array(cells, pa.string()))
            rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), texts], names=["table_no", "row_no", "cells"])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), rows)], names=["page_id", "table_rows"])

    some = F.contains(F.lower("html"), F.lit("<table"))
    return pages.select(F.col("page_id").cast("bigint"), F.when(some, F.col("html")).alias("html")).mapInArrow(read, TABLES_SCHEMA)


def html_table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells) of every table row."""
    return page_tables(pages).select("page_id", F.inline("table_rows"))


def _mentions(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _line(row: Column) -> Column:
    return F.lower(F.array_join(row["cells"], " "))


def _is_header(row: Column) -> Column:
    last = F.trim(F.try_element_at(row["cells"], F.lit(-1)))
    return _mentions(_line(row), NAME_WORDS) & _mentions(_line(row), DATE_WORDS) & ~last.rlike(DATE_SHAPE)


def application_rows(pages: DataFrame) -> DataFrame:
    """Data rows of each page's one fitting table: blank rows skipped, a leading header dropped, last two cells used.

    Adds ``reason`` to rows that are no record. A page with no or several fitting tables gives one row saying so. Row-local.
    """
    early = F.transform(F.filter("table_rows", lambda r: r["row_no"] <= 5), lambda r: F.struct(r["table_no"].alias("table_no"), _line(r).alias("line")))
    lined = computed_once(page_tables(pages), "_early", early)
    numbers = F.array_distinct(F.transform("_early", lambda r: r["table_no"]))
    openings = F.transform(numbers, lambda n: F.struct(n.alias("table_no"), F.array_join(
        F.transform(F.filter("_early", lambda r: r["table_no"] == n), lambda r: r["line"]), " ").alias("text")))
    fitting = F.filter(openings, lambda o: _mentions(o["text"], NAME_WORDS) & _mentions(o["text"], DATE_WORDS))
    chosen = computed_once(lined, "_fit", F.transform(fitting, lambda o: o["table_no"]))
    data = F.filter("table_rows", lambda r: (r["table_no"] == F.col("_fit")[0]) & F.exists(r["cells"], lambda c: c != ""))
    chosen = computed_once(chosen, "_data", F.when(F.size("_fit") == 1, data))
    headed = F.coalesce(_is_header(F.try_element_at("_data", F.lit(1))), F.lit(False))
    body = chosen.select("page_id", "_fit", F.posexplode_outer(F.when(headed, F.slice("_data", 2, F.size("_data"))).otherwise(F.col("_data"))).alias("_place", "_r"))
    kept = body.where(F.col("_r").isNotNull() | (F.size("_fit") != 1))
    cells = F.col("_r.cells")
    name, last = F.trim(F.try_element_at(cells, F.lit(-2))), F.trim(F.try_element_at(cells, F.lit(-1)))
    applied = F.try_to_date(last, "d.M.yyyy")
    reason = (
        F.when(F.size("_fit") == 0, "no fitting table").when(F.size("_fit") > 1, "several fitting tables")
        .when(F.size(cells) < 2, "too few cells").when(name == "", "empty name")
        .when(~last.rlike(DATE_SHAPE), "date does not match DD.MM.YYYY").when(applied.isNull(), "not a calendar date")
    )
    return kept.select(
        "page_id", F.coalesce(F.col("_place") + 1, F.lit(0)).alias("row_index"), name.alias("company_name"), applied.alias("application_date"),
        last.alias("application_date_raw"), cells.alias("raw_row"), reason.alias("reason"))
