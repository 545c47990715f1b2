"""Spreadsheets (xlsx) as rows of text cells, read from any store that Spark reads, without a spreadsheet library.

Each file's active sheet gives its header and its rows that aren't blank throughout. A row wider than the header, or without one of
the mandatory cells, comes with `problem`; so does a file that can't be read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS = "file_name string, sheet_name string, source_row_number int, header array<string>, cells array<string>, problem string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def active_sheet(content: bytes) -> tuple[str, list[tuple[int, list[str | None]]]]:
    """Name and rows (number, cells) of a workbook's active sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [text_of(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        sheets = root.findall(f"{MAIN}sheets/{MAIN}sheet")
        view = root.find(f"{MAIN}bookViews/{MAIN}workbookView")
        sheet = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheet.get(LINK)].lstrip("/")
        data = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for at, row in enumerate(data.iter(f"{MAIN}row"), 1):
        cells: list[str | None] = []
        for k, c in enumerate(row.iter(f"{MAIN}c")):
            k = column_number(c.get("r")) if c.get("r") else k
            cells += [None] * (k + 1 - len(cells))
            value = c.find(f"{MAIN}v")
            if c.get("t") == "inlineStr":
                cells[k] = text_of(c)
            elif value is not None and value.text is not None:
                cells[k] = shared[int(value.text)] if c.get("t") == "s" else value.text
        rows.append((int(row.get("r", at)), cells))
    return sheet.get("name"), rows


def records(name: str, content: bytes, mandatory: Sequence[str]) -> Iterator[tuple]:
    try:
        sheet, rows = active_sheet(content)
    except Exception as e:  # whatever is wrong with one file is that file's row
        yield name, None, None, None, None, f"unreadable workbook: {type(e).__name__}"
        return
    header: list[str] | None = None
    for number, cells in rows:
        if not any((c or "").strip() for c in cells):
            continue
        if header is None:
            header = [(c or "").strip() for c in cells]
            if "" in header or len(set(header)) < len(header) or (set(mandatory) - set(header)):
                yield name, sheet, number, header, None, "header must be complete and unique"
                return
            continue
        own = cells + [None] * (len(header) - len(cells))
        lost = [m for m in mandatory if not (own[header.index(m)] or "").strip()]
        problem = "row is wider than the header" if len(cells) > len(header) else f"missing {lost[0]}" if lost else None
        yield name, sheet, number, header, own, problem


def read_workbooks(spark: SparkSession, path: str, mandatory: Sequence[str] = ()) -> DataFrame:
    """ROWS of all workbooks under a path."""
    wanted = tuple(mandatory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in records(p.rsplit("/", 1)[-1], bytes(c), wanted)]
            out = pd.DataFrame(rows, columns=["file_name", "sheet_name", "source_row_number", "header", "cells", "problem"])
            out["source_row_number"] = out["source_row_number"].astype("Int32")
            yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)
