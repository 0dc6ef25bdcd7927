"""Spreadsheet workbooks: one file per task, rows out as text cells."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# built-in number formats that show a date or time
DATE_FORMAT_IDS = list(range(14, 23)) + list(range(45, 48))


def read_workbooks(spark: SparkSession, path: str, sheet: str | int | None = None) -> tuple[DataFrame, list[str]]:
    """Every workbook under ``path`` as one all-text table, and its header names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                chunk = []
                for number, cells in enumerate(sheet_rows(bytes(content), sheet)):
                    chunk.append((name, number, cells))
                    if len(chunk) == 5000:
                        yield pd.DataFrame(chunk, columns=["path", "number", "cells"])
                        chunk = []
                yield pd.DataFrame(chunk, columns=["path", "number", "cells"])

    cells = files.mapInPandas(rows, "path string, number bigint, cells array<string>")
    first = cells.where("number = 0").orderBy("path").limit(1).collect()
    header = [h or "" for h in first[0]["cells"]] if first else []
    body = cells.where("number > 0").select(*[F.get("cells", F.lit(i)).alias(f"_{i}") for i in range(len(header))])
    return body, header


def sheet_rows(content: bytes, sheet: str | int | None = None):
    """The rows of one sheet as lists of text, empty cells as None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        dates = _date_styles(book)
        with book.open(_sheet_file(book, sheet)) as handle:
            for _, row in ElementTree.iterparse(handle):
                if row.tag != MAIN + "row":
                    continue
                cells = []
                for cell in row.iter(MAIN + "c"):
                    at = _column_number(cell.get("r"), len(cells))
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell_text(cell, shared, dates)
                row.clear()
                yield cells


def _sheet_file(book, sheet):
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"))
    if isinstance(sheet, str):
        found = [s for s in sheets if s.get("name") == sheet]
        if not found:
            raise ValueError("no sheet named '%s'" % sheet)
        chosen = found[0]
    else:
        chosen = sheets[sheet or 0]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == chosen.get(LINK))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _shared_strings(book):
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in root.iter(MAIN + "si")]


def _date_styles(book):
    """Positions of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
    out = set()
    for at, style in enumerate(root.find(MAIN + "cellXfs") or []):
        number = int(style.get("numFmtId", "0"))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(number, ""))
        if number in DATE_FORMAT_IDS or re.search(r"[ymdhs]", code, re.IGNORECASE):
            out.add(at)
    return out


def _column_number(reference, default):
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return default
    number = 0
    for letter in letters.group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell, shared, dates):
    kind, value = cell.get("t"), cell.find(MAIN + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind in (None, "n") and int(cell.get("s", "0")) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(value.text) * 86400))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return value.text
