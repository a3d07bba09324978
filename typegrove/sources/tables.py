"""Uploaded tables: CSV and XLSX files of bounded size as rows of cells, with the spreadsheet's row numbers.

A file is one unit: it is read whole by one task (it may hold at most ``MOST_BYTES``), and any number of files spread
over the cluster. A file that breaks a rule gives one row with ``error`` and no cells.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits of an import file.
MOST_BYTES, MOST_ROWS, MOST_COLUMNS, MOST_HEADER, MOST_CELL = 5 * 1024 * 1024, 2000, 100, 200, 10_000
MOST_UNPACKED, MOST_RATIO = 50 * 1024 * 1024, 200
SCHEMA = "path string, sha256 string, row_number int, headers array<string>, cells array<string>, error string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


class TableError(ValueError):
    pass


def csv_rows(data: bytes) -> list[list[str | None]]:
    if b"\x00" in data:
        raise TableError("the file holds NUL bytes")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise TableError("the file is not UTF-8") from None
    csv.field_size_limit(MOST_BYTES)
    return [[c or None for c in row] for row in csv.reader(io.StringIO(text, newline=""), strict=True)]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


#: Built-in number formats that show a date, a time, or both (fixed by the file format).
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.iterfind("m:numFmts/m:numFmt", _NS):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        if re.search("[dmyhs]", bare, re.I):
            dates.add(int(f.get("numFmtId")))
    return {n for n, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in dates}


def _serial(text: str, from_1904: bool) -> str:
    """A day number as an ISO date, or date and time where it has a fraction. Day 60 of 1900 never was."""
    days = float(text)
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if days >= 61 else datetime(1899, 12, 31)
    at = first + timedelta(seconds=round(days * 86400))
    return at.strftime("%Y-%m-%d") if days == int(days) else at.strftime("%Y-%m-%dT%H:%M:%S")


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the only sheet, formulas by their stored values; error cells are refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise TableError("the file is not a workbook") from None
    total = sum(i.file_size for i in z.infolist())
    if total > MOST_UNPACKED or total > MOST_RATIO * max(1, len(data)):
        raise TableError("the workbook unpacks to too much")
    sheets = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
    if len(sheets) != 1:
        raise TableError("the workbook must have one sheet")
    dates = _date_styles(z)
    from_1904 = "xl/workbook.xml" in z.namelist() and re.search(rb'date1904="(1|true)"', z.read("xl/workbook.xml")) is not None
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    rows: list[list[str | None]] = []
    for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{{{_NS['m']}}}row"):
        number = int(row.get("r", len(rows) + 1))
        while len(rows) < number:
            rows.append([])
        for c in row.findall("m:c", _NS):
            at, kind, v = _column(c.get("r", "A1")), c.get("t", "n"), c.find("m:v", _NS)
            if kind == "e":
                raise TableError(f"cell {c.get('r')} holds an error")
            if c.find("m:f", _NS) is not None and v is None:
                raise TableError(f"cell {c.get('r')} has a formula without a stored value")
            text = None if v is None else v.text
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b":
                text = "true" if text == "1" else "false"
            elif kind == "n" and text is not None and int(c.get("s", 0)) in dates:
                text = _serial(text, from_1904)
            elif kind == "n" and text is not None and re.fullmatch(r"-?\d+\.0+", text):
                text = text.split(".")[0]
            out = rows[number - 1]
            out += [None] * (at + 1 - len(out))
            out[at] = text or None
    return rows


def table(rows: list[list[str | None]]) -> tuple[list[str], list[tuple[int, list[str | None]]]]:
    """Headers and numbered rows: blank rows skipped, the first other one is the header, short rows padded, wide ones refused."""
    headers: list[str] | None = None
    out = []
    for n, raw in enumerate(rows, 1):
        row = list(raw)
        while row and (row[-1] is None or not row[-1].strip()):
            row.pop()
        if not row:
            continue
        if headers is None:
            headers = [(h or "").strip() or f"Column {i}" for i, h in enumerate(row, 1)]
            if len(headers) > MOST_COLUMNS or any(len(h) > MOST_HEADER for h in headers):
                raise TableError("too many columns or too long a header")
            if len(set(headers)) < len(headers):
                raise TableError("two columns have one header")
            continue
        if len(row) > len(headers):
            raise TableError(f"row {n} has more cells than the header")
        if any(c and len(c) > MOST_CELL for c in row):
            raise TableError(f"row {n} has too long a cell")
        out.append((n, row + [None] * (len(headers) - len(row))))
        if len(out) > MOST_ROWS:
            raise TableError(f"more than {MOST_ROWS} rows")
    if headers is None or not out:
        raise TableError("the file has no rows")
    return headers, out


PARSERS = {"csv": csv_rows, "xlsx": xlsx_rows}


def parse(name: str, data: bytes) -> tuple[list[str], list[tuple[int, list[str | None]]]]:
    if len(data) > MOST_BYTES:
        raise TableError("the file is too large")
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in PARSERS:
        raise TableError(f"{kind} files can't be read here")
    try:
        return table(PARSERS[kind](data))
    except (csv.Error, ElementTree.ParseError, KeyError, IndexError) as e:
        raise TableError(str(e)) from None


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        out = []
        for path, data in zip(batch["path"], batch["content"]):
            data = bytes(data)
            sha = hashlib.sha256(data).hexdigest()
            try:
                headers, rows = parse(path, data)
                out += [(path, sha, n, headers, cells, None) for n, cells in rows]
            except TableError as e:
                out.append((path, sha, None, None, None, str(e)))
        yield pd.DataFrame(out, columns=["path", "sha256", "row_number", "headers", "cells", "error"]).astype({"row_number": "Int32"})


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files at a path or pattern: path, sha256, row_number, headers, cells, error."""
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.substring("content", 1, MOST_BYTES + 1))
    return files.select("path", content.alias("content")).mapInPandas(_parse_files, SCHEMA)


def columns_of(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Parsed rows with the named headers' cells as columns; ``columns``: header -> column."""
    cells = [F.get("cells", F.array_position("headers", F.lit(h)).cast("int") - 1).alias(c) for h, c in columns.items()]
    return rows.where("error is null").select("path", "row_number", *cells)


def preview(rows: DataFrame, n: int = 5, width: int = 80) -> DataFrame:
    return rows.where("error is null").orderBy("path", "row_number").limit(n).withColumn("cells", F.transform("cells", lambda c: F.left(c, F.lit(width))))


def read_texts(spark: SparkSession, path: str, most_chars: int = 100_000) -> DataFrame:
    """Plain text files as evidence: path, text cut to ``most_chars``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.left(F.decode("content", "utf-8"), F.lit(most_chars)).alias("text"))
