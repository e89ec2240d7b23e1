"""Workbooks and archives: reading a first sheet, writing small exports.

A workbook or an archive is one file for a person: its rows are bounded by the
format (1,048,576 a sheet), and the writer refuses more instead of cutting.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from datetime import datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import ColumnDef, header_keys, numeric_columns

SHEET_ROWS = 1_048_576
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> tuple[list[ColumnDef], DataFrame]:
    """(columns, rows) of a CSV file: slug keys, empty rows out, columns of numbers typed as such."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    return typed(raw)


def typed(raw: DataFrame) -> tuple[list[ColumnDef], DataFrame]:
    labels = raw.columns
    keys = header_keys(labels)
    rows = raw.toDF(*keys)
    filled = F.lit(False)
    for k in keys:
        filled = filled | (F.trim(F.coalesce(F.col(k), F.lit(""))) != "")
    rows = rows.where(filled)
    numeric = {r["column"] for r in numeric_columns(rows).where("numeric").collect()}  # a row for each column
    columns = [ColumnDef(k, label, "number" if k in numeric else "text") for k, label in zip(keys, labels, strict=True)]
    return columns, rows.select(*(F.regexp_replace(k, "[, ]", "").try_cast("double").alias(k) if k in numeric else F.col(k) for k in keys))


def first_sheet(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text; errors are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        name = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            at = 0
            for c in row.iter(f"{_NS}c"):
                if place := c.get("r"):  # a cell without a place follows the one before
                    at = 0
                    for x in re.match("[A-Z]+", place)[0]:
                        at = at * 26 + ord(x) - 64
                else:
                    at += 1
                v, kind = c.find(f"{_NS}v"), c.get("t")
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_NS}t")) or None
                cells[at - 1] = None if kind == "e" else shared[int(text)] if kind == "s" and text else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_workbook(spark: SparkSession, content: bytes) -> tuple[list[ColumnDef], DataFrame]:
    rows = first_sheet(content)
    if not rows:
        return [], spark.createDataFrame([], "empty string")
    width = max(map(len, rows))
    labels = [x or f"column {i + 1}" for i, x in enumerate((rows[0] + [None] * width)[:width])]
    keys = header_keys(labels)
    schema = ", ".join(f"`{k}` string" for k in keys)
    df = spark.createDataFrame([(r + [None] * width)[:width] for r in rows[1:]] or [], schema)
    columns, out = typed(df)
    return [ColumnDef(c.key, label, c.type) for c, label in zip(columns, labels, strict=True)], out


def sheet_names(names: Iterable[str]) -> list[str]:
    """At most 31 characters, none that the format forbids, no two alike."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
        new, n = base, 2
        while new.lower() in (x.lower() for x in out):
            new, n = f"{base[: 31 - len(str(n)) - 1]} {n}", n + 1
        out.append(new)
    return out


def _cell(value: object) -> str:
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(tables: dict[str, DataFrame]) -> bytes:
    """A workbook with a sheet for each table, at least one."""
    names = sheet_names(tables) or ["Sheet"]
    sheets = []
    for df in tables.values():
        if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows; write such a table as files")
        lines = ["<row>" + "".join(map(_cell, df.columns)) + "</row>"]
        lines += ["<row>" + "".join(map(_cell, row)) + "</row>" for row in df.toLocalIterator()]
        sheets.append("".join(lines))
    sheets = sheets or [""]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    } | {f"xl/worksheets/sheet{i}.xml": f'<worksheet xmlns="{main}"><sheetData>{s}</sheetData></worksheet>' for i, s in enumerate(sheets, 1)}
    return archive({n: ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + x).encode() for n, x in files.items()})


def archive(files: dict[str, bytes], at: datetime = datetime(1980, 1, 1)) -> bytes:
    """A ZIP of stored files; equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in files.items():
            info = zipfile.ZipInfo(name, (max(1980, at.year), at.month, at.day, at.hour, at.minute, at.second // 2 * 2))
            z.writestr(info, content)
    return out.getvalue()
