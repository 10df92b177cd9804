"""A3 — first sheet of many ``.xlsx`` workbooks, parsed in parallel.

Spark reads the files (``binaryFile``, so from any store it can reach), one row
a file, and tasks stream each sheet's XML row by row (``iterparse`` on the zipped
part, so no document tree is held): memory is a file's packed bytes, its shared
strings, and one batch of rows. A task emits whole rows as arrays of cell texts.
They are staged once; types are inferred and columns picked by position from
the stage, without a pivot or a shuffle of cells.

Cells formatted as dates (built-in and custom formats of the style table, 1900
and 1904 calendars) come as ISO text, and a column of nothing but dates becomes
a TIMESTAMP. A time of day is text ``HH:MM:SS``; an elapsed time (``[h]:mm``) stays
the number of days.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fit import collect_bounded, materialize
from .delimited import infer_types

#: Different header rows that the files of one call may have.
MAX_HEADERS = 10_000
MAX_COLUMNS = 16384
#: Cells in a batch that a task hands on.
BATCH_CELLS = 100_000
# The built-in number formats that show a date, and those that show a time of day alone.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58}
TIME_FORMATS = {18, 19, 20, 21, 45, 47}
_LITERALS = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', re.I)
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SCHEMA = "path string, header array<string>, row long, cells array<string>, dates array<int>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(z: zipfile.ZipFile, name: str, kind: str) -> Iterator[ET.Element]:
    """The ``kind`` elements of a part, one at a time; each is emptied, and its siblings dropped, once used."""
    with z.open(name) as stream:
        parents = []
        for event, element in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _local(element.tag) == kind:
                yield element
                if parents:
                    parents[-1].clear()


def _part(z: zipfile.ZipFile, target: str) -> str:
    target = target.lstrip("/")
    return target if target.startswith("xl/") else f"xl/{target}"


def _first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """The first sheet's part, and whether dates count from 1904."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = [e for e in book.iter() if _local(e.tag) == "sheet"]
    options = [e for e in book.iter() if _local(e.tag) == "workbookPr"]
    late = any(e.get("date1904") in ("1", "true") for e in options)
    relation = next((v for k, v in sheets[0].items() if k == _RELATION or _local(k) == "id"), None)
    for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if e.get("Id") == relation:
            return _part(z, e.get("Target")), late
    return "xl/worksheets/sheet1.xml", late


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_text(si) for si in _elements(z, "xl/sharedStrings.xml", "si")]


def _text(element: ET.Element) -> str:
    """A string item's text: plain or in runs, without the phonetic guides."""
    out = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def format_kind(code: str) -> str:
    """'date', 'time' or '' for a custom number format."""
    plain = _LITERALS.sub("", code.split(";")[0]).lower()
    if re.search(r"\[(h+|m+|s+)\]", plain):
        return ""
    if re.search("[yd]", plain) or ("m" in plain and not re.search("[hs]", plain) and "general" not in plain):
        return "date"
    return "time" if re.search("[hs]", plain) and "general" not in plain else ""


def _styles(z: zipfile.ZipFile) -> list[str]:
    """Per cell style 'date', 'time' or ''."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(e.get("numFmtId")): format_kind(e.get("formatCode", "")) for e in root.iter() if _local(e.tag) == "numFmt"}
    out = []
    for formats in (e for e in root if _local(e.tag) == "cellXfs"):
        for style in formats:
            n = int(style.get("numFmtId", "0"))
            out.append(custom.get(n, "date" if n in DATE_FORMATS else "time" if n in TIME_FORMATS else ""))
    return out


def date_text(serial: float, late: bool) -> str:
    """A date serial as ISO text to the microsecond."""
    start = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30 if serial >= 60 else 31)
    at = start + dt.timedelta(seconds=round(serial * 86400, 6))
    return at.isoformat(" ")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None], list[int]]]:
    """(row from 0, cell texts, columns that hold dates) of the first sheet's rows that have a cell."""
    z = zipfile.ZipFile(io.BytesIO(content))
    sheet, late = _first_sheet(z)
    strings, styles, last = _shared_strings(z), _styles(z), -1
    for row in _elements(z, sheet, "row"):
        last = int(row.get("r", last + 2)) - 1
        cells: list[str | None] = []
        dates = []
        for c in row:
            ref, kind = c.get("r"), c.get("t")
            at = _column(ref) if ref else len(cells)
            value = next((v.text for v in c if _local(v.tag) == "v"), None)
            if kind == "s" and value is not None:
                value = strings[int(value)]
            elif kind == "inlineStr":
                value = next((_text(v) for v in c if _local(v.tag) == "is"), None)
            elif kind == "b" and value is not None:
                value = "True" if value == "1" else "False"
            elif kind == "d" and value is not None:
                value = value.replace("T", " ")
                dates.append(at)
            elif kind in (None, "n") and value is not None:
                style = int(c.get("s", "0"))
                shown = styles[style] if style < len(styles) else ""
                if shown == "date":
                    value = date_text(float(value), late)
                    dates.append(at)
                elif shown == "time":
                    value = date_text(float(value) % 1 + 1, late).partition(" ")[2] or "00:00:00"
            if value is not None and 0 <= at < MAX_COLUMNS:
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value
        if cells:
            yield last, cells, dates


def _rows(batches):
    """(path, content) -> rows below each sheet's first, with its header; a sheet of a header alone gives one row numbered 0."""
    types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=["path", "header", "row", "cells", "dates"])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            header, rows, size, some = [], [], 0, False
            for number, cells, dates in sheet_rows(content.as_py()):
                if number == 0:
                    header = cells
                    continue
                rows.append((path.as_py(), header, number, cells, dates))
                size, some = size + len(cells) + len(header), True
                if size >= BATCH_CELLS:
                    yield batch_of(rows)
                    rows, size = [], 0
            if header and not some:
                rows.append((path.as_py(), header, 0, [], []))
            if rows:
                yield batch_of(rows)


def column_names(header: list[str | None], width: int) -> list[str]:
    """Names as pandas gives them: ``Unnamed: n`` where there is none, and the second ``x`` is ``x.1``."""
    out, seen = [], {}
    for k in range(max(width, len(header))):
        name = header[k] if k < len(header) and header[k] else f"Unnamed: {k}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def parse_workbooks(files: DataFrame) -> DataFrame:
    """The typed rows of workbooks given as (path, content) rows; see :func:`read_workbooks`."""
    spark = files.sparkSession
    staged = materialize(files.select("path", "content").mapInArrow(_rows, _SCHEMA))
    shapes = collect_bounded(staged.groupBy("header").agg(F.max(F.size("cells")).alias("width")), MAX_HEADERS)
    named = sorted(column_names(r["header"], r["width"]) for r in shapes)
    place: dict[str, int] = {}
    for names in named:
        for at, name in enumerate(names):
            place[name] = min(at, place.get(name, at))
    columns = sorted(place, key=lambda n: (place[n], n))
    if not columns:
        return spark.createDataFrame([], "struct<>")
    where = [(r["header"], [names.index(c) if c in names else -1 for c in columns])
             for r in shapes for names in [column_names(r["header"], r["width"])]]
    if len(where) == 1:
        picked = staged.withColumn("at", F.array(*[F.lit(k) for k in where[0][1]]))
    else:
        layouts = spark.createDataFrame(where, "header array<string>, at array<int>")
        picked = staged.join(F.broadcast(layouts), "header")  # at most MAX_HEADERS rows
    cells = [F.when(F.get("at", F.lit(k)) >= 0, F.get("cells", F.get("at", F.lit(k)))) for k in range(len(columns))]
    rows = picked.where(F.col("row") > 0)
    # A column is a date column if every cell in it is one.
    counts = rows.agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(cells)],
                      *[F.count_if(F.array_contains("dates", F.get("at", F.lit(k)))).alias(f"d{k}") for k in range(len(columns))]).first()
    dated = [counts[f"n{k}"] > 0 and counts[f"n{k}"] == counts[f"d{k}"] for k in range(len(columns))]
    texts = infer_types(rows.select(*[c.alias(f"c{k}") for k, c in enumerate(cells)]))
    return texts.select(*[(F.to_timestamp(F.col(f"c{k}")) if dated[k] else F.col(f"c{k}")).alias(n) for k, n in enumerate(columns)])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A3: rows of the first sheet of every workbook under ``path``, typed by A4, dates as TIMESTAMP.

    The first row names the columns; columns of the same name in several files
    join up, whatever their order. A row without any cell is none. Workbooks
    are staged once and every later step reads the stage.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return parse_workbooks(files)
