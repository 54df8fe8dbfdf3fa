"""Catalogues and lists in files of their own: CSV with or without a mark of byte order, and XLSX workbooks.

Spark lists and reads the files, whole and by whatever file system it knows; each file is parsed row by row in a task.
What can't be read becomes a row with an error, so that one bad file does not stop the others.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import Element, ParseError, iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.functions.text import header_key
from triplicate.operators.dictionary import HEADERS, infer_category

#: What may be uploaded, by its ending, and bytes at most.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".webp": "image/webp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
LARGEST = 200 * 1024 * 1024
#: Rows of cells in one Arrow batch.
_ROWS = 2000
_CELLS = "path string, sheet string, row int, cells array<struct<name: string, value: string>>, error string"
_TEXTS = "path string, text string, error string"


def media_type(name: Column) -> Column:
    """The type that a file's ending tells, null where it may not be uploaded."""
    out, lower = F.lit(None).cast("string"), F.lower(name)
    for ending, kind in MEDIA_TYPES.items():
        out = F.when(lower.endswith(ending), kind).otherwise(out)
    return out


def files(spark: SparkSession, *paths: str, largest: int = LARGEST) -> DataFrame:
    """path, length and content of all files below the paths; files larger than ``largest`` are not read: null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    small = found.where(F.col("length") <= largest).select("path", "length", "content")
    return small.unionByName(found.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("binary").alias("content")))


def _tag(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[Element]:
    """The elements of a name in one part of a workbook, each forgotten after its use; none where the part is missing."""
    if name not in book.namelist():
        return
    with book.open(name) as f:
        for _, e in iterparse(f):
            if _tag(e) == wanted:
                yield e
                e.clear()


def _said(e: Element) -> str:
    """An element's text runs in order, without phonetic ones."""
    if _tag(e) == "t":
        return e.text or ""
    return "".join(_said(x) for x in e if _tag(x) != "rPh")


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or time: one of their letters outside of quotes and brackets."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code.lower())))


class _Workbook:
    """Names and rows of a workbook's sheets, read in one pass each."""

    def __init__(self, content: bytes) -> None:
        self.book = zipfile.ZipFile(io.BytesIO(content))
        self.shared = [_said(e) for e in _elements(self.book, "xl/sharedStrings.xml", "si")]
        custom = {int(e.get("numFmtId", 0)): _is_date(e.get("formatCode", "")) for e in _elements(self.book, "xl/styles.xml", "numFmt")}
        built_in = {*range(14, 23), *range(45, 48)}  # fixed values: numbers of formats that need no declaration
        formats = [int(x.get("numFmtId", 0)) for e in _elements(self.book, "xl/styles.xml", "cellXfs") for x in e]
        self.dated = [custom.get(n, n in built_in) for n in formats]
        parts = {e.get("Id"): e.get("Target", "") for e in _elements(self.book, "xl/_rels/workbook.xml.rels", "Relationship")}
        key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        self.sheets = [(e.get("name", ""), parts.get(e.get(key), "")) for e in _elements(self.book, "xl/workbook.xml", "sheet")]
        self.active = next((int(e.get("activeTab", 0)) for e in _elements(self.book, "xl/workbook.xml", "workbookView")), 0)
        late = any(e.get("date1904") in ("1", "true") for e in _elements(self.book, "xl/workbook.xml", "workbookPr"))
        self.epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

    def _value(self, c: Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join(_said(x) for x in c if _tag(x) == "is")
        raw = next((x.text for x in c if _tag(x) == "v"), None)
        if raw is None or raw == "":
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return str(raw == "1")
        if kind == "n":
            number = float(raw) if re.search("[.eE]", raw) else int(raw)
            style = int(c.get("s", 0))
            if style < len(self.dated) and self.dated[style]:
                return str(self.epoch + timedelta(milliseconds=round(number * 86_400_000)))
            return str(number)
        return raw

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """Numbers and cells of rows that hold anything."""
        name = part[1:] if part.startswith("/") else f"xl/{part}"
        before = 0
        for e in _elements(self.book, name, "row"):
            before = int(e.get("r", before + 1))
            cells: list[str | None] = []
            for c in (x for x in e if _tag(x) == "c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                at = at or len(cells) + 1
                cells += [None] * (at - len(cells))
                cells[at - 1] = self._value(c)
            if any(v is not None for v in cells):
                yield before, cells


def _csv_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    csv.field_size_limit(LARGEST)
    for n, row in enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline="")), start=1):
        if row:
            yield n, row


def _records(path: str, content: bytes | None) -> Iterator[tuple[str | None, int, list | None, str | None]]:
    """sheet, row, named cells and error of a file's first sheet in view; its first row names the columns."""
    try:
        if content is None:
            raise ValueError("File too large")
        lower = path.lower()
        if lower.endswith(".csv"):
            sheet, rows = None, _csv_rows(content)
        elif lower.endswith(".xlsx"):
            book = _Workbook(content)
            sheet, part = book.sheets[book.active if book.active < len(book.sheets) else 0]
            rows = book.rows(part)
        else:
            raise ValueError("Unsupported file type — use .csv or .xlsx")
        names = next(rows, (0, []))[1]
        for n, row in rows:
            values = row[: len(names)] + [None] * (len(names) - len(row))
            yield sheet, n, [{"name": a, "value": b} for a, b in zip(names, values, strict=True)], None
    except (ValueError, LookupError, csv.Error, zipfile.BadZipFile, ParseError, OverflowError) as e:
        yield None, 0, None, str(e) or type(e).__name__


def _mapped(files: DataFrame, schema: str, of_file) -> DataFrame:
    """``of_file(path, content)``'s rows of every file, as columns after the path, in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, out = batch.column("path")[i].as_py(), []
                for row in of_file(path, batch.column("content")[i].as_py()):
                    out.append((path, *row))
                    if len(out) == _ROWS:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    # A file may fill a batch by itself: one row each.
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return files.select("path", "content").mapInArrow(run, schema)


def records(files: DataFrame) -> DataFrame:
    """path, sheet, row, cells (name and value, as texts) and error: rows of CSV files and of workbooks' sheets in view.

    ``files`` has path and content, as :func:`files` gives them. The first row names the columns and is no record; rows
    without any cell are left out; cells beyond the named columns are dropped, missing ones are null. A file of another
    kind, too large or broken gives one row with an error (a broken one after the rows before the fault).
    """
    return _mapped(files, _CELLS, _records)


def catalogues(rows: DataFrame) -> DataFrame:
    """path, row, code, description, category, confidence and error from :func:`records`.

    Of the columns of a file the first with a known name counts. Rows without a code are left out; a file without a column
    for codes gives one row with an error.
    """
    named = lambda field: F.filter("cells", lambda c: F.coalesce(header_key(c["name"]), F.lit("")).isin(*HEADERS[field]))
    cell = lambda field: F.trim(F.try_element_at(named(field), F.lit(1))["value"])
    lost = (F.size(named("code")) == 0) & F.col("error").isNull()
    found = rows.where(~lost).select(
        "path", "row", cell("code").alias("code"), cell("description").alias("description"), F.when(F.col("error").isNull(), infer_category(cell("category"))).alias("category"),
        F.when(F.col("error").isNull(), F.lit(1.0)).alias("confidence"), "error",
    )
    none = F.lit(None).cast("string")
    refused = rows.where(lost).groupBy("path").agg(F.lit("Could not find a code/SKU column in this file").alias("error"))
    refused = refused.select("path", F.lit(0).alias("row"), none.alias("code"), none.alias("description"), none.alias("category"), F.lit(None).cast("double").alias("confidence"), "error")
    return found.where(F.col("error").isNotNull() | (F.coalesce(F.length("code"), F.lit(0)) > 0)).unionByName(refused)


def _text_of(path: str, content: bytes | None) -> Iterator[tuple[str | None, str | None]]:
    try:
        if content is None:
            raise ValueError("File too large")
        book = _Workbook(content)
        sheets = []
        for name, part in book.sheets:
            lines = [" | ".join(v for v in cells if v is not None) for _, cells in book.rows(part)]
            sheets.append(f"--- SHEET: {name} ---\n" + "\n".join(lines))
        yield "\n\n".join(sheets), None
    except (ValueError, LookupError, zipfile.BadZipFile, ParseError, OverflowError) as e:
        yield None, str(e) or type(e).__name__


def sheet_texts(files: DataFrame) -> DataFrame:
    """path, text and error: every sheet of each workbook in order, a line before each and a line for each row."""
    return _mapped(files, _TEXTS, _text_of)


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook with these rows: numbers as numbers, other values as texts in place, None as no cell."""

    def cell(v: object) -> str:
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    numbers = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{MEDIA_TYPES[".xlsx"]}.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()
