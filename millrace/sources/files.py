"""Tables and documents in files, read by Spark."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet's block, paragraphs of a batch, hits of a search.
BLOCK_ROWS, BATCH_PARAGRAPHS, MOST_HITS = 500, 50, 30
UNITS = "path string, unit_no int, text string, table_count int"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SHEET, _WORD = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def delimited(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte order mark is not part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df.limit(rows) if rows else df


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A live database's table, read in ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def search(spark: SparkSession, path: str, words: str, pattern: str = "*", hits: int = MOST_HITS, most_bytes: int | None = None) -> DataFrame:
    """(path, line_no, line) of the first lines that hold the words in either case; ``most_bytes`` leaves larger files out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    files = files if most_bytes is None else files.where(F.col("length") <= most_bytes)
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("n", "line"))
    return lines.where(F.contains(F.lower("line"), F.lit(words.lower()))).select("path", (F.col("n") + 1).alias("line_no"), "line").orderBy("path", "line_no").limit(hits)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(styles: bytes | None) -> set[int]:
    """Numbers of the cell styles that show a date or time, by built-in format or by the letters of its own."""
    if styles is None:
        return set()
    root = ET.fromstring(styles)
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code)
    dated = DATE_FORMATS | {int(f.get("numFmtId")) for f in root.iter(f"{_SHEET}numFmt") if re.search("[ymdhs]", plain(f.get("formatCode") or ""), re.I)}
    cells = root.find(f"{_SHEET}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId") or 0) in dated}


def _date(number: str, since_1904: bool) -> str:
    """A serial number as date and time, or as a time alone below one day; of the 1900 dates, none is the 29th of February."""
    try:
        days = float(number)
    except ValueError:
        return number
    seconds = round(days * 86400)
    if 0 <= days < 1:
        return str((datetime(1900, 1, 1) + timedelta(seconds=seconds)).time())
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    try:
        return str(start + timedelta(seconds=seconds))
    except OverflowError:
        return number


def sheet_rows(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of a workbook's sheets; merged cells repeat their first cell's value.

    Dates come out as date and time, booleans as True and False. Rows and cells may lack their references: they then
    follow the one before them.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        # a sheet's file is what the workbook's relations say, whatever its place or number
        targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        since_1904 = any(e.get("date1904") in ("1", "true") for e in book.iter(f"{_SHEET}workbookPr"))
        sheets = [(e.get("name"), targets[e.get(_RELATION)]) for e in book.iter(f"{_SHEET}sheet")]

        def shown(c: ET.Element) -> str:
            value, kind = c.find(f"{_SHEET}v"), c.get("t")
            got = text(c) if kind == "inlineStr" else (value.text or "" if value is not None else "")
            if kind == "s" and got:
                return shared[int(got)]
            if kind == "b" and got:
                return str(got in ("1", "true"))
            return _date(got, since_1904) if kind in (None, "n") and got and int(c.get("s") or 0) in dated else got

        out = []
        for title, target in sheets:
            root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            r = -1
            for row in root.iter(f"{_SHEET}row"):
                r, c = int(row.get("r")) - 1 if row.get("r") else r + 1, -1
                for cell in row.iter(f"{_SHEET}c"):
                    c = _column(cell.get("r")) if cell.get("r") else c + 1
                    cells[r, c] = shown(cell)
            for m in root.iter(f"{_SHEET}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                top, left = int(re.sub("[A-Z]", "", a)) - 1, _column(a)
                for r in range(top, int(re.sub("[A-Z]", "", b or a))):
                    for c in range(left, _column(b or a) + 1):
                        cells[r, c] = cells.get((top, left), "")
            height, width = (1 + max((k[j] for k in cells), default=-1) for j in (0, 1))
            out.append((title, [[cells.get((r, c), "") for c in range(width)] for r in range(height)]))
        return out


def _sheet_units(data: bytes) -> Iterator[tuple[str, int]]:
    for title, rows in sheet_rows(data):
        header, body = rows[:1], rows[1:]
        for i in range(0, len(body) or 1, BLOCK_ROWS):
            block = [" | ".join(r) for r in header + body[i : i + BLOCK_ROWS]]
            if block:
                yield f"{title}\n" + "\n".join(block), 1


def workbook(spark: SparkSession, path: str, sheet: str | None = None, rows: int | None = None) -> DataFrame:
    """A workbook's sheet (the first, if none is named) as a table of texts; its first row names the columns.

    Blank names become ``column_n``, repeated ones get their place; the header is read on the driver, the rows in tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def chosen(data: bytes) -> list[list[str]]:
        return next((r for title, r in sheet_rows(data) if sheet in (None, title)), [])

    header = (chosen(bytes(files.first()["content"])) or [[]])[0]
    names: list[str] = []
    for i, h in enumerate(header, 1):
        name = h.strip() or f"column_{i}"
        names.append(name if name not in names else f"{name}_{i}")
    if not names:
        raise ValueError(f"no sheet {sheet}" if sheet else "no rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                body = chosen(data)[1:]
                yield pd.DataFrame([(r + [""] * len(names))[: len(names)] for r in body], columns=names, dtype=str)

    out = files.mapInPandas(run, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    return out.limit(rows) if rows else out


def _word_units(data: bytes) -> Iterator[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    paragraphs = [t for e in body.findall(f"{_WORD}p") if (t := text(e)).strip()]
    for i in range(0, len(paragraphs), BATCH_PARAGRAPHS):
        yield "\n".join(paragraphs[i : i + BATCH_PARAGRAPHS]), 0
    for t in body.findall(f"{_WORD}tbl"):
        yield "\n".join(" | ".join(text(c) for c in row.findall(f"{_WORD}tc")) for row in t.findall(f"{_WORD}tr")), 1


def _pdf_units(data: bytes) -> Iterator[tuple[str, int]]:
    import fitz  # not everywhere: a job that meets a PDF without it fails by name

    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            yield page.get_text(), len(page.find_tables().tables)


READERS = {".xlsx": _sheet_units, ".docx": _word_units, ".pdf": _pdf_units}


def units(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, unit_no, text, table_count) of workbooks, Word files and PDFs, one file a task at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                read = next((f for end, f in READERS.items() if name.lower().endswith(end)), None)
                found = list(read(content)) if read else []
                yield pd.DataFrame([(name, i, t, n) for i, (t, n) in enumerate(found, 1)], columns=["path", "unit_no", "text", "table_count"])

    return files.select("path", "content").mapInPandas(run, UNITS)
