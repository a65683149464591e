"""Exports of bounded results."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: rows of an export.
MOST_ROWS = 10_000


def csv(df: DataFrame, path: str, limit: int = MOST_ROWS) -> int:
    """One CSV file with a byte order mark and a header; an empty result is an error. Returns the rows."""
    import csv as writer

    rows = df.limit(min(limit, MOST_ROWS)).collect()
    if not rows:
        raise ValueError("nothing to export")
    out = io.StringIO()
    w = writer.writer(out)
    w.writerow(df.columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    _put(df.sparkSession, path, out.getvalue().encode("utf-8-sig"))
    return len(rows)


def folder_csv(df: DataFrame, path: str) -> None:
    """All rows as CSV part files, written where they are."""
    df.write.option("header", True).csv(path)


def sheet(df: DataFrame, path: str, title: str = "Sheet1", limit: int = MOST_ROWS) -> int:
    """One workbook with one sheet of at most 31 characters' title."""
    rows = [df.columns, *df.limit(min(limit, MOST_ROWS)).collect()]
    cell = lambda v: f'<c><v>{v}</v></c>' if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    column = lambda i: (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    lines = "".join(f'<row r="{r}">' + "".join(cell(v).replace("<c", f'<c r="{column(i)}{r}"', 1) for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    _put(df.sparkSession, path, out.getvalue())
    return len(rows) - 1


def markdown(df: DataFrame, hidden: set[str] = frozenset(), limit: int = 100) -> str:
    """A table for people: key and value lines for one row, a list for one column."""
    names = [c for c in df.columns if c not in hidden]
    rows = [[("" if r[c] is None else str(r[c])).replace("|", "\\|").replace("\n", " ") for c in names] for r in df.limit(limit).collect()]
    if len(rows) == 1 and len(names) > 1:
        return "\n".join(f"- **{c}**: {v}" for c, v in zip(names, rows[0], strict=True))
    if len(names) == 1:
        return "\n".join([f"**{names[0]}**", *[f"- {r[0]}" for r in rows]])
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)])


def markdown_tables(frames: dict[str, DataFrame], hidden: set[str] = frozenset(), limit: int = 100) -> str:
    """Several results under their names, those without rows said to be empty."""
    parts = []
    for name, df in frames.items():
        held = df.limit(limit).cache()
        parts.append(f"### {name}\n\n" + (markdown(held, hidden, limit) if held.limit(1).count() else "no rows"))
        held.unpersist()
    return "\n\n".join(parts)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and bytes of a folder's files, the newest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    files = [(f.getModificationTime(), f.getPath().getName(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(".")]
    return [(name, size) for _, name, size in sorted(files, reverse=True)]


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
