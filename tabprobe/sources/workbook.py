"""Workbook directories (S4): every ``.xlsx`` file of a directory as one table.

``binaryFile`` lists the files; ``mapInPandas`` opens one workbook per row with the
standard library (zip + XML) and emits long cells (path, row, col, value, kind);
each workbook's header row names its columns, and a group-by on (path, row) with a pivot over
the names rebuilds the rows. Columns whose cells are all numbers
become double (or bigint when all are whole numbers); numbers that their cell's style shows as dates
become dates, or timestamps when one of the column has a time of day.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta
from itertools import count, islice
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.functions.exprs import col
from tabprobe.session import materialize

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)([0-9]+)")

# Kinds: n number, d date or time, s anything else.
CELL_SCHEMA = "path string, row long, col int, value string, kind string"
# Cells that a task holds at a time: those read from workbooks, and those of a workbook it writes.
CELLS = 100_000
# The number formats that the file format itself defines as dates and times of day.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
# Fixed value: the name of a column whose header cell is empty (i = column number).
EMPTY_HEADER = "column_{i}"


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _active_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    active = 0
    view = wb.find("m:bookViews/m:workbookView", _NS)
    if view is not None and view.get("activeTab"):
        active = int(view.get("activeTab"))
    sheets = wb.findall("m:sheets/m:sheet", _NS)
    rid = sheets[active].get(_REL)
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels:
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for f in root.findall("m:numFmts/m:numFmt", _NS):
        # Literals in quotes, escaped characters and [colours] say nothing about the value.
        code = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.get("formatCode", "").lower())
        if re.search("[ymdhs]", code) and "general" not in code:
            dates.add(int(f.get("numFmtId")))
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)) if int(xf.get("numFmtId", 0)) in dates}


def _instant(number: float, from_1904: bool) -> str | None:
    """A day number as ISO text, to the second; day 60 of the 1900 calendar does not exist, so days before it
    are one later."""
    if from_1904:
        base = datetime(1904, 1, 1)
    else:
        base = datetime(1899, 12, 31) if number < 60 else datetime(1899, 12, 30)
    try:
        return (base + timedelta(seconds=round(number * 86_400))).isoformat(sep=" ")
    except OverflowError:
        return None


def _rows_of(sheet) -> Iterator[ET.Element]:
    """The row elements of an open sheet; each is let go before the next is read."""
    data = None
    for event, element in ET.iterparse(sheet, events=("start", "end")):
        if event == "start":
            data = element if element.tag == f"{{{_NS['m']}}}sheetData" else data
        elif element.tag == f"{{{_NS['m']}}}row":
            yield element
            element.clear()
            if data is not None:
                data.clear()


def workbook_cells(path: str, content: bytes) -> Iterator[tuple]:
    """(path, row, col, value, kind) for every non-empty cell of the active sheet, read row by row."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    dated = _date_styles(z)
    props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    for r_i, row in enumerate(_rows_of(z.open(_active_sheet(z)))):
        r_num = int(row.get("r")) - 1 if row.get("r") else r_i
        for c_i, cell in enumerate(row.findall("m:c", _NS)):
            ref = cell.get("r")
            c_num = _col_index(_CELL.match(ref).group(1)) if ref else c_i
            t = cell.get("t", "n")
            kind = "n" if t == "n" else "s"
            if t == "inlineStr":
                node = cell.find("m:is", _NS)
                value = "".join(x.text or "" for x in node.iter(f"{{{_NS['m']}}}t")) if node is not None else None
            else:
                v = cell.find("m:v", _NS)
                value = v.text if v is not None else None
                if value is not None and t == "s":
                    value = shared[int(value)]
                elif value is not None and t == "b":
                    value = "True" if value == "1" else "False"
                elif value is not None and t == "d":
                    value, kind = value.replace("T", " ").removesuffix("Z"), "d"
                elif value is not None and t == "n" and int(cell.get("s", 0)) in dated:
                    instant = _instant(float(value), from_1904)
                    value, kind = (instant, "d") if instant is not None else (value, kind)
            if value is not None:
                yield path, r_num, c_num, value, kind


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cells = (cell for path, content in zip(pdf["path"], pdf["content"]) for cell in workbook_cells(path, bytes(content)))
        while part := list(islice(cells, CELLS)):
            yield pd.DataFrame(part, columns=["path", "row", "col", "value", "kind"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet of every workbook under ``path``; first row = header, an
    empty header cell -> ``column_{i}``; no cells -> an empty table.

    Each workbook is parsed once. Columns meet by their header's name, so workbooks may order them
    differently or lack some; of a name that one workbook repeats the leftmost column counts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    cells = materialize(files.mapInPandas(_cells, CELL_SCHEMA), "workbook_cells")
    header = cells.where("row = 0").select("path", "col", F.col("value").alias("name"))
    unnamed = F.concat(F.lit(EMPTY_HEADER.format(i="")), F.col("col").cast("string"))
    body = cells.where("row > 0").join(header, ["path", "col"], "left").withColumn("name", F.coalesce("name", unnamed))
    # One row per column name reaches the driver.
    named = header.select("name", "col").unionByName(body.select("name", "col")).groupBy("name").agg(F.min("col").alias("col"))
    names = [r["name"] for r in named.orderBy("col", "name").collect()]
    if not names:
        return spark.createDataFrame([], "_empty string").select()
    wide = (body.groupBy("path", "row").pivot("name", names)
            .agg(F.min_by("value", "col")))
    # Types: all-number columns become numbers, all-date columns dates.
    kinds = body.groupBy("name").agg(F.bool_and(F.col("kind") == "n").alias("num"), F.bool_and(F.col("kind") == "d").alias("dated"),
                                     F.bool_and(F.col("value").rlike(r"^-?[0-9]+$")).alias("whole"),
                                     F.bool_and(F.col("value").rlike(r"^[0-9-]+( 00:00:00)?$")).alias("days")).collect()
    kind = {r["name"]: ("bigint" if r["whole"] else "double") if r["num"] else ("date" if r["days"] else "timestamp_ntz") if r["dated"] else "string"
            for r in kinds}
    return wide.select(*[col(n).cast(kind.get(n, "string")).alias(n) for n in names])


# ------------------------------------------------------------------ writer (for round trips)

def _sheet_xml(header: list[str], rows: list[list]) -> str:
    def esc(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def ref(r: int, c: int) -> str:
        letters = ""
        c += 1
        while c:
            c, rem = divmod(c - 1, 26)
            letters = chr(65 + rem) + letters
        return f"{letters}{r + 1}"

    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>',
           f'<worksheet xmlns="{_NS["m"]}"><sheetData>']
    for r, values in enumerate([header] + rows):
        out.append(f'<row r="{r + 1}">')
        for c, v in enumerate(values):
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append(f'<c r="{ref(r, c)}"><v>{v!r}</v></c>')
            else:
                out.append(f'<c r="{ref(r, c)}" t="inlineStr"><is><t>{esc(str(v))}</t></is></c>')
        out.append("</row>")
    out.append("</sheetData></worksheet>")
    return "".join(out)


def workbook_bytes(header: list[str], rows: list[list]) -> bytes:
    """A minimal one-sheet workbook with inline strings and numbers."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}">'
                   '<sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet_xml(header, rows))
    return buf.getvalue()


def write_workbooks(df: DataFrame, directory: str) -> None:
    """Workbooks of at most ``CELLS`` cells, one or more per partition, under ``directory`` (a shared folder
    or object-store URI, written through pyarrow's filesystems), named by the partition number so a
    retried task overwrites its own files."""
    header = list(df.columns)

    def write_part(batches):
        from pyspark import TaskContext

        rows = (row for pdf in batches for row in pdf.astype(object).where(pdf.notna(), None).values.tolist())
        pid, most, n = TaskContext.get().partitionId(), max(1, CELLS // max(1, len(header))), 0
        for book in count():
            part = list(islice(rows, most))
            if book and not part:
                break
            write_book(f"/part-{pid:05d}{f'-{book:05d}' if book else ''}.xlsx", workbook_bytes(header, part))
            n += len(part)
        yield pd.DataFrame({"n": [n]})

    def write_book(name, data):
        target = directory.rstrip("/") + name
        from pyarrow import fs as pafs

        if "://" in target:
            filesystem, where = pafs.FileSystem.from_uri(target)
        else:
            filesystem, where = pafs.LocalFileSystem(), target[len("file:"):] if target.startswith("file:") else target
        filesystem.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(where) as fh:
            fh.write(data)

    df.mapInPandas(write_part, "n long").collect()
