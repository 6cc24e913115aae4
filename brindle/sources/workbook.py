"""A report as a spreadsheet of one sheet, written and read with the standard library: the Office Open XML format."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.io import write_bytes

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(place: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(columns: list[str], rows: list[tuple], sheet: str = "report") -> bytes:
    lines = [f'<row r="{r}">{"".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row))}</row>' for r, row in enumerate([tuple(columns), *rows], 1)]
    parts = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def sheet_rows(data: bytes) -> list[list]:
    """The first sheet's rows with None for empty cells; numbers, truth values and inline or shared strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{MAIN}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        tree = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    out = []
    for row in tree.iter(f"{{{MAIN}}}row"):
        values: dict[int, object] = {}
        for c in row.iter(f"{{{MAIN}}}c"):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r"))[0]:
                at = at * 26 + ord(letter) - 64
            kind, v = c.get("t", "n"), c.find(f"{{{MAIN}}}v")
            if kind == "inlineStr":
                values[at] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
            elif v is not None:
                values[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind == "str" else int(v.text) if re.fullmatch(r"-?\d+", v.text) else float(v.text)
        out.append([values.get(i) for i in range(1, max(values, default=0) + 1)])
    return out


def write_workbook(df: DataFrame, path: str) -> None:
    """A report table, which is small by nature."""
    write_bytes(df.sparkSession, path, workbook(df.columns, [tuple(r) for r in df.collect()]))


def read_workbook(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below the header, columns by the header's names."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    head, *rows = sheet_rows(data)
    wide = [dict(zip(head, [*r, *[None] * (len(head) - len(r))], strict=True)) for r in rows]
    empty = spark.createDataFrame([], schema)
    kinds = dict(empty.dtypes)
    cast = lambda c, v: float(v) if v is not None and kinds[c] == "double" else v
    return spark.createDataFrame([tuple(cast(c, r.get(c)) for c in empty.columns) for r in wide], schema)
