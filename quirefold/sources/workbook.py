"""A sink: exported rows as a spreadsheet file with one sheet, written with the standard library.

A workbook is one file, so its rows pass through the driver, one partition at a time; more rows than a sheet can hold
are an error, never cut. Large exports are written with Spark's own formats (operators.export.write).
"""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

# The headers, the column widths, the font of legacy text and the row limit of the file format.
HEADERS = ("Full Question", "Question", "Answers", "Correct Answer")
COLUMNS = ("full_question", "question", "answers", "correct_answer")
WIDTHS = (70, 45, 45, 28)
LEGACY_FONT = "FMAbhaya"
MOST_ROWS = 1_048_576

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _cell(column: int, row: int, text: str, style: int) -> str:
    kept = "".join(c for c in text or "" if c in "\t\n\r" or ord(c) >= 32)
    return f'<c r="{chr(65 + column)}{row}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(kept)}</t></is></c>'


def _styles(font: str) -> str:
    cell = f'<font><sz val="11"/><name val="{font}"/></font>'
    return f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2">{cell}<font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0" applyFont="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'


def write_workbook(exported: DataFrame, path: str, mode: str = "unicode") -> int:
    """Write rows of operators.export.rows in order of number to a local path; gives the number of rows."""
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Questions" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _styles(LEGACY_FONT if mode == "legacy" else "Calibri"),
    }
    row = 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(WIDTHS, 1))
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><cols>{columns}</cols><sheetData><row r="1">{"".join(_cell(i, 1, h, 1) for i, h in enumerate(HEADERS))}</row>'.encode())
            for record in exported.orderBy("number", exported.columns[0]).select(*COLUMNS).toLocalIterator():
                row += 1
                if row > MOST_ROWS:
                    raise ValueError("more rows than a sheet can hold")
                sheet.write(f'<row r="{row}">{"".join(_cell(i, row, t, 0) for i, t in enumerate(record))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return row - 1
