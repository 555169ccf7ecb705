"""A sink for spreadsheets: every task writes its rows as one workbook file of a folder.

``spark.dataSource.register(SheetSource)`` once, then ``df.write.format("sheets").mode("overwrite").save(folder)``. The folder must be one
that driver and executors share as a mounted path. Rows are streamed into the file, so a task holds one row at a time. Files
are written under names of their own and take their final names when all tasks have succeeded; those of failed tasks
are removed. Sheets hold at most ``MOST_ROWS`` rows below the header, as the format allows: a task starts another file when one
is full.
"""

from __future__ import annotations

import datetime
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MOST_ROWS = 1_048_575
#: Characters that a cell may hold.
MOST_TEXT = 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def cell(value: object) -> str:
    """A cell; nulls are empty, what is no number or truth value is text, cut at what a cell may hold."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value}</v></c>"
    text = value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)
    legal = "".join(c if c >= " " and not 0xD800 <= ord(c) < 0xE000 and c not in "￾￿" or c in "\t\n\r" else " " for c in text[:MOST_TEXT])
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(legal)}</t></is></c>'


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SheetWriter(DataSourceWriter):
    def __init__(self, folder: str, title: str, columns: list[str], overwrite: bool):
        self.folder, self.title, self.columns, self.overwrite = folder, title, columns, overwrite
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        files: list[tuple[str, str]] = []
        rows = iter(rows)
        first = next(rows, None)
        while first is not None:
            name = f"part-{task.partitionId():05d}-{len(files):03d}-{self.run}.xlsx"
            own = os.path.join(self.folder, f"_writing-{task.taskAttemptId()}-{name}")
            files.append((own, os.path.join(self.folder, name)))
            first = self._file(own, first, rows)
        return Written(files)

    def _file(self, path: str, first: Row, rows: Iterator[Row]) -> Row | None:
        """Writes one workbook; returns the row that didn't fit any more."""
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for name, body in _PARTS.items():
                out.writestr(name, _HEAD + body)
            out.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(self.title)} sheetId="1" r:id="r1"/></sheets></workbook>')
            with out.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{frozen}<sheetData>'.encode())
                held: Row | None = first
                sheet.write(f"<row>{''.join(map(cell, self.columns))}</row>".encode())
                for _ in range(MOST_ROWS):
                    if held is None:
                        break
                    sheet.write(f"<row>{''.join(map(cell, held))}</row>".encode())
                    held = next(rows, None)
                sheet.write(b"</sheetData></worksheet>")
        return held

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.folder):
                if name.startswith("part-") and name.endswith(".xlsx"):
                    os.remove(os.path.join(self.folder, name))
        for own, final in (pair for m in messages if m for pair in m.files):
            os.replace(own, final)

    def abort(self, messages: list[Written | None]) -> None:
        for own, _ in (pair for m in messages if m for pair in m.files):
            if os.path.exists(own):
                os.remove(own)


class SheetSource(DataSource):
    """``format("sheets")``; options: ``path``, and ``title`` of the sheet (at most 31 characters)."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options["path"], self.options.get("title", "Sheet1")[:31], schema.names, overwrite)
