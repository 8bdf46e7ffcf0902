"""Workbooks of the XLSX format, read by its ZIP and XML alone, and workbooks as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The format's numbers of built-in date and time formats.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: The days from which dates count.
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def is_date_format(number: int, code: str) -> bool:
    """Whether a number's format, built in or by its code, shows a date or a time."""
    return number in DATE_FORMATS or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()) is not None


def cell_text(number: float, epoch: datetime | None) -> str:
    """A number as text: a date where an epoch is given and it can be one."""
    if epoch is not None:
        try:
            return str(epoch + timedelta(seconds=round(number * 86_400)))
        except (OverflowError, ValueError):
            pass
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


class Workbook:
    """Cells of a workbook as text, cached values of formulas included; dates as YYYY-MM-DD hh:mm:ss."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book, links = self._xml("xl/workbook.xml"), self._xml("xl/_rels/workbook.xml.rels")
        target = {r.get("Id"): r.get("Target") for r in links}
        self.sheets = {s.get("name"): "xl/" + target[s.get(LINK)].removeprefix("/xl/") for s in book.iter(MAIN + "sheet")}
        old = book.find(MAIN + "workbookPr")
        self.epoch = EPOCH_1904 if old is not None and old.get("date1904") in ("1", "true") else EPOCH
        self.shared = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in self._xml("xl/sharedStrings.xml", "sst")]
        styles = self._xml("xl/styles.xml", "styleSheet")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(MAIN + "numFmt")}
        formats = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]
        self.dated = {i for i, f in enumerate(formats) if is_date_format(f, own.get(f, ""))}

    def _xml(self, name: str, empty: str | None = None) -> ElementTree.Element:
        if empty and name not in self.zip.namelist():
            return ElementTree.Element(empty)
        return ElementTree.fromstring(self.zip.read(name))

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.findtext(MAIN + "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
        if value is None:
            return None
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "True" if value == "1" else "False"
        if kind != "n":
            return value
        return cell_text(float(value), self.epoch if int(cell.get("s", 0)) in self.dated else None)

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """(row, cells by column) of a sheet, by default the first."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(self.sheets)}")
        name = self.sheets[sheet or next(iter(self.sheets))]
        at = 0
        with self.zip.open(name) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != MAIN + "row":
                    continue
                at = int(row.get("r", at + 1))
                cells, column = {}, -1
                for c in row.iter(MAIN + "c"):
                    letters = re.match("[A-Z]+", c.get("r", ""))
                    column = column_number(letters[0]) if letters else column + 1
                    text = self._text(c)
                    if text is not None:
                        cells[column] = text
                yield at, cells
                row.clear()


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows below a sheet's header, all columns text, with _src_row, the row in the sheet, _src_sheet and
    _src_file. Workbooks, XLSX or XLS by what they begin with, are opened in the tasks, one each; a sheet has at
    most 1,048,576 rows. With several files, all must have the columns of the first."""
    from auditspark.sources.xls import SIGNATURE, OldWorkbook

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                book = (OldWorkbook if content[:8] == SIGNATURE else Workbook)(bytes(content))
                title, held = sheet or next(iter(book.sheets)), []
                for row, cells in book.rows(sheet):
                    held.append((name, title, row, [cells.get(k) for k in range(max(cells, default=-1) + 1)]))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    rows = files.mapInPandas(run, "path string, sheet string, row long, cells array<string>")
    first = rows.filter("row = 1").orderBy("path").select("cells").first()
    if first is None:
        return spark.createDataFrame([], "_src_row long, _src_sheet string, _src_file string")
    names = [(k, h.strip()) for k, h in enumerate(first["cells"]) if h and h.strip()]
    return rows.filter("row > 1").select(*[F.get("cells", F.lit(k)).alias(h) for k, h in names], F.col("row").alias("_src_row"), F.col("sheet").alias("_src_sheet"), F.col("path").alias("_src_file"))
