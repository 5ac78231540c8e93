"""Workbooks as texts: `spark.read.format("xlsx_text")`, by the standard library's zip and XML readers.

Row 1 of a sheet is the header. Every cell is the text that the file stores: a shared or inline string, a formula's
cached value, a number without a needless `.0`, true or false; dates are their day numbers. Rows stream from the XML, in
one task, since a sheet is one compressed stream. Merged ranges have their value in the first cell.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from exactdiff.errors import HardFail

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = 5000


def _places(book: zipfile.ZipFile) -> dict[str, str]:
    """Each sheet's name and its part of the archive, in order."""
    targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[x.get(_LINK)]
        found[x.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def _open(path: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(path)
    except (OSError, zipfile.BadZipFile) as e:
        raise HardFail(f"{path} is no workbook that can be read: {e}") from e


def sheet_names(path: str) -> list[str]:
    with _open(path) as book:
        return list(_places(book))


def _text(e: ElementTree.Element) -> str:
    """A string item's text: its own or that of its runs, phonetic hints left out."""
    return "".join(t.text or "" for part in e if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """The cells of each row from the first on; rows that the file leaves out are empty lists."""
    with _open(path) as book:
        places = _places(book)
        if sheet not in places:
            raise HardFail(f"Missing sheet {sheet!r} in {path}. Available: {', '.join(places)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        shared.append(_text(e))
                        e.clear()
        expected = 1
        with book.open(places[sheet]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                number = int(e.get("r") or expected)
                yield from ([] for _ in range(expected, number))
                expected, out = number + 1, []
                for c in e.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        out[at] = _text(c.find(f"{_MAIN}is"))
                    elif v is not None and v.text is not None:
                        x = v.text
                        out[at] = shared[int(x)] if kind == "s" else ("true" if x == "1" else "false") if kind == "b" else re.sub(r"^(-?\d+)\.0+$", r"\1", x) if kind == "n" else x
                yield out
                e.clear()


def read_header(path: str, sheet: str) -> list[str]:
    for row in rows(path, sheet):
        if row:
            return [x or "" for x in row]
        break
    raise HardFail(f"{path} has no header row on that sheet")


class _Whole(InputPartition):
    pass


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int) -> None:
        self.path, self.sheet, self.width = options["path"], options["sheet"], width

    def partitions(self) -> list[InputPartition]:
        return [_Whole(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, held = [f"c{i}" for i in range(self.width)], []
        for i, row in enumerate(rows(self.path, self.sheet)):
            if any(x is not None for x in row[self.width :]):
                raise ValueError(f"row {i + 1} has {len(row)} cells, the header {self.width}")
            if i:
                held.append((row + [None] * self.width)[: self.width])
            if len(held) == _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], names=names)


class XlsxText(DataSource):
    """Options: path, sheet. Columns are named c0, c1, ..."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_text"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(len(read_header(self.options["path"], self.options["sheet"]))))

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options), len(schema.fields))


def read(spark: SparkSession, path: str, sheet: str) -> tuple[list[str], DataFrame]:
    """The headers, and a frame of texts with columns c0, c1, ... in their order."""
    spark.dataSource.register(XlsxText)
    return read_header(path, sheet), spark.read.format("xlsx_text").options(path=path, sheet=sheet).load()
