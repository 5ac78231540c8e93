"""Small files for the queries that read delimited texts and workbooks."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from urllib.parse import unquote, urlparse
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession

from exactdiff.lineage import folder


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a new file with data, below the checkpoint folder, which all executors share."""
    at = os.path.join(unquote(urlparse(folder(spark)).path), f"files-{uuid.uuid4().hex}")
    os.makedirs(at)
    path = os.path.join(at, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def workbook(sheet: str, rows: list[list[str]]) -> bytes:
    """A workbook with one sheet of texts."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()
