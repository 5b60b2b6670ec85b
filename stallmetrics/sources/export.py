"""Export of listings as CSV or XLSX files (survey K10): a data source of its own, for df.write.format("listing_export").

Each task writes its files and tells the driver their names and rows; only the driver's commit writes the
manifest, so a reader that goes by it never sees files of a task that was tried twice or of a job that failed.
The price is one numeric column, the view counter stands behind it. Options: path (where pyarrow can write, a
folder that all executors share), kind (csv or xlsx), rows (of a file at most).
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A sheet has no more rows than this.
SHEET_ROWS = 1_000_000
#: Rows of a task that are in memory.
HELD = 1_000
MANIFEST = "manifest.json"
COLUMNS = ("external_id", "title", "price_eur", "view_count", "url", "posted_text")

_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Listings" sheetId="1" r:id="rId1"/></sheets></workbook>'


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    plain = "".join(c for c in str(value) if c in "\t\n\r" or ord(c) >= 32)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


class Workbook:
    """An XLSX file of one sheet with a header, written row by row."""

    def __init__(self, out: IO[bytes], names: list[str]):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS.format("officeDocument", "xl/workbook.xml")), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _RELATIONS.format("worksheet", "worksheets/sheet1.xml"))):
            self.zip.writestr(name, text)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.rows([tuple(names)])

    def rows(self, rows: list[tuple]) -> None:
        self.sheet.write("".join(f"<row>{''.join(map(_cell, r))}</row>" for r in rows).encode())

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


class Table:
    """A CSV file with a header, written row by row."""

    def __init__(self, out: IO[bytes], names: list[str]):
        self.out = out
        self.rows([tuple(names)])

    def rows(self, rows: list[tuple]) -> None:
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows(rows)
        self.out.write(text.getvalue().encode())

    def close(self) -> None: ...


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class ExportWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.kind = schema.names, options["path"].rstrip("/"), options.get("kind", "csv")
        if self.kind not in ("csv", "xlsx"):
            raise ValueError(f"no kind {self.kind}")
        self.most = min(int(options.get("rows", SHEET_ROWS)), SHEET_ROWS)

    def _put(self, name: str, data: bytes) -> None:
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(data)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Only HELD rows of a task are in memory; the rest are in the file that they go to."""
        files, (fs, folder) = [], _filesystem(self.path)
        for first in iterator:
            name, n, rows = f"part-{uuid.uuid4().hex}.{self.kind}", 0, itertools.chain([first], iterator)
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                file = (Workbook if self.kind == "xlsx" else Table)(out, self.names)
                while held := [tuple(r) for r in itertools.islice(rows, min(HELD, self.most - n))]:
                    file.rows(held)
                    n += len(held)
                file.close()
            files.append((name, n))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [{"name": name, "rows": n} for m in messages if m for name, n in m.files]
        self._put(MANIFEST, json.dumps({"kind": self.kind, "columns": self.names, "rows": sum(f["rows"] for f in files), "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{path}/{name}")


class ListingExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(schema, dict(self.options))


def export(listings: DataFrame, scans: DataFrame, path: str, kind: str = "csv", rows: int = SHEET_ROWS) -> dict:
    """Writes the listings (scan_id, COLUMNS) of complete scans and gives the manifest."""
    spark = listings.sparkSession
    spark.dataSource.register(ListingExport)
    whole = listings.join(scans.filter("is_complete").select("scan_id").distinct(), "scan_id", "left_semi")
    whole.select("scan_id", *COLUMNS).write.format("listing_export").options(path=path, kind=kind, rows=rows).mode("append").save()
    return manifest(path)


def manifest(path: str) -> dict:
    fs, where = _filesystem(path.rstrip("/"))
    with fs.open_input_stream(f"{where}/{MANIFEST}") as f:
        return json.loads(f.read())


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV export, by its manifest."""
    files = [f"{path.rstrip('/')}/{f['name']}" for f in manifest(path)["files"]]
    schema = "scan_id long, external_id string, title string, price_eur int, view_count int, url string, posted_text string"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(files).withColumn("title", F.col("title"))
