"""A folder of spreadsheet workbooks as one table: the first sheet of every file.

Texts may be shared, inline or results of formulas; numbers with a date format become timestamps as text; truth values
read ``true`` and ``false``; error cells are missing. A sheet may begin anywhere: its first row with a
value is the header, and rows without any value are left out.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from snapweave.schema import RATIONALE_SCHEMA

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")[0]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(_REL))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


# Number formats of dates and times that every workbook knows.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_MAIN}numFmt")}
    shown = styles.find(f"{_MAIN}cellXfs")
    found = set()
    for place, style in enumerate(shown if shown is not None else ()):
        number = int(style.get("numFmtId") or 0)
        # Quoted parts, escapes and colours in brackets are no date letters.
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(number, ""))
        if number in _DATE_FORMATS or re.search(r"[dmyhs]", code, re.I):
            found.add(place)
    return found


def _as_time(days: str, first_1904: bool) -> str:
    """A serial number of days as a timestamp's text; both calendars, whole seconds."""
    start = dt.datetime(1904, 1, 1) if first_1904 else dt.datetime(1899, 12, 30)
    return str(start + dt.timedelta(seconds=round(float(days) * 86_400)))


def sheet_rows(content: bytes) -> Iterator[dict[str, str | None]]:
    """Rows of the first sheet as header -> text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = _date_styles(book)
        about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
        first_1904 = about is not None and about.get("date1904") in ("1", "true")

        def cell_text(c) -> str | None:
            kind, value = c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                return _text(c)
            if value is None or value.text is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(value.text)]
            if kind == "b":
                return "true" if value.text == "1" else "false"
            if kind in (None, "n") and int(c.get("s") or 0) in dates:
                return _as_time(value.text, first_1904)
            return value.text

        header: dict[int, str] | None = None
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {_column_number(c.get("r")) if c.get("r") else i: cell_text(c) for i, c in enumerate(row.findall(f"{_MAIN}c"))}
                row.clear()
                if all(v is None for v in cells.values()):
                    continue
                if header is None:
                    header = {i: v for i, v in cells.items() if v is not None}
                else:
                    yield {name: cells.get(i) for i, name in header.items()}


def sheet_header(content: bytes) -> list[str]:
    """Column names of the first sheet that has a row below them."""
    return next((list(row) for row in sheet_rows(content)), [])


def unpack_workbooks(files: DataFrame, schema: str | T.StructType = RATIONALE_SCHEMA) -> DataFrame:
    """Rows of the workbooks in the binary column ``content``, read as text and cast to ``schema``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [[r.get(n) for n in names] for r in sheet_rows(content)]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    raw = files.select("content").mapInPandas(read, text)
    # Numbers are stored as decimals in sheets ("3.0"), so whole-number columns pass through double.
    whole = (T.IntegerType, T.LongType)
    return raw.select(
        *[
            (raw[f.name].try_cast("double") if isinstance(f.dataType, whole) else raw[f.name])
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def read_workbooks(
    spark: SparkSession, path: str, schema: str | T.StructType = RATIONALE_SCHEMA
) -> DataFrame:
    return unpack_workbooks(spark.read.format("binaryFile").load(path), schema)


# --- as a data source --------------------------------------------------------------------------


@dataclass
class WorkbookFile(InputPartition):
    uri: str


def _files(path: str) -> list[str]:
    """The workbooks of a folder, or one workbook, wherever ``pyarrow.fs`` reaches."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".xlsm")))


def _content(uri: str) -> bytes:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    with system.open_input_file(inner) as file:
        return file.read()


class WorkbookSource(DataSource):
    """``spark.read.format("workbooks").load(folder)``: one partition per workbook.

    Without a schema every column of the first workbook's header is text; with one, only its columns are read, by name,
    and cast. Register it with ``spark.dataSource.register(WorkbookSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> T.StructType:
        for uri in _files(self.options["path"]):
            names = sheet_header(_content(uri))
            if names:
                return T.StructType([T.StructField(n, T.StringType()) for n in names])
        raise ValueError("no workbook with a header and a row: give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.fields = path, schema.fields

    def partitions(self) -> list[InputPartition]:
        return [WorkbookFile(uri) for uri in _files(self.path)]

    def read(self, partition: WorkbookFile | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        casts = [(f.name, _cast_of(f.dataType)) for f in self.fields]
        for row in sheet_rows(_content(partition.uri)):
            yield tuple(None if row.get(name) is None else cast(row[name]) for name, cast in casts)


def _cast_of(kind: T.DataType):
    """Text to a value of the type; None where it does not fit, as ``try_cast`` does."""
    simple = {
        T.StringType: str,
        T.DoubleType: float,
        T.FloatType: float,
        T.IntegerType: lambda v: int(float(v)),
        T.LongType: lambda v: int(float(v)),
        T.BooleanType: lambda v: {"true": True, "false": False}.get(v.lower()),
        T.TimestampType: dt.datetime.fromisoformat,
        T.TimestampNTZType: dt.datetime.fromisoformat,
        T.DateType: lambda v: dt.datetime.fromisoformat(v).date(),
    }.get(type(kind))
    if simple is None:
        raise ValueError(f"a workbook column cannot be read as {kind.simpleString()}")

    def cast(text: str):
        try:
            return simple(text)
        except (ValueError, OverflowError):
            return None

    return cast
