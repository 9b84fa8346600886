"""Zipped inputs as Spark data sources: feed archives and workbooks, one partition for each member.

Planning reads directories of zip files only, or nothing at all where the wanted member is named. A task opens
its archive where it lies, seeks to its member and streams the rows; other members are never unpacked, and no
archive is ever a value of a row. Paths may be local (shared by all executors) or any that pyarrow can open.
A member is one compressed stream, so it is read by one task however long it is, in bounded batches.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 20_000
FEED_ROWS = "feed string, file string, row_no bigint, fields map<string,string>"
SHEET_ROWS = "workbook string, sheet string, row_no bigint, cells array<string>"
# Names inside workbook files.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub("^s3a://", "s3://", path)))


def _open(path: str) -> zipfile.ZipFile:
    system, place = _file_system(path)
    try:
        return zipfile.ZipFile(system.open_input_file(place))
    except pa.ArrowInvalid as error:  # a file too short for a directory: seeking behind its start
        raise zipfile.BadZipFile(str(error)) from error


def list_files(path: str, suffix: str) -> list[str]:
    """Files of a folder with the suffix, by name, or the file itself."""
    system, place = _file_system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[:path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    if info.type == fs.FileType.File:
        return [scheme + info.path]
    found = system.get_file_info(fs.FileSelector(place))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def _base(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1]


@dataclass
class Member(InputPartition):
    """An archive and one of its members; without ``member`` those called ``wanted`` are looked up where the archive is read."""

    path: str
    member: str | None = None
    wanted: str | None = None
    readable: bool = True

    def __hash__(self) -> int:
        return hash((self.path, self.member, self.wanted))


# --- feed archives -------------------------------------------------------------


class FeedArchives(DataSource):
    """``feed_archive``: rows of the text tables in the zip files of a folder.

    Options: ``file`` (the one table to read), ``columns`` (comma-separated; the rows then hold these as text
    instead of a map), ``files_only`` (just which files there are). Without ``columns`` row_no 0 marks a present file,
    -1 an archive that cannot be read.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_archive"

    def schema(self) -> str:
        columns = [c for c in self.options.get("columns", "").split(",") if c]
        if not columns:
            return FEED_ROWS
        if "file" not in self.options:
            raise ValueError("columns are those of one file: name it")
        return "feed string, row_no bigint, " + ", ".join(f"`{c}` string" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.file = options.get("file")
        self.columns = [c for c in options.get("columns", "").split(",") if c]
        self.files_only = options.get("files_only", "false").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        archives = list_files(self.path, ".zip")
        if self.file:
            return [Member(a, wanted=self.file.lower()) for a in archives]
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(self._members, archives))
        return [m for members in found for m in members]

    @staticmethod
    def _members(path: str) -> list[Member]:
        try:
            with _open(path) as archive:
                return [Member(path, m) for m in archive.namelist() if not m.endswith("/")]
        except zipfile.BadZipFile:
            return [Member(path, readable=False)]

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder
            return
        feed = re.sub(r"\.zip$", "", _base(partition.path), flags=re.IGNORECASE)
        if not partition.readable:
            yield from self._marks(feed, "", -1)
            return
        try:
            archive = _open(partition.path)
        except zipfile.BadZipFile:
            yield from self._marks(feed, "", -1)
            return
        with archive:
            members = [partition.member] if partition.member is not None else [
                m for m in archive.namelist() if _base(m).lower() == partition.wanted]
            for member in members:
                file = _base(member).lower()
                yield from self._marks(feed, file, 0)
                if file.endswith(".txt") and not self.files_only:
                    yield from self._rows(archive, member, feed, file)

    def _marks(self, feed: str, file: str, row_no: int) -> Iterator[pa.RecordBatch]:
        if not self.columns:
            yield self._batch([(feed, file, row_no, {})])

    def _rows(self, archive: zipfile.ZipFile, member: str, feed: str, file: str) -> Iterator[pa.RecordBatch]:
        with archive.open(member) as raw:
            reader = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""))
            header = [h.strip().lower() for h in next(reader, [])]
            at = {h: i for i, h in enumerate(header)}
            places = [at.get(c, -1) for c in self.columns]
            rows = []
            for number, cells in enumerate(reader, start=1):
                if not any(c.strip() for c in cells):
                    continue
                if self.columns:
                    rows.append((feed, number, *[cells[i].strip() if 0 <= i < len(cells) else None for i in places]))
                else:
                    rows.append((feed, file, number, dict(zip(header, cells))))
                if len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        if self.columns:
            types = [pa.string(), pa.int64(), *[pa.string()] * len(self.columns)]
            names = ["feed", "row_no", *self.columns]
        else:
            types = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
            names = ["feed", "file", "row_no", "fields"]
        columns = [list(c) for c in zip(*rows)]
        if not self.columns:
            columns[3] = [list(f.items()) for f in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


# --- workbooks -----------------------------------------------------------------


class Workbooks(DataSource):
    """``workbook``: rows of the sheets in the .xlsx files of a folder, (workbook, sheet, row_no, cells).

    Option ``sheet``: a sheet's name, ``*`` for all, the first one if left out. Cells are text as stored (numbers in
    their shortest form, truth values as True and False, dates as serial numbers), NULL where empty; ``cells`` begins at
    column A, ``row_no`` counts from 1 as the sheet does. A workbook without the named sheet is an error that lists its sheets.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SHEET_ROWS

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(dict(self.options))


def sheets_of(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the worksheets, in the workbook's order."""
    with archive.open("xl/_rels/workbook.xml.rels") as raw:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.parse(raw).iter(RELATION) if r.get("Type", "").endswith("/worksheet")}
    with archive.open("xl/workbook.xml") as raw:
        sheets = [(s.get("name", ""), targets.get(s.get(RELATION_ID))) for s in ElementTree.parse(raw).iter(f"{MAIN}sheet")]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in sheets if target]


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    member: str

    def __hash__(self) -> int:
        return hash((self.path, self.sheet, self.member))


def _column(reference: str) -> int:
    """0-based column of a cell reference such as BC12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(item: ElementTree.Element) -> str:
    """Text of a string item: its own or that of its runs, without reading aids."""
    own = item.findall(f"{MAIN}t") + item.findall(f"{MAIN}r/{MAIN}t")
    return "".join(t.text or "" for t in own)


def _number(text: str) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(text)) if re.fullmatch(r"[+-]?\d+", text) else repr(value)


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            return [s for found in pool.map(self._sheets, list_files(self.path, ".xlsx")) for s in found]

    def _sheets(self, path: str) -> list[Sheet]:
        with _open(path) as archive:
            found = sheets_of(archive)
        wanted = found if self.sheet == "*" else found[:1] if self.sheet is None else [s for s in found if s[0] == self.sheet]
        if self.sheet not in (None, "*") and not wanted:
            raise ValueError(f"no sheet {self.sheet!r} in {path}; it has: {', '.join(name for name, _ in found)}")
        return [Sheet(path, name, member) for name, member in wanted]

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with _open(partition.path) as archive:
            strings = self._strings(archive)
            rows, at = [], 0
            with archive.open(partition.member) as raw:
                for at, cells in self._rows(raw, strings):
                    rows.append((at, cells))
                    if len(rows) >= BATCH_ROWS:
                        yield self._batch(partition, rows)
                        rows = []
            if rows:
                yield self._batch(partition, rows)

    @staticmethod
    def _strings(archive: zipfile.ZipFile) -> list[str]:
        """The workbook's shared strings; held by the task, since cells point into them in any order."""
        if "xl/sharedStrings.xml" not in archive.namelist():
            return []
        out = []
        with archive.open("xl/sharedStrings.xml") as raw:
            root = None
            for event, item in ElementTree.iterparse(raw, ("start", "end")):
                if root is None:
                    root = item
                elif event == "end" and item.tag == f"{MAIN}si":
                    out.append(_text(item))
                    root.clear()
        return out

    @staticmethod
    def _rows(raw, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
        at, parents = 0, []
        for event, item in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                parents.append(item)
                continue
            parents.pop()
            if item.tag != f"{MAIN}row":
                continue
            at = int(item.get("r") or at + 1)
            cells: list[str | None] = []
            for cell in item.iter(f"{MAIN}c"):
                reference = cell.get("r")
                place = _column(reference) if reference else len(cells)
                cells.extend([None] * (place + 1 - len(cells)))
                cells[place] = SheetReader._value(cell, strings)
            yield at, cells
            parents[-1].clear()  # rows that were read take no memory

    @staticmethod
    def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            return None if inline is None else _text(inline)
        value = cell.findtext(f"{MAIN}v")
        if value is None or value == "":
            return None
        if kind == "s":
            return strings[int(value)]
        if kind == "b":
            return str(value.strip() not in ("0", "false"))
        return _number(value.strip()) if kind == "n" else value

    @staticmethod
    def _batch(sheet: Sheet, rows: list[tuple[int, list[str | None]]]) -> pa.RecordBatch:
        book = re.sub(r"\.xlsx$", "", _base(sheet.path), flags=re.IGNORECASE)
        return pa.RecordBatch.from_arrays([
            pa.array([book] * len(rows)), pa.array([sheet.sheet] * len(rows)), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["workbook", "sheet", "row_no", "cells"])


# --- use -----------------------------------------------------------------------


def read_feeds(spark: SparkSession, path: str, file: str | None = None, columns: Sequence[str] = (), *, files_only: bool = False) -> DataFrame:
    """Rows of :class:`FeedArchives`; with ``file`` nothing else in the archives is touched."""
    spark.dataSource.register(FeedArchives)
    options = {"file": file, "columns": ",".join(columns) or None, "files_only": "true" if files_only else None}
    return spark.read.format("feed_archive").options(**{k: v for k, v in options.items() if v}).load(path)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def _store(folder: str, name: str, write) -> None:
    """A file appears under its name when it is whole; a second attempt of a task writes the same file again."""
    system, place = _file_system(folder)
    system.create_dir(place, recursive=True)
    draft = f"{place}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        write(archive)
    system.move(draft, f"{place}/{name}")


def write_feeds(table: DataFrame, folder: str, file: str, prefix: str = "part") -> int:
    """One archive ``<prefix>-<partition>.zip`` with ``file`` for each partition that has rows; returns their number."""
    columns = table.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows(archive: zipfile.ZipFile) -> None:
            with archive.open(file, "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                out = csv.writer(text)
                out.writerow(columns)
                for batch in chain((first,), batches):
                    out.writerows(zip(*[c.to_pylist() for c in batch.columns]))
        _store(folder, f"{prefix}-{TaskContext.get().partitionId():05d}.zip", rows)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])
    return table.mapInArrow(write, "n long").count()


def write_workbooks(rows: DataFrame, folder: str) -> int:
    """Workbooks of one sheet for each run of rows (sheet, row_no, cells) in a partition, rows sorted by sheet and number; returns their number."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((s, n, c) for b in batches for s, n, c in zip(*[b.column(k).to_pylist() for k in ("sheet", "row_no", "cells")]))
        main, office = MAIN[1:-1], RELATION_ID[1:-3]
        for k, (sheet, part) in enumerate(groupby(stream, key=lambda r: r[0])):
            def members(archive: zipfile.ZipFile) -> None:
                archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="a"/></sheets></workbook>')
                archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{RELATION[1:RELATION.index("}")]}"><Relationship Id="a" '
                                 f'Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
                with archive.open("xl/worksheets/sheet1.xml", "w") as raw:
                    raw.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                    for _, number, cells in part:
                        inner = "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in cells)
                        raw.write(f'<row r="{number}">{inner}</row>'.encode())
                    raw.write(b"</sheetData></worksheet>")
            _store(folder, f"book-{TaskContext.get().partitionId():05d}-{k:05d}.xlsx", members)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])
    return rows.mapInArrow(write, "n long").count()
