"""Spark data source "xlsx", a reader for files of any store, and a writer of sheets.

A sheet's rows are (path, row_idx long, cells array<string>), or, where the schema names columns by their letters
(row_idx long, A string, F string), those columns alone: other cells are skipped. Rows are ragged: cells end with the last
one given, and cells that are left out are empty strings. Numbers, booleans and formulas' results are given as the file's text for
them.

A sheet is cut into pieces of whole rows, each read by a task of its own: a task unpacks what is before its pieces, which is fast, and
parses its own rows alone, which is slow. Of the strings that rows share it holds those that its piece names. Rows leave in
Arrow batches. Filters on path and row_idx reach the source, which leaves out files, pieces and rows.

Options: path (files by commas, or a folder; paths and URIs that pyarrow opens), sheet (a name; the first one by default), pieceBytes
(unpacked bytes of a task's piece). sheet_rows reads files of stores that only Spark opens.

Defined results: a file without the sheet raises; an empty sheet has no rows; a row without a number follows the one before it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Namespaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, row_idx long, cells array<string>"
PIECE, BLOCK = 8 << 20, 1 << 20
_ROW, _NUMBER = re.compile(rb"<(?:\w+:)?row(?=[\s/>])[^>]*>"), re.compile(rb'\sr="(\d+)"')


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _member(book: zipfile.ZipFile, sheet: str | None) -> str:
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        if sheet is None or x.get("name") == sheet:
            target = links[x.get(_LINK)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


@dataclass
class Piece:
    """Whole rows of a sheet: the byte of the sheet's XML at which they begin, the row number before the first, and XML that can be parsed by itself."""

    start: int
    before: int
    xml: bytes


def pieces(stream, size: int = BLOCK, begin: int = 0, end: int | None = None) -> Iterator[Piece]:
    """The rows of a sheet's XML in pieces of about size bytes, or one longer row; those that start in [begin, end)."""
    held, at, row, head, tail, more = b"", 0, -1, None, b"", True
    while more and (end is None or at < end):
        block = stream.read(size)
        more, held = bool(block), held + block
        tags = list(_ROW.finditer(held))
        if head is None and (tags or not more):
            opened = re.search(rb"<((?:\w+:)?)worksheet[^>]*>", held)
            if opened is None:
                return
            head, tail = opened[0], b"</" + opened[1] + b"worksheet>"
        if more and len(tags) < 2:
            continue
        if tags:
            # The last row may go on in the next block.
            cut, whole = (tags[-1].start(), tags[:-1]) if more else (len(held), tags)
            first, start = row, at + tags[0].start()
            for tag in whole:
                number = _NUMBER.search(tag[0])
                row = int(number[1]) - 1 if number else row + 1
            body = held[tags[0].start() : cut]
            if not more:
                close = re.search(rb"</(?:\w+:)?sheetData>", body)
                body = body[: close.start()] if close else body
            if start >= begin and (end is None or start < end):
                yield Piece(start, first, head + body + tail)
            at, held = at + cut, held[cut:]


def parsed(piece: Piece) -> Iterator[tuple[int, list[tuple[int, str, bool]]]]:
    """(row index from 0, its cells as column, text, whether the text is the number of a shared string)."""
    at = piece.before
    for node in ElementTree.fromstring(piece.xml).iter(f"{_MAIN}row"):
        at = int(node.get("r")) - 1 if node.get("r") else at + 1
        cells, k = [], -1
        for c in node.iter(f"{_MAIN}c"):
            k = _column(c.get("r")) if c.get("r") else k + 1
            value = c.find(f"{_MAIN}v")
            raw = (value.text or "") if value is not None else ""
            inline = c.get("t") == "inlineStr"
            cells.append((k, _text(c) if inline else raw, c.get("t") == "s" and raw != ""))
        yield at, cells


def _shared(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of some numbers; the others are read past."""
    out: dict[int, str] = {}
    if wanted and "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            k = 0
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{_MAIN}si":
                    if k in wanted:
                        out[k] = _text(node)
                    k += 1
                    node.clear()
    return out


def _filled(rows: list, shared: dict[int, str], keep: Callable[[int], bool] = lambda k: True) -> Iterator[tuple[int, list[str]]]:
    for at, cells in rows:
        if keep(at):
            out: list[str] = []
            for k, text, is_shared in cells:
                out += [""] * (k + 1 - len(out))
                out[k] = shared[int(text)] if is_shared else text
            yield at, out


def rows(path, sheet: str | None = None) -> Iterator[tuple[int, list[str]]]:
    """(row index from 0, cells) of a sheet of a file or file object, piece by piece."""
    with zipfile.ZipFile(path) as book, book.open(_member(book, sheet)) as f:
        for piece in pieces(f):
            own = list(parsed(piece))
            yield from _filled(own, _shared(book, {int(t) for _, cells in own for _, t, s in cells if s}))


def _arrow(path: str, own: list[tuple[int, list[str]]], names: list[str]) -> pa.RecordBatch:
    """A batch of the columns of names: path, row_idx, cells, or letters."""
    columns = []
    for name in names:
        if name == "path":
            columns.append(pa.array([path] * len(own), pa.string()))
        elif name == "row_idx":
            columns.append(pa.array([k for k, _ in own], pa.int64()))
        elif name == "cells":
            columns.append(pa.array([x for _, x in own], pa.list_(pa.string())))
        else:
            k = _column(name)
            columns.append(pa.array([x[k] if k < len(x) else None for _, x in own], pa.string()))
    return pa.RecordBatch.from_arrays(columns, names)


def _only(names: list[str]) -> set[int] | None:
    """The columns that are read; None: all."""
    return None if "cells" in names else {_column(n) for n in names if n not in ("path", "row_idx")}


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _files(path: str) -> list[str]:
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(name)] if "://" in path and path.endswith(name) else ""
    return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(name)) if x.path.endswith(".xlsx"))


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.names, self.sheet, self.size = schema.names, options.get("sheet"), int(options.get("pieceBytes", PIECE))
        self.given = [p for p in (options.get("path") or "").split(",") if p]
        self.paths: set[str] | None = None
        self.least, self.most = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        """Takes filters on path and row_idx; any others are left to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                own = set(value) if isinstance(f, In) else {value}
                self.paths = own if self.paths is None else self.paths & own
            elif column == ("row_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(self.most, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        out = []
        for path in (p for g in self.given for p in _files(g)):
            if self.paths is None or path in self.paths:
                with _open(path) as f, zipfile.ZipFile(f) as book:
                    size = book.getinfo(_member(book, self.sheet)).file_size
                out += [_Range(path, a, a + self.size) for a in range(0, max(size, 1), self.size)] if self.least <= self.most else []
        return out

    def read(self, partition):
        if partition is None:
            return
        only = _only(self.names)
        with _open(partition.path) as f, zipfile.ZipFile(f) as book, book.open(_member(book, self.sheet)) as xml:
            for piece in pieces(xml, BLOCK, partition.begin, partition.end):
                if piece.before >= self.most:
                    break
                own = [(k, [c for c in cells if only is None or c[0] in only]) for k, cells in parsed(piece) if self.least <= k <= self.most]
                if own:
                    shared = _shared(book, {int(t) for _, cells in own for _, t, s in cells if s})
                    yield _arrow(partition.path, list(_filled(own, shared)), self.names)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxSource)


def sheet_rows(spark: SparkSession, root: str, sheet: str | None = None, columns: list[str] | None = None, pattern: str = "*.xlsx", lot: int = BLOCK) -> DataFrame:
    """The rows of all files below root, on any store that Spark reads; columns: letters, for these alone.

    A task cuts a file into pieces of lot bytes with the shared strings of each; the pieces are dealt to all tasks and parsed there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _parsed_files(files, sheet, columns, lot)


def arriving(spark: SparkSession, root: str, sheet: str | None = None, columns: list[str] | None = None, pattern: str = "*.xlsx", files_at_once: int = 100) -> DataFrame:
    """A stream of the rows of files that are put below root, as sheet_rows() gives them.

    Spark's log of files in the stream's checkpoint holds which have been read, so that a restart neither loses nor repeats one.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = source.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(root)
    return _parsed_files(files, sheet, columns, BLOCK)


def _parsed_files(files: DataFrame, sheet: str | None, columns: list[str] | None, lot: int) -> DataFrame:
    spark = files.sparkSession
    names = ["path", "row_idx", *(columns or ["cells"])]
    schema = ", ".join(["path string", "row_idx long", *([f"`{c}` string" for c in columns] if columns else ["cells array<string>"])])
    strings = re.compile(rb'<(?:\w+:)?c\s[^>]*t="s"[^>]*>\s*<(?:\w+:)?v>(\d+)<')
    kind = pa.map_(pa.int64(), pa.string())

    def cut(batches):
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(body.as_buffer())) as book, book.open(_member(book, sheet)) as f:
                    for piece in pieces(f, lot):
                        shared = _shared(book, {int(x) for x in strings.findall(piece.xml)})
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([piece.before], pa.int64()), pa.array([piece.xml], pa.binary()), pa.array([list(shared.items())], kind)], ["path", "before", "xml", "shared"])

    def parse(batches):
        only = _only(names)
        for batch in batches:
            for x in batch.to_pylist():
                own = [(k, [c for c in cells if only is None or c[0] in only]) for k, cells in parsed(Piece(0, x["before"], x["xml"]))]
                if own:
                    yield _arrow(x["path"], list(_filled(own, dict(x["shared"]))), names)

    dealt = files.select("path", "content").mapInArrow(cut, "path string, before long, xml binary, shared map<long, string>")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(parse, schema)


#: The parts of a workbook besides its sheet and its strings.
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
}


def book(own: Iterator[list], comment: bytes = b"") -> bytes:
    """A workbook of one sheet: numbers as numbers, texts as shared strings, nulls left out."""
    out, strings = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in _PARTS.items():
            z.writestr(name, body)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {_NS}><sheetData>".encode())
            for n, cells in enumerate(own, 1):
                line = [f'<row r="{n}">']
                for k, x in enumerate(cells):
                    if x is not None:
                        is_text = isinstance(x, str)
                        line.append(f'<c r="{_letters(k)}{n}"{" t=" + chr(34) + "s" + chr(34) if is_text else ""}><v>{strings.setdefault(x, len(strings)) if is_text else x}</v></c>')
                f.write("".join([*line, "</row>"]).encode())
            f.write(b"</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in strings) + "</sst>")
        z.comment = comment
    return out.getvalue()


def write_sheets(table: DataFrame, path: str, most: int = 100_000) -> None:
    """Writes rows as workbooks of at most so many rows into files part-* below path, on any store that Spark writes to.

    A workbook is a row of Spark's text writer; the line feed after it is the archive's comment.
    """
    names = table.columns

    def run(batches):
        held = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(list(x))
                if len(held) == most:
                    yield pa.RecordBatch.from_arrays([pa.array([book(iter(held), b"\n")[:-1]], pa.binary())], ["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([book(iter(held), b"\n")[:-1]], pa.binary())], ["value"])

    plain = table.select(*[F.col(f"`{c}`").cast("string") if not isinstance(table.schema[c].dataType, T.NumericType) or isinstance(table.schema[c].dataType, T.DecimalType) else F.col(f"`{c}`") for c in names])
    plain.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def parse(stream) -> None:
    """Sheets are read from paths; a stream is refused, whatever it holds."""
    raise NotImplementedError("sheets are read from a path")
