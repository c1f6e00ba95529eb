"""Workbooks as a Spark data source: sheets are read and written as streams of rows.

A workbook (.xlsx) is a zip of XML parts.  The source has a partition for each
sheet of each workbook under its path, several for a large one, and yields cells
block by block; the types of columns are found by an aggregate over all cells, so
that no sheet is ever whole in one place.  Only the strings that a workbook's
cells share are held by a task, as one block of bytes.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import compat
from ..session import share_package

FORMAT = "workbook"
#: Rows of one sheet, by the format; a sheet beyond them gets a successor.
SHEET_ROWS = 1_048_576
#: XML of a sheet for a task of its own, and tasks of one sheet at most: each unpacks all that lies before its part.
SPLIT_BYTES, SPLITS = 16 << 20, 8
#: XML that is parsed, or made, at once.
BLOCK_BYTES = 4 << 20
#: A hidden name that marks a sheet as the successor of the one before it, whose place it shares.
CONTINUED = "_sparkloom_continued"
#: Kinds of cells.
NUMBER, TEXT, LOGICAL, MOMENT, TIME = "n", "s", "b", "d", "t"

# Number formats that the format defines as dates and as times of day.
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 37), *range(50, 59)}
TIME_FORMATS = {18, 19, 20, 21, 45, 46, 47}
# Texts that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

RAW = "book string, sheet string, place int, row long, top boolean, cells array<struct<at: int, kind: string, text: string, number: double>>"
_CELL = pa.struct([("at", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("number", pa.float64())])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REFERENCE = re.compile(r"([A-Z]+)\d*$")


class WorkbookError(ValueError):
    """Something isn't a workbook that can be read."""


# ---------------------------------------------------------------- files


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, as the task sees it."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def workbooks(path: str) -> list[str]:
    """The workbooks at a path: itself, or those in the folder."""
    fs, own = _system(path)
    if fs.get_file_info(own).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(own, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.is_file and f.base_name.lower().endswith(".xlsx") and f.base_name[0] not in "._~")
    if not names:
        raise WorkbookError(f"no workbook at {path}")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _opened(path: str) -> zipfile.ZipFile:
    fs, own = _system(path)
    try:
        return zipfile.ZipFile(fs.open_input_file(own))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"{path} is no .xlsx workbook: {e}") from e


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Sheet(InputPartition):
    """A sheet of a workbook, or its rows that begin in a range of bytes: the partition of a read."""

    book: str
    name: str
    place: int
    part: str
    start: int = 0
    end: int | None = None


def sheets(path: str) -> list[Sheet]:
    """A workbook's sheets in its order, large ones in parts; a successor has the place of the sheet that it goes on with."""
    with _opened(path) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        continued = {int(e.get("localSheetId", -1)) for e in root.iter(f"{_MAIN}definedName") if e.get("name") == CONTINUED}
        out, place = [], 0
        for i, e in enumerate(root.iter(f"{_MAIN}sheet")):
            place = place if i in continued else i
            target = targets.get(e.get(_LINK), "")
            part = target.lstrip("/") if target.startswith("/") else str(PurePosixPath("xl") / target)
            if "worksheets" in part:  # charts and macros have no rows
                out += _split(book, Sheet(path, e.get("name"), place, part))
        return out


def _split(book: zipfile.ZipFile, sheet: Sheet) -> list[Sheet]:
    """The sheet, or parts of a large one; a part's task reads the shared strings too, so these bound the parts."""
    own, shared = (book.NameToInfo.get(name) for name in (sheet.part, "xl/sharedStrings.xml"))
    parts = min(SPLITS, own.file_size // max(SPLIT_BYTES, shared.file_size if shared else 0)) if own else 1
    if parts < 2:
        return [sheet]
    with book.open(sheet.part) as f:
        if not _root(next(_plain(f), b"")):
            return [sheet]
    step = -(-own.file_size // parts)
    return [replace(sheet, start=i * step, end=(i + 1) * step if i + 1 < parts else None) for i in range(parts)]


def _string(e: ElementTree.Element) -> str:
    """The text of an item, its runs joined; what is only a reading aid is left out."""
    own = e.find(f"{_MAIN}t")
    if own is not None and e.find(f"{_MAIN}r") is None:
        return own.text or ""
    return "".join(t.text or "" for r in e.iter(f"{_MAIN}r") for t in r.iter(f"{_MAIN}t"))


class Strings:
    """The shared strings of a workbook, as one block of bytes and the places in it."""

    def __init__(self, book: zipfile.ZipFile):
        self.ends, self.block = array("Q", [0]), bytearray()
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in _elements(f, "si"):
                    self.block += _string(e).encode()
                    self.ends.append(len(self.block))

    def __getitem__(self, i: int) -> str:
        return self.block[self.ends[i] : self.ends[i + 1]].decode()


def _elements(f, name: str) -> Iterator[tuple[int, ElementTree.Element]]:
    """The elements of a name as they end; what has been read is let go."""
    root, n = None, 0
    for event, e in ElementTree.iterparse(f, events=("start", "end")):
        if root is None:
            root = e
        elif event == "end" and e.tag == f"{_MAIN}{name}":
            yield n, e
            n += 1
            e.clear()
            parent = root if name == "si" else root.find(f"{_MAIN}sheetData")
            if parent is not None:
                parent.clear()


def _kinds(book: zipfile.ZipFile) -> list[str]:
    """What a number in each cell style is: a number, a moment or a time of day."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own: dict[int, str] = {}
    for e in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", e.get("formatCode", "").lower())
        if re.search(r"[yd]|mmm|^m+[/\-.]|[/\-.]m+$", code):
            own[int(e.get("numFmtId"))] = MOMENT
        elif re.search(r"[hs]", code):
            own[int(e.get("numFmtId"))] = TIME
    styles = root.find(f"{_MAIN}cellXfs")
    kinds = []
    for e in styles if styles is not None else ():
        i = int(e.get("numFmtId", 0))
        kinds.append(own.get(i) or (MOMENT if i in DATE_FORMATS else TIME if i in TIME_FORMATS else NUMBER))
    return kinds


def column_number(reference: str) -> int:
    """AB12 -> 27: the place of a cell's column, from 0."""
    n = 0
    for letter in _REFERENCE.match(reference)[1]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def moment(number: float, since_1904: bool) -> dt.datetime:
    """A day count as a moment, to the millisecond; the 29th of February 1900, which never was, is the 28th."""
    if since_1904:
        start = dt.datetime(1904, 1, 1)
    else:
        start = dt.datetime(1899, 12, 30) if number >= 60 else dt.datetime(1899, 12, 31)
    return start + dt.timedelta(milliseconds=round(number * 86_400_000))


def _clock(number: float) -> str:
    seconds, milli = divmod(round(number * 86_400_000), 1000)
    text = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    return f"{text}.{milli:03}" if milli else text


def _plain(f) -> Iterator[bytes]:
    """The XML in blocks, without comments and with CDATA as escaped text: each ``<row`` then begins a row."""
    rest = b""
    while chunk := f.read(BLOCK_BYTES):
        rest, out = rest + chunk, []
        while (at := rest.find(b"<!")) >= 0:
            kind = next((k for k in ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>")) if rest.startswith(k[0], at)), None)
            if kind is None and len(rest) - at >= 9:  # a document type; no workbook has one
                out.append(rest[: at + 2])
                rest = rest[at + 2 :]
                continue
            end = rest.find(kind[1], at + len(kind[0])) if kind else -1
            if end < 0:
                break
            inner = rest[at + len(kind[0]) : end] if kind[0] == b"<![CDATA[" else b""
            out += [rest[:at], inner.replace(b"&", b"&amp;").replace(b"<", b"&lt;").replace(b">", b"&gt;")]
            rest = rest[end + 3 :]
        keep = at if at >= 0 else len(rest) - 1 if rest.endswith(b"<") else len(rest)
        yield b"".join([*out, rest[:keep]])
        rest = rest[keep:]
    if rest:
        yield rest


_HEAD_OF = re.compile(rb"^(?:\xef\xbb\xbf)?\s*(<\?xml[^>]*\?>)?\s*(<worksheet\b[^>]*>).*?(<sheetData\b[^>]*>)", re.S)
_ROW = re.compile(rb"<row(?=[\s/>])")
_ROW_NUMBER = re.compile(rb"""<row(?=[\s/>])(?:[^>]*?\sr=["'](\d+)["'])?""")


def _root(head: bytes) -> bytes | None:
    """What stands around the rows, if the sheet is UTF-8 whose own elements have no prefix."""
    found = _HEAD_OF.match(head)
    if not found or f'xmlns="{_MAIN[1:-1]}"'.encode() not in found[2]:
        return None
    coding = re.search(rb"""encoding=["']([^"']*)""", found[1] or b"")
    return found[2] + found[3] if not coding or coding[1].lower() == b"utf-8" else None


def _last_row(block: bytes) -> int:
    """Where the last row begins; -1 if none is seen to begin."""
    at = block.rfind(b"<row")
    while at >= 0 and not _ROW.match(block, at):
        at = block.rfind(b"<row", 0, at)
    return at


def _number_after(block: bytes, number: int) -> int:
    """The number of the block's last row, if the row before it has this one."""
    at = _last_row(block)
    if at >= 0 and (own := _ROW_NUMBER.match(block, at)[1]):
        return int(own)
    for row in _ROW_NUMBER.finditer(block):
        number = int(row[1] or number + 1)
    return number


def _blocks(chunks: Iterator[bytes], sheet: Sheet) -> Iterator[tuple[int, bytes]]:
    """The sheet's rows in blocks of whole ones, with the number of the row before each block; 0 if there is none."""
    rest, base, number, closed = b"", 0, 0, False
    for chunk in _and_none(chunks):
        rest += chunk or b""
        cut = _last_row(rest) if chunk is not None else len(rest)
        if cut <= 0:
            continue
        block, rest = rest[:cut], rest[cut:]
        shut = re.search(rb"</sheetData|<sheetData\s*/>", block)
        low = max(0, sheet.start - base)
        high = shut.start() if shut else len(block)
        if sheet.end is not None and base + high > sheet.end:
            later = _ROW.search(block, max(0, sheet.end - base))
            high, closed = min(high, later.start() if later else high), True
        first = _ROW.search(block, low, high) if low < high else None
        begin = first.start() if first else high
        number = _number_after(block[:begin], number)
        if first:
            yield number, block[begin:high]
            number = _number_after(block[begin:high], number)
        base, closed = base + len(block), closed or shut is not None
        if closed:
            break
    if not closed:
        raise WorkbookError(f"{sheet.book}: the sheet {sheet.name} has no end")
    if sheet.end is None:
        for _ in chunks:  # the zip's checksum is looked at with the last byte
            pass


def _and_none(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from chunks
    yield None


class _Cells:
    """What the cells of a workbook mean; the shared strings are read when the first cell has one."""

    def __init__(self, book: zipfile.ZipFile):
        self.book, self.kinds = book, _kinds(book)
        settings = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
        self.since_1904 = settings is not None and settings.get("date1904") in ("1", "true")

    @cached_property
    def strings(self) -> Strings:
        return Strings(self.book)

    def kind(self, style: int) -> str:
        return self.kinds[style] if style < len(self.kinds) else NUMBER

    def value(self, form: str, kind: str, text: str | None) -> tuple | None:
        """(kind, text, number) of a cell by its form, its style's kind and its value; None if it is empty or an error."""
        if not text and form != "inlineStr" or form == "e":
            return None
        if form == "s":
            text = self.strings[int(text)]
        elif form == "b":
            return LOGICAL, None, float(text)
        elif form == "d":
            return MOMENT, dt.datetime.fromisoformat(text).replace(tzinfo=None).isoformat(" "), None
        elif form not in ("str", "inlineStr"):
            number = float(text)
            if kind == MOMENT and number >= 0:
                return (MOMENT, moment(number, self.since_1904).isoformat(" "), number) if number >= 1 else (TIME, _clock(number), number)
            return (TIME, _clock(number), number) if kind == TIME else (NUMBER, text, number)
        return None if text in MISSING else (TEXT, text, None)


def _batch(sheet: Sheet, last: int, numbers: np.ndarray, counts: np.ndarray, cells: pa.Array) -> pa.RecordBatch:
    """Rows by their numbers and numbers of cells; the row before has the number ``last``, rows that are left out are empty ones."""
    before = np.concatenate([[last], numbers[:-1]])
    gaps = np.where(before > 0, np.maximum(numbers - before - 1, 0), 0)
    ends = np.cumsum(gaps + 1)
    own = np.zeros(ends[-1], np.int64)
    own[ends - 1] = counts
    rows = np.repeat(numbers - ends + 1, gaps + 1) + np.arange(ends[-1])
    n = len(rows)
    top = np.zeros(n, bool)
    top[0] = last == 0
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), cells)
    values = [pa.repeat(pa.scalar(v, t), n) for v, t in ((sheet.book, pa.string()), (sheet.name, pa.string()), (sheet.place, pa.int32()))]
    return pa.RecordBatch.from_arrays([*values, pa.array(rows, pa.int64()), pa.array(top), lists], ["book", "sheet", "place", "row", "top", "cells"])


def read_sheet(sheet: Sheet) -> Iterator[pa.RecordBatch]:
    """The sheet's rows with the cells that have a value."""
    with _opened(sheet.book) as book:
        meaning = _Cells(book)
        with book.open(sheet.part) as f:
            chunks = _plain(f)
            head = next(chunks, b"")
            if root := _root(head):
                for last, block in _blocks(_after(head, chunks), sheet):
                    found = _regular(block, meaning)
                    if found is None:
                        whole = ElementTree.fromstring(b"".join([root, block, b"</sheetData></worksheet>"]))
                        yield from _parsed(whole.iter(f"{_MAIN}row"), sheet, last, meaning)
                    else:
                        yield _batch(sheet, last, *found)
                return
        with book.open(sheet.part) as f:
            yield from _parsed((e for _, e in _elements(f, "row")), sheet, 0, meaning)


def _after(head: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from chunks


def _parsed(rows: Iterator[ElementTree.Element], sheet: Sheet, last: int, meaning: _Cells, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Parsed rows, some thousand in a batch."""
    numbers, counts, cells, number = [], [], [], last
    for row in rows:
        number = int(row.get("r", number + 1))
        own, at = [], -1
        for c in row.iter(f"{_MAIN}c"):
            at = column_number(c.get("r")) if c.get("r") else at + 1
            form, v = c.get("t", NUMBER), c.find(f"{_MAIN}v")
            if form == "inlineStr":
                e = c.find(f"{_MAIN}is")
                text = _string(e) if e is not None else ""
            else:
                text = v.text if v is not None else None
            if found := meaning.value(form, meaning.kind(int(c.get("s", 0))), text):
                own.append((at, *found))
        numbers.append(number)
        counts.append(len(own))
        cells += own
        if len(numbers) >= most:
            yield _batch(sheet, last, np.array(numbers), np.array(counts), pa.array(cells, _CELL))
            last, numbers, counts, cells = number, [], [], []
    if numbers:
        yield _batch(sheet, last, np.array(numbers), np.array(counts), pa.array(cells, _CELL))


_FIRST = re.compile(r'<row r="([0-9]+)"[^<>/]*>\s*$')
# a cell as programs write it, after "<c ", and the end of its row with the start of the next one
_REGULAR = (
    r'^r="(?P<column>[A-Z]{1,3})(?P<row>[0-9]{1,9})"(?: s="(?P<style>[0-9]{1,9})")?(?: t="(?P<form>[a-zA-Z]+)")?'
    r'(?:/>|>(?:<v>(?P<v>[^<]*)</v>|<is><t(?: xml:space="preserve")?>(?P<inline>[^<]*)</t></is>)?</c>)'
    r'\s*(?P<over></row>\s*(?:<row r="(?P<next>[0-9]{1,9})"[^<>/]*>\s*)?)?$'
)
_FORMS = ("", NUMBER, "s", "b", "d", "e", "str", "inlineStr")


def _regular(block: bytes, meaning: _Cells) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """(numbers, numbers of cells, cells) of rows in the form that programs write; None for other ones, which the XML parser reads."""
    if b"\r" in block:
        return None
    try:
        pieces = pc.split_pattern(pa.array([block.decode()]), "<c ").flatten()
    except UnicodeDecodeError:
        return None
    first, cells = _FIRST.match(pieces[0].as_py()), pieces[1:]
    found = pc.extract_regex(cells, _REGULAR)
    if not first or not len(cells) or found.null_count:
        return None
    column, row, style, form, v, inline, over, following = found.flatten()
    ends = pc.not_equal(over, "").to_numpy(zero_copy_only=False)
    follows = pc.not_equal(following, "").to_numpy(zero_copy_only=False)
    if not ends[-1] or follows[-1] or (ends[:-1] != follows[:-1]).any():
        return None
    numbers = np.concatenate([[int(first[1])], following.filter(pa.array(follows)).cast(pa.int64()).to_numpy()])
    row_of = np.cumsum(ends) - ends
    if (row.cast(pa.int64()).to_numpy() != numbers[row_of]).any():
        return None
    form, style = form.dictionary_encode(), style.dictionary_encode()
    forms, form = form.dictionary.to_pylist(), form.indices.to_numpy()
    if not set(forms) <= set(_FORMS):
        return None
    kinds, style = [meaning.kind(int(i or 0)) for i in style.dictionary.to_pylist()], style.indices.to_numpy()
    is_number, is_text = np.array([f in ("", NUMBER) for f in forms])[form], np.array([f in ("str", "inlineStr") for f in forms])[form]
    is_plain = is_number & np.array([k == NUMBER for k in kinds])[style]
    is_inline = np.array([f == "inlineStr" for f in forms])[form]
    payload = pc.if_else(pa.array(is_inline), inline, v)
    filled = pc.not_equal(payload, "").to_numpy(zero_copy_only=False)
    parts = []
    # numbers of no date
    at = np.flatnonzero(is_plain & filled)
    own = payload.take(pa.array(at))
    try:
        parts.append((at, pa.repeat(NUMBER, len(at)), own, own.cast(pa.float64())))
    except pa.ArrowInvalid:
        return None
    # texts that stand in their cells
    at = np.flatnonzero(is_text & filled)
    own = payload.take(pa.array(at))
    if pc.any(pc.match_substring(own, "&")).as_py():
        coded = own.dictionary_encode()
        own = pa.array([ElementTree.fromstring(f"<t>{t}</t>").text if "&" in t else t for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    kept = pc.invert(pc.is_in(own, pa.array(MISSING)))
    at, own = at[kept.to_numpy(zero_copy_only=False)], own.filter(kept)
    parts.append((at, pa.repeat(TEXT, len(at)), own, pa.nulls(len(at), pa.float64())))
    # the others, each different one once
    at = np.flatnonzero(~is_plain & ~is_text & filled)
    coded = payload.take(pa.array(at)).dictionary_encode()
    texts = coded.dictionary.to_pylist()
    if any("&" in t for t in texts):
        return None
    keys, which = np.unique((form[at].astype(np.int64) * len(kinds) + style[at]) * (len(texts) or 1) + coded.indices.to_numpy(), return_inverse=True)
    values = []
    for key in keys.tolist():
        key, t = divmod(key, len(texts))
        values.append(meaning.value(forms[key // len(kinds)] or NUMBER, kinds[key % len(kinds)], texts[t]))
    has = np.array([x is not None for x in values], bool)[which]
    which, at = pa.array(which[has]), at[has]
    own = [pa.array([x[i] if x else None for x in values], t).take(which) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
    parts.append((at, *own))
    at = np.concatenate([p[0] for p in parts])
    order = np.argsort(at, kind="stable")
    at = at[order]
    column = column.dictionary_encode()
    places = pa.array([column_number(c) for c in column.dictionary.to_pylist()], pa.int32()).take(column.indices.take(pa.array(at)))
    own = [pa.concat_arrays([p[i] for p in parts]).take(pa.array(order)) for i in (1, 2, 3)]
    return numbers, np.bincount(row_of[at], minlength=len(numbers)), pa.StructArray.from_arrays([places, *own], fields=list(_CELL))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        return [s for book in workbooks(self.path) for s in sheets(book)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        return read_sheet(partition)


# ---------------------------------------------------------------- writing

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{sheets}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" '
    'formatCode="yyyy\\-mm\\-dd hh:mm:ss.000"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: What XML can't hold; it is left out.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def column_name(at: int) -> str:
    """27 -> AB."""
    name = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        name = chr(65 + rest) + name
    return name


def _xml_value(value) -> str | None:
    """A cell from the end of its reference on; None for no cell."""
    if value is None:
        return None
    if isinstance(value, bool):
        return f'" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (dt.datetime, dt.date)):
        full = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        days = (full.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        if days >= 61:
            return f'" s="{2 if isinstance(value, dt.datetime) else 1}"><v>{days!r}</v></c>'
        value = str(value)  # the format has no such day
    if isinstance(value, (int, float)) and abs(value) < 1 << 53:
        return f'"><v>{value!r}</v></c>'
    text = escape(_FORBIDDEN.sub("", str(value)), {"\r": "&#13;"})
    return f'" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _xml_values(column: pa.Array) -> pa.Array:
    """:func:`_xml_value` of a column, each different value made once."""
    if pa.types.is_integer(column.type):
        most = pc.min_max(column)
        if most["min"].is_valid and -(1 << 53) < most["min"].as_py() and most["max"].as_py() < 1 << 53:
            return pc.binary_join_element_wise('"><v>', column.cast(pa.string()), "</v></c>", "")
    try:
        coded = column.dictionary_encode()
        values, places = coded.dictionary.to_pylist(), coded.indices
    except pa.ArrowNotImplementedError:
        values, places = column.to_pylist(), pa.array(range(len(column)))
    if pa.types.is_timestamp(column.type) and column.type.tz:  # in the worker's zone, as Spark's rows have it
        values = [v and v.astimezone().replace(tzinfo=None) for v in values]
    return pa.array([_xml_value(v) for v in values], pa.string()).take(places)


def _xml_rows(first: int, references: list[str], rows: pa.RecordBatch) -> memoryview:
    """Rows from a number on."""
    numbers = pa.array(np.arange(first, first + rows.num_rows)).cast(pa.string())
    cells = [pc.binary_join_element_wise(f'<c r="{c}', numbers, _xml_values(v), "").fill_null("") for c, v in zip(references, rows.columns)]
    xml = pc.binary_join_element_wise('<row r="', numbers, '">', *cells, "</row>", "")
    return memoryview(b"" if not len(xml) else xml.buffers()[2])[: np.frombuffer(xml.buffers()[1], np.int32)[len(xml)]]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some megabytes."""
    for batch in batches:
        rows = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes))
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def write_book(path: str, names: list[str], batches: Iterator[pa.RecordBatch], sheet_rows: int = SHEET_ROWS) -> int:
    """Write the rows as they come, each sheet with a header; returns their number."""
    fs, own = _system(path)
    references = [column_name(i) for i in range(len(names))]
    header = _xml_rows(1, references, pa.RecordBatch.from_arrays([pa.array([n]) for n in names], references))
    written = n_sheets = 0
    batches = _small(batches)
    batch = next(batches, None)
    with fs.open_output_stream(own) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as book:
        while batch is not None or not n_sheets:
            n_sheets += 1
            with book.open(f"xl/worksheets/sheet{n_sheets}.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'.encode())
                f.write(header)
                number = 2
                while batch is not None and number <= sheet_rows:
                    rows = batch.slice(0, sheet_rows + 1 - number)
                    f.write(_xml_rows(number, references, rows))
                    number, written = number + rows.num_rows, written + rows.num_rows
                    batch = batch.slice(rows.num_rows) if rows.num_rows < batch.num_rows else next(batches, None)
                f.write(b"</sheetData></worksheet>")
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}"/>' for i in range(1, n_sheets + 1))
        for name, text in _PARTS.items():
            book.writestr(name, _HEAD + text.replace("{sheets}", overrides))
        listed = "".join(f'<sheet name={quoteattr(f"Sheet{i}")} sheetId="{i}" r:id="rId{i}"/>' for i in range(1, n_sheets + 1))
        marks = "".join(f'<definedName name="{CONTINUED}" localSheetId="{i}" hidden="1">TRUE</definedName>' for i in range(1, n_sheets))
        marks = marks and f"<definedNames>{marks}</definedNames>"
        book.writestr(
            "xl/workbook.xml",
            f'{_HEAD}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            f'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets>{marks}</workbook>',
        )
        link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        links = "".join(f'<Relationship Id="rId{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n_sheets + 1))
        links += f'<Relationship Id="rId{n_sheets + 1}" Type="{link}/styles" Target="styles.xml"/>'
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    return written


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """A workbook for each partition, named by it; a task that runs again writes the same one."""

    def __init__(self, path: str, names: list[str], overwrite: bool, sheet_rows: int):
        self.path, self.names, self.overwrite, self.sheet_rows = path.rstrip("/"), names, overwrite, sheet_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, own = _system(self.path)
        fs.create_dir(own, recursive=True)
        part = f"part-{context.partitionId():05}.xlsx"
        half_done = f"{own}/.{part}.{context.taskAttemptId()}"
        rows = write_book(f"{self.path}/{os.path.basename(half_done)}", self.names, iter(iterator), self.sheet_rows)
        fs.move(half_done, f"{own}/{part}")
        return _Written(f"{own}/{part}", rows)

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:  # workbooks of an earlier write
            fs, own = _system(self.path)
            kept = {m.path.rpartition("/")[2] for m in messages if m}
            for f in fs.get_file_info(pafs.FileSelector(own, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".xlsx") and f.base_name not in kept:
                    fs.delete_file(f.path)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m:
                fs, own = _system(m.path)
                fs.delete_file(own)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")`` gives rows of cells; ``df.write.format("workbook")`` writes a workbook for each partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema.names, overwrite, int(self.options.get("sheetRows", SHEET_ROWS)))


# ---------------------------------------------------------------- datasets


def register(spark: SparkSession) -> SparkSession:
    share_package(spark)
    spark.dataSource.register(WorkbookSource)
    return spark


def read_excel(spark: SparkSession, path: str, sheet: int | str | None = 0, header: bool = True) -> DataFrame:
    """A sheet of a workbook, or of each workbook in a folder, as a table; ``None`` takes all sheets.

    A sheet's number also takes the successors that :func:`write_excel` has given it.
    The first row of each sheet names its columns; names that are missing or
    repeated get a number.  A column of whole numbers is a bigint, of numbers a double, of
    true and false a boolean, of moments a timestamp; of anything else, or of
    several kinds, it is text, times of day too.  Errors, empty cells and texts that
    stand for a missing value are null.  Rows between others may be empty; empty
    ones at the end are left out.  A sheet without cells has no columns.
    """
    raw = register(spark).read.format(FORMAT).load(path)
    if sheet is not None:
        raw = raw.filter(F.col("place") == sheet if isinstance(sheet, int) else F.col("sheet") == sheet)
    keys, cell = ["book", "sheet", "place"], F.col("c")
    # a row for each column of a sheet, its first row apart: all that is to be known before the rows are read
    seen = raw.select(*keys, "row", "top", F.explode_outer("cells").alias("c")).groupBy(*keys, (F.col("top") & F.lit(header)).alias("top"), cell["at"].alias("at")).agg(
        F.max(F.when(cell.isNotNull(), F.col("row"))).alias("end"), F.first("c").alias("c"), F.collect_set(cell["kind"]).alias("kinds"),
        F.bool_and(cell["number"] == F.floor(cell["number"])).alias("whole"), F.max(F.abs(cell["number"])).alias("most"),
    ).persist()
    # one row for each sheet
    ends = seen.groupBy(*keys).agg(F.max("end").alias("end")).collect()
    first = min(((r["book"], r["place"]) for r in ends), default=None)
    names = _names(seen.filter((F.col("book") == first[0]) & (F.col("place") == first[1]) & F.col("top") & F.col("at").isNotNull())) if header and first else {}
    columns = seen.filter(~F.col("top") & F.col("at").isNotNull()).groupBy("at").agg(
        F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"), F.bool_and("whole").alias("whole"), F.max("most").alias("most")
    )
    columns = {r["at"]: r for r in columns.collect()}
    seen.unpersist()
    own = spark.createDataFrame(ends, "book string, sheet string, place int, end long")
    body = raw.join(F.broadcast(own), keys).filter(~F.col("top") if header else F.lit(True)).filter("row <= end")
    width = max([*columns, *names, -1]) + 1
    titles = _distinct(names.get(at) or f"Unnamed: {at}" for at in range(width)) if header else [f"_c{at}" for at in range(width)]
    value = lambda at: F.get("cells", F.array_position(F.col("cells.at"), F.lit(at)) - 1)
    if not titles:
        return spark.createDataFrame([], T.StructType([]))
    return body.select(*[_typed(value(at), columns.get(at)).alias(title) for at, title in enumerate(titles)])


def _typed(cell, seen: Row | None):
    kinds = set(seen["kinds"]) if seen else set()
    if kinds == {NUMBER}:
        return cell["number"].cast("long") if seen["whole"] and seen["most"] < 1 << 53 else cell["number"]
    if kinds == {LOGICAL}:
        return cell["number"] == 1
    if kinds == {MOMENT}:
        return cell["text"].try_cast("timestamp_ntz").cast("timestamp")
    return F.when(cell["kind"] == LOGICAL, F.when(cell["number"] == 1, "True").otherwise("False")).otherwise(cell["text"])


def _names(top: DataFrame) -> dict[int, str]:
    """The column names in a sheet's first row; a row of at most 16,384 cells."""
    cells = [r["c"] for r in top.collect()]
    return {c["at"]: c["text"] if c["text"] is not None else str(bool(c["number"])) for c in cells}


def _distinct(names) -> list[str]:
    """Repeated names get a dot and a number."""
    out: list[str] = []
    for name in names:
        n, own = 0, name
        while own.lower() in (o.lower() for o in out):
            n += 1
            own = f"{name}.{n}"
        out.append(own)
    return out


def write_excel(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """A folder with a workbook for each partition; nested values come as JSON, decimals as doubles."""
    register(df.sparkSession)

    def plain(f: T.StructField):
        c = compat.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        return c.alias(f.name)

    own = df.select(*[plain(f) for f in df.schema])
    own.write.format(FORMAT).mode("overwrite").option("sheetRows", sheet_rows).save(path)
