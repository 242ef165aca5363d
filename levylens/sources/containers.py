"""Tables of a file by its suffix, row by row; gz and zip are opened and their members read in turn.

Nothing is held but a row, a workbook's shared strings and what the file itself is read from: members
are decompressed as they are read, sheets are parsed element by element, and pages row by row.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

from . import delimited, export, markup

Rows = list[list[str]]
#: Suffixes of files that hold tables, and of those that hold such files.
TABLES, PACKED = ("csv", "txt", "tsv", "xls", "xlsx", "xlsm", "htm", "html", "xml"), ("gz", "zip")
MEMBER = re.compile(rf"\.({'|'.join(TABLES + PACKED[:1])})$", re.I)
#: The table that stands for an export, whose records are no rows.
EXPORT = "export"
#: Bytes of a workbook within an archive that are held before it goes to a local temporary file.
SPOOLED = 64 << 20


def streams(name: str, stream: IO[bytes], part: int | None = None) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Names and rows of the tables in order; of an archive or workbook only the part-th member or sheet, if given. xls needs a reader that is not installed."""
    low = name.lower()
    if low.endswith(".gz"):
        yield from streams(name[:-3], gzip.GzipFile(fileobj=stream), part)
    elif low.endswith(".zip"):
        with zipfile.ZipFile(stream) as z:
            for at, inner in enumerate(members(z)):
                if part in (None, at):
                    with z.open(inner) as member:
                        for table, rows in streams(inner, _seekable(inner, member)):
                            yield f"{inner}:{table}", rows
    elif low.endswith((".xlsx", ".xlsm")):
        yield from sheets(stream, only=part)
    elif low.endswith(".xls"):
        raise NotImplementedError("xls workbooks: save them as xlsx")
    else:
        stream = io.BufferedReader(stream, export.PROBE) if not isinstance(stream, io.BufferedReader) else stream
        head = stream.peek(export.PROBE)[: export.PROBE]
        sample = head[: delimited.SAMPLE_BYTES]
        encoding = delimited.detect_encoding(sample)
        if low.endswith(".xml") and export.looks_like_export(head.decode(encoding, errors="replace")):
            yield EXPORT, iter(())
        elif low.endswith((".htm", ".html")):
            yield "html", markup.html_stream(io.TextIOWrapper(stream, encoding=encoding, errors="replace"))
        else:
            text = io.TextIOWrapper(stream, encoding=encoding, errors="replace", newline="")
            yield "csv", ([delimited.clean_cell(c) for c in row] for row in csv.reader(text, delimiter=delimited.detect_delimiter(sample.decode(encoding, errors="replace"))))


def _seekable(name: str, member: IO[bytes]) -> IO[bytes]:
    """A member as it is, or, if its format needs seeking, spooled."""
    if not name.lower().endswith((".xlsx", ".xlsm")):
        return member
    out = tempfile.SpooledTemporaryFile(SPOOLED)  # gone with the task  # noqa: SIM115
    while block := member.read(1 << 20):
        out.write(block)
    out.seek(0)
    return out


def members(z: zipfile.ZipFile) -> list[str]:
    return [n for n in z.namelist() if MEMBER.search(n)]


def n_parts(name: str, content: bytes) -> int:
    """How many members or sheets can be read on their own."""
    low = name.lower()
    if not low.endswith((".zip", ".xlsx", ".xlsm")):
        return 1
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return max(1, len(members(z)) if low.endswith(".zip") else len(_sheets(z)))


def tables(name: str, content: bytes) -> Iterator[tuple[str, Rows]]:
    """The same with all rows of a table at once, for small files."""
    for table, rows in streams(name, io.BytesIO(content)):
        yield table, list(rows)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _elements(stream: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag one by one; what is behind is cleared."""
    above: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if node.tag == tag:
            yield node
            if above:
                above[-1].clear()


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets in order, and their places in the archive."""
    target = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    listed = [(s.get("name"), target[s.get(_REL)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    return [(name, path if path.startswith("xl/") else f"xl/{path}") for name, path in listed]


def sheets(stream: IO[bytes], sheet: str | int | None = None, only: int | None = None) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Sheets of a workbook in order, with the values that were kept for formulas."""
    with zipfile.ZipFile(stream) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [_text(x) for x in _elements(f, f"{_NS}si")]
        for at, (name, path) in enumerate(_sheets(z)):
            if (sheet is None or sheet in (name, at)) and only in (None, at):
                with z.open(path) as f:
                    yield name, _sheet_rows(f, shared)


def _sheet_rows(stream: IO[bytes], shared: list[str]) -> Iterator[list[str]]:
    said = 0
    for row in _elements(stream, f"{_NS}row"):
        cells: list[str] = []
        for c in row.iter(f"{_NS}c"):
            i = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (i + 1 - len(cells))
            value = c.find(f"{_NS}v")
            raw = "" if value is None else value.text or ""
            cells[i] = delimited.clean_cell(shared[int(raw)] if c.get("t") == "s" and raw else _text(c) if c.get("t") == "inlineStr" else raw)
        for _ in range(said, int(row.get("r") or said + 1) - 1):
            said += 1
            yield []
        said += 1
        yield cells


def workbook(content: bytes, sheet: str | int | None = None) -> Iterator[tuple[str, Rows]]:
    """Sheets with all their rows at once, for small workbooks."""
    for name, rows in sheets(io.BytesIO(content), sheet):
        yield name, list(rows)
