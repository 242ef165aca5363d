"""Delimited files of any size, split wherever their blocks lie: ragged rows, title rows and quoted line ends stay.

Spark's text reader cuts files into lines by blocks. Whether a line begins a row depends on all quotes
before it, so a line is a function of the state in which it is met, inside a quoted cell or not, and a
block is the composition of its lines' functions. The first pass states each block's function and its
rows under both states, for each delimiter that may turn out to be the file's, and the file's first lines
tell encoding and delimiter. The blocks' functions are then composed in order, a row a block,
which gives each block its state and the number of its first row. The second pass cuts the rows; a block
that begins inside a quoted cell sends the end of that row to the row's own, by its number.

The rules of quotes are those of Python's csv module.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens import session

from . import delimited

#: What a block says of itself: for each delimiter, the state after it and its rows if it begins outside and inside a quoted cell.
BLOCK = "file string, start long, head binary, after array<array<boolean>>, rows array<array<long>>"
STATE = "file string, start long, encoding string, delimiter string, inside boolean, first long"
#: Bytes of the longest line and row: what a row of Spark's can hold.
LONGEST = (1 << 31) - 1


def ends_inside(line: bytes, delimiter: bytes, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or at a row's begin, ends inside one."""
    at, end = 0, len(line)
    while True:
        if not inside:
            if line[at : at + 1] != b'"':  # a plain cell: quotes in it are letters
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == b'"':
            at, inside = at + 2, True
            continue
        at = line.find(delimiter, at + 1) + 1  # what follows a closing quote belongs to the cell
        if not at or at > end:
            return False
        inside = False


def _functions(lines: list[bytes], state: list[list[bool]], rows: list[list[int]]) -> None:
    """Carries the state after, and the rows begun, of each delimiter and beginning over some lines."""
    for line in lines:
        quoted = b'"' in line
        for k, d in enumerate(delimited.DELIMITERS):
            for s in (0, 1):
                rows[k][s] += not state[k][s]
                if quoted:
                    state[k][s] = ends_inside(line, d.encode(), state[k][s])


def _lines(spark: SparkSession, path: str | list[str], longest: int) -> DataFrame:
    raw = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", longest).text(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # as other readers name the file
    return raw.select(name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


@lru_cache
def by_bytes(encoding: str) -> bool:
    """Whether quotes, delimiters and line ends are single bytes of the encoding, and no part of other letters."""
    try:
        name = codecs.lookup(encoding).name
        plain = bytes(range(128)).decode(encoding) == "".join(map(chr, range(128)))
        return name.startswith("utf-8") or plain and len(bytes(range(256)).decode(encoding, errors="replace")) == 256
    except (LookupError, UnicodeError):
        return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """The lines of a batch by block, in order."""
    for batch in batches:
        files, starts, lines = (batch.column(k).to_pylist() for k in range(3))
        a = 0
        for b in range(1, len(files) + 1):
            if b == len(files) or (files[b], starts[b]) != (files[a], starts[a]):
                yield files[a], starts[a], lines[a:b]
                a = b


def blocks(lines: DataFrame) -> DataFrame:
    """The first pass: a row a block."""
    n = len(delimited.DELIMITERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([head], pa.binary()), pa.array([state], pa.list_(pa.list_(pa.bool_()))), pa.array([rows], pa.list_(pa.list_(pa.int64())))], ["file", "start", "head", "after", "rows"])

        file = None
        for name, at, some in _runs(batches):
            if (name, at) != (file, start if file is not None else None):
                if file is not None:
                    yield out()
                file, start, head, state, rows = name, at, b"", [[False, True] for _ in range(n)], [[0, 0] for _ in range(n)]
            if start + len(head) < delimited.SAMPLE_BYTES:
                head = (head + b"\n".join([*some[:2_000], b""]))[: delimited.SAMPLE_BYTES]
            _functions(some, state, rows)
        if file is not None:
            yield out()

    return lines.mapInArrow(run, BLOCK)


def states(found: DataFrame, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """Each block's state and first row, by composing the functions of the blocks before it; a file's blocks are one group, of a row for each split."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        head = b"".join(frame["head"])[: delimited.SAMPLE_BYTES]
        name = encoding or delimited.detect_encoding(head)
        sep = delimiter or (delimited.detect_delimiter(head.decode(name, errors="replace")) if by_bytes(name) else delimited.DELIMITERS[0])
        k, inside, first, out = delimited.DELIMITERS.index(sep), False, 0, []
        for r in frame.itertuples():
            out.append((r.file, r.start, name, sep, inside, first))
            first += int(r.rows[k][int(inside)])
            inside = bool(r.after[k][int(inside)])
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return found.groupBy("file").applyInPandas(run, STATE)


def _cells(raw: bytes | None, encoding: str, delimiter: str, limited: bool) -> list[str]:
    limit = csv.field_size_limit()
    if raw is None:
        raise csv.Error(f"field larger than field limit ({limit})")
    text = raw.decode(encoding, errors="replace")
    if not limited and len(text) > limit:  # the limit is the process's, so it is set back
        csv.field_size_limit(len(text))
    try:
        row = next(csv.reader([text], delimiter=delimiter), [])
    finally:
        csv.field_size_limit(limit)
    return [delimited.clean_cell(c) for c in row]


def read_ragged(spark: SparkSession, path: str | list[str], encoding: str | None = None, delimiter: str | None = None, longest: int = LONGEST) -> DataFrame:
    """The rows of every delimited file below path, as read_tables() gives them, but by blocks: file, table, table_at, row_idx and cells.

    encoding and delimiter are by default each file's own, as its first lines tell them; encodings in which
    quotes, delimiters and line ends are not single bytes are not read. A cell may be of any length, as a
    task can hold its row; a line of over `longest` bytes is passed over. Blocks must be cut alike in both passes, so settings of file splits must not change between.
    """
    if delimiter is not None and delimiter not in delimited.DELIMITERS:
        raise ValueError(f"the delimiter must be one of {delimited.DELIMITERS!r}")
    session.bind(spark)
    lines = _lines(spark, path, longest)
    return _cut(lines, session.kept(states(blocks(lines), encoding, delimiter)))  # a row a block


def read_files(spark: SparkSession, paths: list[str], longest: int = 32 << 20) -> tuple[DataFrame, list[str]]:
    """I4: read_ragged() of listed files, in which a row that cannot be cut, as one with a cell beyond the csv module's limit, is one of the table ERROR, and those files that are not read so, as their encodings are none of single bytes."""
    session.bind(spark)
    lines = _lines(spark, paths, longest)
    known = session.kept(states(blocks(lines)))  # a row a block
    named = [r.encoding for r in known.select("encoding").distinct().collect()]
    odd = F.col("encoding").isin([n for n in named if not by_bytes(n)])
    return _cut(lines, known, odd, errors=True), sorted(r.file for r in known.where(odd).select("file").distinct().toLocalIterator())


def _cut(lines: DataFrame, known: DataFrame, left_out: Column | None = None, errors: bool = False) -> DataFrame:
    """The second pass over lines, from what is known of their blocks. With errors, a quoted cell beyond the csv module's limit ends there, as does what is held of it."""
    longest_cell = 4 * csv.field_size_limit() if errors else LONGEST  # a letter has at most four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, at, held, cell, over = None, False, -1, None, 0, False  # held: the begun row; cell: bytes since the last quote

        def whole() -> bytes | None:
            return None if over else bytes(held)

        for batch in batches:
            out: list[tuple] = []
            for file, start, line, name, sep, state, first in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if name is None:
                    raise ValueError(f"{file} is cut into other blocks than before: {start}")
                if (file, start) != block:
                    if held is not None:
                        out.append((block[0], at, block[1], whole(), own))
                    block, inside, at, held, own, cell, over = (file, start), state, first - 1, None, (name, sep), 0, False
                at += not inside
                quoted = b'"' in line
                cell = 0 if quoted or not inside else cell + len(line)
                over = over or cell > longest_cell
                if over:
                    held = bytearray()
                elif held is None:
                    held = bytearray(line)
                else:
                    held += b"\n"
                    held += line
                inside = ends_inside(line, sep.encode(), inside) if quoted else inside
                if not inside:
                    out.append((file, at, start, whole(), own))
                    held, over = None, False
            yield _pieces(out)
        if held is not None:
            yield _pieces([(block[0], at, block[1], whole(), own)])

    placed = lines.join(F.broadcast(known), ["file", "start"], "left")
    placed = (placed if left_out is None else placed.where(F.coalesce(~left_out, F.lit(True)))).select("file", "start", "line", "encoding", "delimiter", "inside", "first")  # of a row for each split of the input
    pieces = placed.mapInArrow(run, "file string, row_idx long, start long, raw binary, encoding string, delimiter string")
    cut = known.where("inside").select("file", (F.col("first") - 1).alias("row_idx")).distinct()  # rows across blocks
    if not cut.limit(1).count():
        return _rows(pieces, errors)
    whole = pieces.join(F.broadcast(cut), ["file", "row_idx"], "left_anti")
    across = pieces.join(F.broadcast(cut), ["file", "row_idx"], "left_semi").groupBy("file", "row_idx", "encoding", "delimiter")
    joined = across.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("raw").alias("raw")))), lambda x: x["raw"]), "0A").alias("raw"), F.bool_or(F.col("raw").isNull()).alias("over")).withColumn("raw", F.when(~F.col("over"), F.unhex("raw"))).drop("over")
    return _rows(whole.select(*joined.columns).unionByName(joined), errors)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()), *(pa.array([r[4][k] for r in rows], pa.string()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(cols, ["file", "row_idx", "start", "raw", "encoding", "delimiter"])


def _rows(pieces: DataFrame, errors: bool = False) -> DataFrame:
    """Cells of whole rows; with errors, what keeps a row from being cut stands in its place."""

    def cut(raw: bytes | None, name: str, sep: str) -> tuple[str, list[str]]:
        try:
            return "csv", _cells(raw, name, sep, errors)
        except csv.Error as e:
            if not errors:
                raise
            return delimited.ERROR, [type(e).__name__, str(e)[:500]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(raw, name, sep) for raw, name, sep in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([0] * n, pa.int32()), batch.column(1), pa.array([c for _, c in found], pa.list_(pa.string()))], ["file", "table", "table_at", "row_idx", "cells"])

    return pieces.select("file", "row_idx", "raw", "encoding", "delimiter").mapInArrow(run, delimited.RAW)
