"""XML exports of norms: records (tp) with rates (tr) and benefits (tb), and the dictionary (li) of their ids.

Exports of several gigabytes are one file, so the scan splits them: Spark's text reader cuts a file at
the records' ends wherever its blocks lie and hands on raw bytes, so a record across two blocks is read
whole by one task, and the bytes are decoded and taken apart in Arrow batches. Tags are found by
patterns, not by a parser, since broken markup between records must do no harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens import session

RECORD = "file string, attrs map<string,string>, tr array<map<string,string>>, tb array<map<string,string>>"
#: Bytes by which an export is recognised; bytes of the longest record; bytes within which the dictionary lies.
PROBE, LONGEST, LISTED = 1 << 18, 8 << 20, 64 << 20

_TAG = r"""((?:[^>"']|"[^"]*"|'[^']*')*)>"""
_attribute = re.compile(r"""([:\w.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_record = re.compile(rf"<tp\b{_TAG}", re.I)
_child = re.compile(rf"<(tr|tb)\b{_TAG}", re.I)
_begins = re.compile(r"<tp\b", re.I)
_item = re.compile(rf"<li\b{_TAG}", re.I)

Attributes = list[tuple[str, str]]


def looks_like_export(head: str) -> bool:
    """S18."""
    return bool(_begins.search(head)) or ("List_value" in head and "<li " in head.lower())


def attributes(raw: str) -> Attributes:
    """The attributes of a tag, with all entities undone; of repeated names the last counts."""
    return list({m[1]: html.unescape(m[2] if m[2] is not None else m[3]) for m in _attribute.finditer(raw)}.items())


def decoded(raw: bytes, encoding: str | None) -> str:
    """Text of an encoding; by default UTF-8, or cp1251 where it is not."""
    if encoding:
        return raw.decode(encoding, errors="replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp1251", errors="replace")


def records_of(text: str) -> Iterator[tuple[Attributes, list[Attributes], list[Attributes]]]:
    """The records that begin in a piece of text: attributes, rates and benefits; the last may lack its end, and a record may close itself."""
    starts = [m.start() for m in _begins.finditer(text)]
    for a, b in zip(starts, [*starts[1:], len(text)]):
        head = _record.match(text, a, b)
        if head:
            children = [] if head[1].endswith("/") else [(m[1].lower(), attributes(m[2])) for m in _child.finditer(text, head.end(), b)]
            yield attributes(head[1]), [x for tag, x in children if tag == "tr"], [x for tag, x in children if tag == "tb"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.map_(pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind), *(pa.array([r[k] for r in rows], pa.list_(kind)) for k in (2, 3))], ["file", "attrs", "tr", "tb"])


def read_export(spark: SparkSession, path: str | list[str], encoding: str | None = None, longest: int = LONGEST) -> DataFrame:
    """File, attrs, tr and tb of every record below path, whatever the size of the blocks.

    Encodings by which `</tp>` is not these five bytes are not read. What lies between two ends and is
    longer than `longest` bytes is passed over, so a lost end costs no more than that in memory.
    """
    session.bind(spark)
    raw = spark.read.option("lineSep", "</tp>").option("mapreduce.input.linerecordreader.line.maxlength", longest).text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(file, *r) for r in records_of(decoded(piece.as_buffer().to_pybytes(), encoding))]
                if len(rows) >= 2_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def read_list(spark: SparkSession, path: str | list[str], encoding: str | None = None, most: int = LISTED, by_file: bool = False) -> DataFrame:
    """Id and value of the exports' dictionaries, which lie in their first `most` bytes, of each file if wanted; of repeated ids the least value."""
    session.bind(spark)
    raw = spark.read.option("lineSep", ">").option("mapreduce.input.linerecordreader.line.maxlength", LONGEST).text(path)
    items = raw.where((F.col("_metadata.file_block_start") < most) & F.regexp_like(F.col("value"), F.lit(r"(?i)<li\s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(file, dict(attributes(m[1]))) for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in _item.finditer(decoded(piece, encoding) + ">")]
            rows = [(file, a["ID"], a["List_value"]) for file, a in found if a.get("ID") and a.get("List_value")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["file", "id", "value"])

    listed = items.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, "file string, id string, value string")
    return listed.groupBy(*["file"] * by_file, "id").agg(F.min("value").alias("value"))


def stream_records(stream: IO[bytes], encoding: str | None = None, longest: int = LONGEST, chunk: int = 1 << 20) -> Iterator[tuple[Attributes, list[Attributes], list[Attributes]]]:
    """The records of an export inside an archive, which cannot be split; a chunk and a record are held."""
    left = b""
    while block := stream.read(chunk):
        *whole, left = re.split(rb"(?i)(?<=</tp>)", left + block)
        for piece in whole:
            yield from records_of(decoded(piece, encoding))
        if len(left) > longest:
            left = left[-chunk:]
    yield from records_of(decoded(left, encoding))


def read_packed(spark: SparkSession, paths: list[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and dictionary (file, id, value) of the exports inside zip archives, a task an archive; of repeated ids the least value."""
    import io
    import zipfile

    from . import containers, delimited

    session.bind(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in containers.members(z):
                        if not name.lower().endswith(".xml"):
                            continue
                        with z.open(name) as f:
                            head = f.read(PROBE)
                        if not looks_like_export(decoded(head, encoding)):
                            continue
                        with z.open(name) as f:
                            items = [attributes(m[1]) for m in _item.finditer(decoded(f.read(LISTED).split(b"</List", 1)[0], encoding))]
                        yield _batch([(file, a, None, None) for a in items])
                        rows: list[tuple] = []
                        with z.open(name) as f:
                            for r in stream_records(f, encoding):
                                rows.append((file, *r))
                                if len(rows) >= 2_000:
                                    yield _batch(rows)
                                    rows = []
                        yield _batch(rows)

    found = session.kept(delimited.files(spark, paths).select("path", "content").mapInArrow(run, RECORD))
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    listed = found.where("tr IS NULL").select("file", at("ID").alias("id"), at("List_value").alias("value")).where("id <> '' AND value <> ''")
    return found.where("tr IS NOT NULL"), listed.groupBy("file", "id").agg(F.min("value").alias("value"))
