"""Delimited text: encoding and delimiter from a sample, rows kept ragged, headers found and bound."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens import session

RAW = "file string, table string, table_at int, row_idx long, cells array<string>"
SAMPLE_BYTES, LOOKAHEAD = 1 << 16, 40
DELIMITERS = ";\t,|"
#: Suffixes of files that are read by blocks.
BLOCKWISE = ("csv", "txt", "tsv")
#: The table of a file that could not be read.
ERROR = "error"


def detect_encoding(sample: bytes) -> str:
    """A byte order mark, a declared charset, UTF-8 if it decodes, else cp1251."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if sample.startswith(mark):
            return name
    said = re.search(rb"<\?xml[^>]*\bencoding\s*=\s*[\"']([\w-]+)|charset\s*=\s*[\"']?([\w-]+)", sample[:4096], re.I)
    if said:
        try:  # a name that is no encoding's says nothing
            return codecs.lookup((said[1] or said[2]).decode()).name
        except LookupError:
            pass
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample)
        return "utf-8"
    except UnicodeDecodeError:
        return "cp1251"


def detect_delimiter(sample: str) -> str:
    """S3: the most frequent in the first 20 lines, of equals the first listed; a comma if there is none."""
    seen = Counter(chain.from_iterable(sample.splitlines()[:20]))
    votes = [seen[d] for d in DELIMITERS]
    return DELIMITERS[votes.index(max(votes))] if any(votes) else ","


def clean_cell(x: str | None) -> str:
    return " ".join((x or "").replace("–", "-").split())


def parse_delimited(content: bytes, encoding: str | None = None, delimiter: str | None = None) -> list[list[str]]:
    text = content.decode(encoding or detect_encoding(content[:SAMPLE_BYTES]), errors="replace")
    return [[clean_cell(c) for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or detect_delimiter(text[:SAMPLE_BYTES]))]


#: Folders whose files are none of the data's.
SKIPPED = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", "node_modules", "_spark_metadata")
#: Tasks among which the members of one archive or the sheets of one workbook are dealt, at most; each gets the file's bytes.
SPREAD = 8


def files(spark: SparkSession, path: str | list[str], glob: str = "*", suffixes: tuple[str, ...] | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Path, length, modificationTime and content of the files below path, or of the listed ones; hidden and lock files, files of other suffixes and those in skipped folders stay out. Content is read only where it is used."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    at = F.split(F.regexp_replace("path", scheme, ""), "/")
    name = F.element_at(at, -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    found = found.where(~name.startswith(".") & ~name.startswith("~$"))
    base = re.sub(scheme, "", path).rstrip("/") if isinstance(path, str) else ""
    if base.startswith("/") and skipped:  # folders above the given one do not matter
        depth = base.count("/") + 2
        found = found.where(~F.arrays_overlap(F.slice(at, depth, F.greatest(F.size(at) - depth, F.lit(0))), F.array(*map(F.lit, skipped))))
    return found.where(F.regexp_like(F.lower(name), F.lit(rf"\.({'|'.join(suffixes)})$"))) if suffixes else found


def read_tables(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """The rows of every table in every file, by suffix, with the tables' order; gz and zip are opened.

    Delimited files are read by blocks, unless their encoding's letters are not single bytes. Of others,
    rows are sent on as they are read; the members of an archive and the sheets of a workbook are dealt
    among tasks, and any other file is read by one. I4: a file that cannot be read gives one row, one read
    by blocks a row for each that cannot be cut, whose table is ERROR and whose cells say why.
    """
    from . import ragged

    found = files(spark, path, glob)
    plain = F.regexp_like(F.lower("path"), F.lit(rf"\.({'|'.join(BLOCKWISE)})$"))
    listed = sorted(r.path for r in found.where(plain).select("path").toLocalIterator())
    if not listed:
        return tables_of(found.select("path", "content"))
    rows, whole = ragged.read_files(spark, listed)
    rest = ~plain | F.col("path").isin(whole)
    return rows.unionByName(tables_of(found.where(rest).select("path", "content"))) if whole or found.where(~plain).limit(1).count() else rows


def tables_of(found: DataFrame) -> DataFrame:
    """read_tables() of files that are at hand as path and content."""
    from . import containers

    session.bind(found.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    n = min(SPREAD, containers.n_parts(file, content.as_buffer()))
                except Exception:  # noqa: BLE001  the reader will say why
                    n = 1
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([content.as_py()], pa.binary())], ["path", "k", "n", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k, n, content in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                rows: list[tuple] = []
                try:
                    parts = range(k, containers.n_parts(file, content.as_buffer()), n) if n > 1 else [None]
                    at = -1
                    for part in parts:
                        for table, lines in containers.streams(file, io.BytesIO(content.as_buffer()), part):
                            at = at + 1 if part is None else part
                            for i, cells in enumerate(lines):
                                rows.append((file, table, at, i, cells))
                                if len(rows) >= 2_000:
                                    yield _raw(rows)
                                    rows = []
                            if table.rpartition(":")[2] == containers.EXPORT:
                                rows.append((file, table, at, 0, []))
                except Exception as e:  # noqa: BLE001  whatever a broken file makes its reader raise
                    rows.append((file, ERROR, 0, 0, [type(e).__name__, str(e)[:500]]))
                yield _raw(rows)

    spread = found.mapInArrow(deal, "path string, k int, n int, content binary").repartition("path", "k")
    return spread.mapInArrow(run, RAW)


def _raw(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "table", "table_at", "row_idx", "cells"])


def read_large(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """S1 at scale: a splittable scan with a header and a declared schema of strings."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


# ---------------------------------------------------------------- headers


def norm_header(x: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", clean_cell(x).lower().replace("ё", "е"))
    return " ".join(re.sub("[^0-9a-zа-я]+", " ", plain).split())


def find_header(rows: list[list[str]], markers: list[str] = (), lookahead: int = LOOKAHEAD) -> int | None:
    """Of the first rows the one with most markers, then the largest share of words; the first of equals."""
    best, at = None, None
    wanted = [norm_header(m) for m in markers]
    for i, row in enumerate(rows[:lookahead]):
        full = [c for c in row if c]
        if len(full) < 2:
            continue
        joined = [norm_header(c) for c in full]
        hits = sum(any(m in c for c in joined) for m in wanted)
        words = sum(not re.fullmatch(r"[\d\s.,]*", c) for c in full) / len(full)
        if (best is None or (hits, words) > best) and (hits >= max(1, -(-len(wanted) // 2)) if wanted else words >= 0.75):
            best, at = (hits, words), i
        if wanted and hits == len(wanted):
            break
    return at


def dedupe(header: list[str]) -> list[str]:
    """X, x__1, ...; blanks are col."""
    names = [name or "col" for name in header]
    earlier = [names[:i].count(name) for i, name in enumerate(names)]
    return [f"{name}__{n}" if n else name for name, n in zip(names, earlier)]


def map_columns(header: list[str], aliases: dict[str, list[str]]) -> dict[str, int]:
    """Fields to columns, one to one, the best fits first: equal, beginning, part; then the longer alias, then the order of the aliases."""
    def fit(alias: str, head: str) -> tuple[int, int]:
        """How well an alias fits, and its length."""
        return (head == alias) + head.startswith(alias) + (alias in head), len(alias)

    spelled = {field: [a for a in map(norm_header, names) if a] for field, names in aliases.items()}
    heads = dict(enumerate(map(norm_header, header)))
    out: dict[str, int] = {}
    while spelled and heads:  # the best pair of what is left
        best = {(field, i): max(fit(a, h) for a in names) for field, names in spelled.items() if names for i, h in heads.items()}
        if not best:
            break
        field, i = max(best, key=best.get)
        if not best[field, i][0]:
            break
        out[field] = i
        del spelled[field], heads[i]
    return out


def load_aliases(path: str) -> dict[str, list[str]]:
    with open(path, encoding="utf-8") as f:
        return {k: v for k, v in json.load(f).items() if not k.startswith("_")}


def records(tables: DataFrame, columns: dict[str, int], header_at: int, most: int | None = None) -> DataFrame:
    """Named fields of the rows below the header, of the first `most` of each table if that is given."""
    upto = F.lit(True) if most is None else F.col("row_idx") <= header_at + most
    return tables.where((F.col("row_idx") > header_at) & upto).select("file", "table", "row_idx", *(F.get("cells", F.lit(i)).alias(k) for k, i in columns.items()))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list, in lower case, without comments and blanks."""
    return spark.read.text(path).select(F.lower(F.trim(F.split("value", "#")[0])).alias("word")).where("word <> ''").distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """K5: semicolons and a header, from a fixed schema."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def csv_bytes(df: DataFrame) -> bytes:
    """K5 at the edge: one table of a bounded query, with the mark that spreadsheets look for."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\r\n")
    writer.writerow(df.columns)
    writer.writerows(["" if x is None else x for x in row] for row in df.toLocalIterator())
    return codecs.BOM_UTF8 + out.getvalue().encode()
