"""Import control: what a file is, which files are new, and one run over a folder or a stream of files."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from levylens import session
from levylens.operators import resolve
from levylens.sources import containers, delimited, export

from . import ingest

#: A form is a table of rows of at most so many cells, with so many known codes in one column, within its first rows.
WIDTH, CODES, ROWS = 12, 5, 3000
#: A header is looked for in so many first rows; so many fields make a table one of norms if it names a region.
HEADER_ROWS, FIELDS = 5000, 5
#: Suffixes of files that are looked at; others are passed over.
SUFFIXES = containers.TABLES + containers.PACKED
LEDGER = "path string, kind string, size long, mtime double"
HEADER = "file string, table string, header_at int, columns map<string,int>, fields array<string>"
OUTCOME = "file string, kind string, tax string, state string, note string"

Load = Callable[[DataFrame], None]


def _table(rows: DataFrame) -> list[str]:
    return [c for c in ("table_at", "table") if c in rows.columns]


def bind_headers(rows: DataFrame, aliases: dict[str, list[str]], markers: list[str] = (), most: int = HEADER_ROWS) -> DataFrame:
    """S11, S12, S14 for all files at once: file, table, header_at, columns (fields to places) and fields of every table whose first rows hold a header."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_idx")
        cells = [list(c) for c in frame["cells"]]
        at = delimited.find_header(cells, list(markers), most)
        columns = delimited.map_columns(cells[at], aliases) if at is not None else {}
        first = frame.iloc[0]
        return pd.DataFrame([(first["file"], first["table"], int(frame["row_idx"].iloc[at]), columns, sorted(columns))] if columns else [], columns=["file", "table", "header_at", "columns", "fields"])

    session.bind(rows.sparkSession)
    top = rows.where(F.col("row_idx") < most).select("file", "table", "row_idx", "cells")
    return top.groupBy("file", "table").applyInPandas(run, HEADER)  # a group is at most `most` rows


def named_records(rows: DataFrame, headers: DataFrame, fields: list[str], most: int | None = None) -> DataFrame:
    """Named fields of the rows below each table's own header, of the first `most` of each table if that is given; a field that a table lacks is empty."""
    found = rows.join(headers.select("file", "table", "header_at", "columns"), ["file", "table"])
    found = found.where((F.col("row_idx") > F.col("header_at")) & (F.lit(True) if most is None else F.col("row_idx") <= F.col("header_at") + most))
    cell = lambda f: F.coalesce(F.get("cells", F.try_element_at("columns", F.lit(f))), F.lit(""))
    return found.select("file", "table", "row_idx", *(cell(f).alias(f) for f in fields))


def classify(rows: DataFrame, codes: DataFrame, headers: DataFrame) -> DataFrame:
    """File, kind and tax. An export is one by its records. A file whose header binds a region and a norm, or a region and five fields (headers: file, fields), holds norms. One whose first table has five known row codes of a tax in one column is a form of that tax, of several the least. Else it is unknown."""
    has = lambda *names: F.arrays_overlap("fields", F.array(*map(F.lit, names)))
    places = ("region_code", "region_name", "oktmo")
    exports = rows.where(F.element_at(F.split("table", ":"), -1) == containers.EXPORT).select("file").distinct().withColumn("export_", F.lit("rates-xml"))
    norms = headers.where(has(*places) & (has("rate_value", "benefit_category", "benefit_kind", "benefit_size") | (F.size("fields") >= FIELDS))).select("file").distinct().withColumn("kind_", F.lit("rates"))
    first = rows.groupBy("file").agg(F.min(F.struct(*_table(rows))).alias("first_"))
    top = rows.withColumn("first_", F.struct(*_table(rows))).join(first, ["file", "first_"]).where((F.col("row_idx") < ROWS) & (F.size("cells") <= WIDTH))
    tax = F.col("tax_code") if "tax_code" in codes.columns else F.lit(None).cast("string")
    known = codes.select(tax.alias("tax"), resolve.bare_code(F.col("row_code")).alias("bare")).distinct()
    cells = top.select("file", F.posexplode("cells").alias("pos", "cell")).where(F.regexp_like(F.trim("cell"), F.lit(r"^\d{3,4}(\.0)?$"))).withColumn("bare", resolve.bare_code(F.col("cell")))
    held = cells.join(resolve.dimension(known), "bare").groupBy("file", "pos", "tax").agg(F.countDistinct("bare").alias("n")).where(F.col("n") >= CODES)
    forms = held.groupBy("file").agg(F.min("tax").alias("tax")).withColumn("form_", F.lit("forms"))
    out = rows.select("file").distinct().join(exports, "file", "left").join(norms, "file", "left").join(forms, "file", "left")
    kind = F.coalesce("export_", "kind_", "form_", F.lit("unknown"))
    return out.select("file", kind.alias("kind"), F.when(kind == "forms", F.col("tax")).alias("tax"))


def exports_of(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and dictionary (with file) of the exports among raw rows: by blocks, or, inside zip archives, as streams of their members."""
    paths = sorted(r.file for r in rows.select("file").distinct().toLocalIterator())
    plain, packed = ([p for p in paths if p.lower().endswith(".zip") == z] for z in (False, True))
    found = [(export.read_export(spark, plain), export.read_list(spark, plain, by_file=True))] * bool(plain) + [export.read_packed(spark, packed)] * bool(packed)
    both = [found[0][k] if len(found) == 1 else found[0][k].unionByName(found[1][k]) for k in (0, 1)]
    return both[0], both[1]


@dataclass
class Run:
    """What a run has done: a row for each new file with its kind, tax, state (loaded, failed, unknown) and note, and the number of raw rows that were read."""

    outcomes: DataFrame
    rows_read: int
    kinds: set[str]

    @property
    def loaded(self) -> dict[str, list[str]]:
        """Files by kind, for a look at small runs."""
        out: dict[str, list[str]] = {}
        for r in self.outcomes.where("state = 'loaded'").orderBy("file").toLocalIterator():
            out.setdefault(r.kind, []).append(r.file)
        return out

    @property
    def failed(self) -> dict[str, str]:
        return {r.file: r.note for r in self.outcomes.where("state = 'failed'").toLocalIterator()}

    @property
    def taxes(self) -> list[str]:
        """Taxes of the forms that were loaded."""
        return sorted(r.tax for r in self.outcomes.where("state = 'loaded' AND tax IS NOT NULL").select("tax").distinct().collect())


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def _loaded(load: Load, rows: DataFrame, files: DataFrame) -> list[tuple[str, str]]:
    """Loads the rows of some files in one plan; if that fails, each file on its own, so one does not cost the others. Files that failed, with the reason."""
    try:
        load(rows.join(files, "file", "left_semi"))
        return []
    except Exception as whole:  # noqa: BLE001  whatever a loader raises
        listed = [r.file for r in files.toLocalIterator()]
        if len(listed) == 1:
            return [(listed[0], _why(whole))]
    bad = []
    for file in listed:
        try:
            load(rows.where(F.col("file") == file))
        except Exception as e:  # noqa: BLE001
            bad.append((file, _why(e)))
    return bad


def load_files(spark: SparkSession, new: DataFrame, kinds: Callable[[DataFrame], DataFrame], loaders: dict[str, Load], after: Callable[[set[str]], None] | None = None, totals: Callable[[list[str]], None] | None = None) -> Run:
    """I4: files (path) by kind to their loaders, each kind in one plan over all its files; then `totals` with the taxes of the loaded forms and `after` with the kinds that were loaded.

    Only these files are read, and each once: their raw rows are written below the shared folder. Loaders
    replace what they have of a file, as one whose plan over all files failed gets each file again.
    """
    paths = [r.path for r in new.select("path").orderBy("path").toLocalIterator()]
    if not paths:
        return Run(spark.createDataFrame([], OUTCOME), 0, set())
    seen = Observation()
    raw = delimited.read_tables(spark, paths)
    rows = session.kept(raw.observe(seen, F.count_if(F.col("table") != delimited.ERROR).alias("n")))
    bad = rows.where(F.col("table") == delimited.ERROR).groupBy("file").agg(F.min(F.concat_ws(": ", "cells")).alias("note"))
    bad = session.kept(bad.unionByName(new.select(F.col("path").alias("file")).join(rows.select("file").distinct(), "file", "left_anti").withColumn("note", F.lit("no tables"))))
    good = rows.where(F.col("table") != delimited.ERROR).join(bad, "file", "left_anti")
    kind = kinds(good)
    kind = session.kept(kind.select("file", "kind", (F.col("tax") if "tax" in kind.columns else F.lit(None).cast("string")).alias("tax")))
    lost: list[tuple[str, str]] = []
    present = {r.kind for r in kind.select("kind").distinct().collect()}
    for name in sorted(loaders.keys() & present):
        lost += _loaded(loaders[name], good, kind.where(F.col("kind") == name).select("file"))
    broken = spark.createDataFrame(lost, "file string, lost string")
    state = F.when(F.col("lost").isNotNull(), "failed").when(F.col("kind").isin(*loaders), "loaded").otherwise("unknown")
    outcomes = kind.join(broken, "file", "left").select("file", "kind", "tax", state.alias("state"), F.col("lost").alias("note"))
    outcomes = outcomes.unionByName(bad.select("file", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("tax"), F.when(F.col("note") == "no tables", "unknown").otherwise("failed").alias("state"), "note"))
    done = Run(session.kept(outcomes), seen.get["n"], set())
    done.kinds = {r.kind for r in done.outcomes.where("state = 'loaded'").select("kind").distinct().collect()}
    if totals and (taxes := done.taxes):
        totals(taxes)
    if after and done.kinds:
        after(done.kinds)
    return done


def _ledger_rows(new: DataFrame, done: Run) -> DataFrame:
    read = new.join(done.outcomes.where("state = 'loaded'").select(F.col("file").alias("path"), "kind"), "path")
    return read.select("path", "kind", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def run(spark: SparkSession, folder: str, ledger: DataFrame, kinds: Callable[[DataFrame], DataFrame], loaders: dict[str, Load], after: Callable[[set[str]], None] | None = None, most: int | None = None, totals: Callable[[list[str]], None] | None = None) -> tuple[Run, DataFrame]:
    """Loads the files below folder that ledger does not have, `most` of them if given, and returns the new ledger too.

    The ledger is asked before any content is read. Files that failed or that nothing is known of do not
    go into it, so the next run tries them again. An empty ledger loads everything anew.
    """
    found = delimited.files(spark, folder, suffixes=SUFFIXES).select("path", "length", "modificationTime")
    new = ingest.unseen(found, ledger)
    new = session.kept(new.orderBy("path").limit(most) if most else new)
    done = load_files(spark, new, kinds, loaders, after, totals)
    read = _ledger_rows(new, done)
    return done, ledger.join(read, "path", "left_anti").unionByName(read)


def stream(spark: SparkSession, folder: str, state: str, kinds: Callable[[DataFrame], DataFrame], loaders: dict[str, Load], after: Callable[[set[str]], None] | None = None, totals: Callable[[list[str]], None] | None = None, files_a_batch: int = 1000) -> None:
    """I1, I4, I5 as a stream of files: all that have come, batch by batch, then an end.

    Outcomes and ledger are tables below state, a partition a batch: a batch that is run again replaces
    its own, and files that another batch has loaded as they are stay out before their content is read.
    """

    def work(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        place = f"batch={number}"
        ledger = own.read.schema(LEDGER + ", batch long").parquet(f"{state}/ledger").where(F.col("batch") != number).drop("batch") if _there(own, f"{state}/ledger") else own.createDataFrame([], LEDGER)
        new = session.kept(ingest.unseen(batch.select("path", "length", "modificationTime"), ledger))
        done = load_files(own, new, kinds, loaders, after, totals)
        done.outcomes.write.mode("overwrite").parquet(f"{state}/outcomes/{place}")
        _ledger_rows(new, done).write.mode("overwrite").parquet(f"{state}/ledger/{place}")

    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    found = found.where(~name.startswith(".") & ~name.startswith("~$") & F.regexp_like(F.lower(name), F.lit(rf"\.({'|'.join(SUFFIXES)})$")))
    found.writeStream.foreachBatch(work).option("checkpointLocation", os.path.join(state, "checkpoint")).trigger(availableNow=True).start().awaitTermination()


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema(LEDGER).parquet(path)
        return True
    except AnalysisException:
        return False


def outcomes(spark: SparkSession, state: str) -> DataFrame:
    """The outcomes of a stream's batches."""
    return spark.read.schema(OUTCOME + ", batch long").parquet(f"{state}/outcomes")
