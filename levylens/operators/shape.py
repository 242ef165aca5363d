"""Reshaping and ordered scans of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivot_codes(rows: DataFrame, ids: list[str]) -> DataFrame:
    """code_ul and code_fl as rows with their payer; blank codes go."""
    out = rows.select(*ids, F.expr("stack(2, 'ul', code_ul, col_ul, 'fl', code_fl, col_fl) AS (payer, row_code, col_index)"))
    return out.where("coalesce(row_code, '') <> ''")


def fill_down(rows: DataFrame, sheet: list[str], order: list[str], column: str, reset: str | None = None) -> DataFrame:
    """The last value above, within a sheet, and not from above a row that resets."""
    w = Window.partitionBy(*sheet).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if reset:
        rows = rows.withColumn("run_", F.sum(F.col(reset).cast("int")).over(w))
        w = Window.partitionBy(*sheet, "run_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w)).drop("run_")


def first_flag(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Whether a row is its section's first."""
    return rows.withColumn("is_first", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1).cast("int"))


def break_flag(rows: DataFrame, order: list[str], column: str, by: list[str]) -> DataFrame:
    """Whether a row's value differs from the one before."""
    return rows.withColumn("is_break", (~F.col(column).eqNullSafe(F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))).cast("int"))


def suffix_collisions(rows: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """Slugs with several names get --2, --3 in the order in which the names first come."""
    first = rows.groupBy(*by, name).agg(F.min(order).alias("at_"))
    n = F.dense_rank().over(Window.partitionBy(*by).orderBy("at_"))
    return rows.join(first.withColumn("k_", n), [*by, name]).withColumn(by[-1], F.when(F.col("k_") > 1, F.concat(by[-1], F.lit("--"), F.col("k_"))).otherwise(F.col(by[-1]))).drop("k_", "at_")


def wide_for_export(form: DataFrame, by: list[str]) -> DataFrame:
    """Value, mean and rank of each payer side by side."""
    return form.groupBy(*by).pivot("payer", ["ul", "fl", "total"]).agg(*(F.first(c).alias(c) for c in ("value", "avg", "rank")))


def width_histogram(cells: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent row widths."""
    return cells.groupBy(F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(most)


def widest_row(cells: DataFrame) -> DataFrame:
    """The first of the widest rows of each table."""
    return cells.groupBy("file", "table").agg(F.max_by(F.struct("row_idx", "cells"), F.struct(F.size("cells"), -F.col("row_idx"))).alias("row")).select("file", "table", "row.*")


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """U4: each value at its first place."""
    return rows.groupBy(*by, value).agg(F.min(order).alias(order))
