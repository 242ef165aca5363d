"""What a source looks like, and made-up domain data for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens.operators import resolve

from levylens.functions import text


def header_candidates(rows: DataFrame, aliases: DataFrame, most: int = 5, lookahead: int = 40) -> DataFrame:
    """The first rows of each table that bind most fields; aliases: field, alias. A field is bound by a cell that holds one of its aliases."""
    top = rows.where(F.col("row_idx") < lookahead).select("file", "table", "row_idx", F.explode("cells").alias("cell")).where("cell <> ''")
    named = aliases.select("field", text.norm_key(F.col("alias")).alias("alias")).where("alias <> ''")
    keys = top.select("cell").distinct().withColumn("key", text.norm_key(F.col("cell")))
    bound = keys.join(named, F.contains("key", F.col("alias"))).select("cell", "field").distinct()
    score = top.join(bound, "cell").groupBy("file", "table", "row_idx").agg(F.countDistinct("field").alias("fields"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("fields")).alias("less"), "row_idx"))), 1, most)  # at most `lookahead` a table
    return score.groupBy("file", "table").agg(best.alias("best")).select("file", "table", F.posexplode("best").alias("place", "b")).select("file", "table", "place", F.col("b.row_idx").alias("row_idx"), (-F.col("b.less")).alias("fields"))


def describe(rows: DataFrame, most: int = 8) -> DataFrame:
    """Rows, greatest width and the first rows of each table."""
    sizes = rows.groupBy("file", "table").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("width"))
    first = rows.where(F.col("row_idx") < most).groupBy("file", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("preview"))
    return sizes.join(first, ["file", "table"], "left")


def report(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """A line of text for each table."""
    best = header_candidates(rows, aliases, 1).select("file", "table", F.col("row_idx").alias("header_at"), "fields")
    line = F.concat_ws(" ", "file", F.concat(F.lit("["), "table", F.lit("]")), F.concat("n_rows", F.lit(" rows,")), F.concat(F.lit("up to "), "width", F.lit(" cells;")), F.concat(F.lit("header "), F.coalesce(F.col("header_at").cast("string"), F.lit("none")), F.lit(", fields "), F.coalesce(F.col("fields").cast("string"), F.lit("0"))))
    return describe(rows).join(best, ["file", "table"], "left").select("file", "table", line.alias("line"))


def made_up(spark: SparkSession, region: DataFrame, indicator: DataFrame, year_from: int = 2015, year_to: int = 2024, seed: int = 20240101, tax: str = "tn") -> DataFrame:
    """Facts of all subjects, indicators, years and payers. A value depends on its key and the seed alone, so any number of partitions gives the same."""
    unit = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_003)) / 1_000_003.0
    keys = region.where("kind = 'subject'").select(F.col("code").alias("region_code")).crossJoin(resolve.dimension(indicator.select(F.col("id").alias("indicator_id"))))  # dimensions, and years below
    rows = keys.withColumn("year", F.explode(F.sequence(F.lit(year_from), F.lit(year_to)))).withColumn("payer", F.explode(F.array(F.lit("ul"), F.lit("fl"))))
    size = F.exp(F.lit(4.0) + 4 * unit("region_code")) * (1 + 9 * unit("indicator_id"))
    trend = 1 + 0.04 * (F.col("year") - year_from) + 0.2 * (unit("region_code", "indicator_id", "year", "payer") - 0.5)
    return rows.select("year", "region_code", F.lit(tax).alias("tax_code"), "indicator_id", "payer", F.round(size * trend, 2).alias("value"), F.lit("made up").alias("source_file"))
