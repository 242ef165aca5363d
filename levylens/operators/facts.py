"""Form facts: totals, statistics over regions, ranks, form table, series, ranking, profile.

fact: year, region_code, tax_code, indicator_id, payer, value. region: code, name, federal_district,
kind. Region, tax and indicator tables are dimensions; Spark broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["year", "region_code", "tax_code", "indicator_id"]
RF = "00"


def round4(c: Column) -> Column:
    return F.round(c, 4)


def payer_totals(fact: DataFrame) -> DataFrame:
    """A4: ul and fl as they are and their sum as total; earlier totals do not count. The facts are computed once: a key has a row a payer, so its rows and its sum fit in one."""
    own = fact.where(F.col("payer").isin("ul", "fl"))
    summed = own.groupBy(*KEY).agg(F.collect_list(F.struct("payer", "value")).alias("own"), F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("sum"))
    total = F.struct(F.lit("total").alias("payer"), F.col("sum").alias("value"))
    rows = F.when(F.col("sum").isNotNull(), F.array_append("own", total)).otherwise(F.col("own"))
    return summed.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.payer", "r.value")


def of_subjects(fact: DataFrame, region: DataFrame) -> DataFrame:
    """Facts of subjects that have a value."""
    return fact.where("value IS NOT NULL").join(region.where("kind = 'subject'").select(F.col("code").alias("region_code"), F.col("name").alias("region_name")), "region_code")


def subject_stats(fact: DataFrame, region: DataFrame, by: list[str]) -> DataFrame:
    """A1, A2: mean, exact median, least, greatest, number and the values themselves (at most one a region) by key."""
    return of_subjects(fact, region).groupBy(*by).agg(
        F.avg("value").alias("avg"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"), F.collect_list("value").alias("values")
    )


def ranked(points: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Each value beside the statistics of its key, its ratio to the mean and its rank among the subjects, which it need not be one of."""
    above = F.size(F.filter("values", lambda v: v > F.col("value")))
    return points.join(stats, by, "left").withColumn("ratio", F.try_divide("value", "avg")).withColumn("rank", F.when(F.col("value").isNotNull() & F.col("values").isNotNull(), above + 1)).drop("values")


def form_table(fact: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, year: int, region_code: str) -> DataFrame:
    """One row an indicator, the payers side by side; rows without any value are left out."""
    slice_ = payer_totals(fact.where((F.col("tax_code") == tax) & (F.col("year") == year)))
    by = ["indicator_id", "payer"]
    rows = ranked(slice_.where(F.col("region_code") == region_code).select(*by, "value"), subject_stats(slice_, region, by), by)
    wide = rows.groupBy("indicator_id").pivot("payer", ["ul", "fl", "total"]).agg(F.first("value").alias("value"), round4(F.first("avg")).alias("avg"), F.first("rank").alias("rank"))
    kept = wide.where("coalesce(ul_value, fl_value, total_value) IS NOT NULL")
    return indicator.select(F.col("id").alias("indicator_id"), "section", "name", "unit", "sort_order").join(kept, "indicator_id")


def series(fact: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, region_code: str, indicators: list[int], payer: str = "total", year_from: int = 0, year_to: int = 9999) -> DataFrame:
    """A dense grid of indicators by years, own and subjects', with statistics where there are any."""
    ids = indicators or [-1]
    slice_ = payer_totals(fact.where((F.col("tax_code") == tax) & F.col("indicator_id").isin(ids) & F.col("year").between(year_from, year_to))).where(F.col("payer") == payer)
    by = ["indicator_id", "year"]
    own, stats = slice_.where(F.col("region_code") == region_code).select(*by, "value"), subject_stats(slice_, region, by)
    years = own.select("year").union(stats.select("year")).distinct()
    grid = indicator.where(F.col("id").isin(ids)).select(F.col("id").alias("indicator_id"), "name").crossJoin(F.broadcast(years))  # both sides are dimensions: listed ids, and years
    rows = ranked(grid.join(own, by, "left"), stats, by)
    none = (F.col("avg") == 0) | F.col("avg").isNull()
    return rows.select(*by, "name", "value", round4(F.col("avg")).alias("avg"), round4(F.col("median")).alias("median"), round4(F.when(~none, F.col("ratio"))).alias("ratio"), F.when(~none, F.col("rank")).alias("rank"), F.coalesce("n", F.lit(0)).alias("n"))


def ranking(fact: DataFrame, region: DataFrame, tax: str, year: int, indicator: int, payer: str = "total", limit: int = 100) -> DataFrame:
    """The subjects with the largest values."""
    slice_ = payer_totals(fact.where((F.col("tax_code") == tax) & (F.col("year") == year) & (F.col("indicator_id") == indicator))).where(F.col("payer") == payer)
    return of_subjects(slice_, region).select("region_code", "region_name", "value").orderBy(F.desc("value"), "region_code").limit(limit)


def structure_share(rows: DataFrame, by: list[str]) -> DataFrame:
    """Percent of the sum of the listed values; null counts as 0."""
    value = F.coalesce("value", F.lit(0.0))
    return rows.withColumn("share", round4(F.try_divide(value * 100, F.sum(value).over(Window.partitionBy(*by)))))
