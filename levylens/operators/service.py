"""The queries that a portal page asks for, put together from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog, facts, norms

LOAD_LOG = "loaded_at timestamp, kind string, source_file string, rows_read long, rows_saved long, details string"


def taxes(tax: DataFrame) -> DataFrame:
    """O1."""
    return tax.orderBy("sort_order", "name", "code")


def meta(**tables: DataFrame) -> DataFrame:
    """Rows of each table. One small row a table, and a scan without columns."""
    counts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def last_loads(log: DataFrame, n: int = 10) -> DataFrame:
    """The latest loads, the newest first."""
    return log.orderBy(F.desc("loaded_at"), F.desc("id")).limit(n)


def load_entry(spark, kind: str, source: str, rows_read: int, rows_saved: int, stats: dict | None = None) -> DataFrame:
    """One row for the log; statistics go as JSON."""
    entry = spark.range(1).select(F.current_timestamp().alias("loaded_at"), F.lit(kind).alias("kind"), F.lit(source).alias("source_file"), F.lit(rows_read).cast("long").alias("rows_read"), F.lit(rows_saved).cast("long").alias("rows_saved"))
    pairs = [F.lit(x) for k, v in (stats or {}).items() for x in (k, str(v))]
    return entry.withColumn("details", F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}"))


def region_name(rows: DataFrame, region: DataFrame, code: str = "region_code") -> DataFrame:
    """A region's name, its code where it has none."""
    return rows.join(region.select(F.col("code").alias(code), F.col("name").alias("region_name")), code, "left").withColumn("region_name", F.coalesce("region_name", code))


def regions_like(region: DataFrame, text: str = "", district: str | None = None) -> DataFrame:
    """Regions of a district whose name or code holds a text."""
    out = region.where(F.col("federal_district") == district) if district else region
    needle = text.strip().lower()
    return out.where(F.contains(F.lower(F.concat_ws(" ", "code", "name")), F.lit(needle))) if needle else out


def districts(region: DataFrame) -> DataFrame:
    """A18."""
    return region.where("coalesce(federal_district, '') <> ''").select("federal_district").distinct().orderBy("federal_district")


def key_rows(form: DataFrame, indicator: DataFrame) -> DataFrame:
    """P10: the rows of a form whose indicator stands at the top level."""
    return form.join(indicator.where("level = 0").select(F.col("id").alias("indicator_id")), "indicator_id", "left_semi")


def key_indicators(fact: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, year: int, region_code: str) -> DataFrame:
    """Q5: the form's rows of a region's key indicators, in the form's order."""
    return key_rows(facts.form_table(fact, region, indicator, tax, year, region_code), indicator).orderBy("section", "sort_order", "indicator_id")


def filled(form: DataFrame, name: str = "") -> DataFrame:
    """Rows with a total, whose name holds a text."""
    return form.where("total_value IS NOT NULL").where(F.contains(F.lower("name"), F.lit(name.strip().lower())))


def profile(fact: DataFrame, rate: DataFrame, benefit: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, year: int, region_code: str) -> DataFrame:
    """Q5: in one row the region, its rates, municipalities and benefits by payer in the year, the number of its key indicators, and the years of the tax."""
    of = lambda t: norms.select_norms(t, [], tax, region_code, year)
    counts = norms.profile_counts(of(rate), of(benefit)).crossJoin(norms.payer_counts(of(benefit)))
    keys = key_rows(facts.form_table(fact, region, indicator, tax, year, region_code), indicator).agg(F.count(F.lit(1)).alias("key_indicators"))
    years = catalog.years(fact, rate, benefit, tax).agg(F.array_sort(F.collect_list("year")).alias("years"))  # as many as there are years
    one = region_name(fact.sparkSession.range(1).select(F.lit(region_code).alias("region_code")), region)
    return one.crossJoin(counts).crossJoin(keys).crossJoin(years)  # all of one row


def flat_series(nested: DataFrame) -> DataFrame:
    """Series with their points in an array to a row a point."""
    return nested.select("indicator_id", "name", F.explode("points").alias("p")).select("indicator_id", "name", "p.*")


def nested_series(points: DataFrame) -> DataFrame:
    """Q7 at the edge: the points of each indicator by year, at most one a year."""
    point = F.struct("year", "value", "avg", "median", "ratio", "rank", "n")
    return points.groupBy("indicator_id", "name").agg(F.array_sort(F.collect_list(point)).alias("points"))


def as_json(rows: DataFrame) -> DataFrame:
    """K6: a JSON text for each row; what is null is left in."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def shown_number(value: Column) -> Column:
    """a number for reading: without decimals from 1,000 on, two at most below, a dash for none."""
    short = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    whole = F.format_number(value, 0)
    return F.coalesce(F.replace(F.when(F.abs(value) >= 1000, whole).otherwise(short), F.lit(","), F.lit(" ")), F.lit("—"))


def shortened(text: Column, most: int) -> Column:
    """a text cut to so many characters, with an ellipsis if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def with_flags(table: DataFrame) -> DataFrame:
    """Q16: a table of an older schema with the columns it lacks; flags come from the payer only if one was lacking."""
    flags = ["for_fl", "for_ul", "for_ip"]
    lacks = [c for c in flags if c not in table.columns]
    for c in lacks:
        table = table.withColumn(c, F.coalesce((F.col("payer") == c[4:]).cast("int"), F.lit(0)))
    if "object_name" in table.columns and "object_group" not in table.columns:
        table = table.withColumn("object_group", F.trim(F.substring_index("object_name", ":", 1)))
    return table
