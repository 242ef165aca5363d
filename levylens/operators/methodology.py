"""The methodology: which row codes of a year's form mean which indicator.

A flat map has a row for each indicator and year: tax_code, year, section, level, group, name, slug,
unit, code_ul, code_fl, col_ul, col_fl, sort_order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levylens.functions import text

from . import shape

MAP = "tax_code string, year int, section string, level int, group string, name string, slug string, unit string, code_ul string, code_fl string, col_ul int, col_fl int, sort_order int"
#: What a row that its newest form lacks is put behind by.
OLD = 10_000


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A flat map; blanks are null, codes keep their zeros."""
    return spark.read.option("header", True).option("sep", ";").option("nullValue", "").schema(MAP).csv(path)


def write_map(rows: DataFrame, path: str) -> None:
    """K7."""
    rows.select(*(c.split()[0] for c in MAP.split(", "))).orderBy("tax_code", "year", "sort_order").coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)  # a dimension


#: How the columns of a sheet are headed (a header begins so), and the units of the form's sections.
HEADED = {
    "name": ["показатель"],
    "code_ul": ["код строки для юридических лиц", "код строки юл", "код юл"],
    "code_fl": ["код строки для физических лиц", "код строки фл", "код фл"],
    "year": ["год формы", "год"],
    "col_ul": ["столбец для юридических лиц", "графа для юридических лиц"],
    "col_fl": ["столбец для физических лиц", "графа для физических лиц"],
}
SECTION_UNITS = {"1": "единиц", "2": "единиц", "3": "единиц", "4": "тыс. руб.", "5": "тыс. руб."}
SLUG = 180


def row_code(cell: Column) -> Column:
    """a row code as a cell has it, without what a workbook adds to a number; blank if there is none."""
    return F.trim(F.substring_index(text.clean(cell), ".", 1))


def unit_of(name: Column, section: Column) -> Column:
    """the unit that a name states, else its section's."""
    low = F.lower(name)
    known = F.create_map(*(F.lit(x) for pair in SECTION_UNITS.items() for x in pair))
    return F.when(low.contains("тыс. руб") | low.contains("тыс.руб"), "тыс. руб.").when(low.contains("единиц"), "единиц").otherwise(F.coalesce(F.try_element_at(known, section), F.lit("")))


def headers(rows: DataFrame, sheet: list[str]) -> DataFrame:
    """For each sheet the first row that heads a name and a code: header_at, and at_<field>, the place of each field's column or null."""
    keys = F.transform("cells", text.norm_key)

    def place(aliases: list[str]) -> Column:
        begins = lambda c: F.exists(F.array(*(text.norm_key(F.lit(a)) for a in aliases)), lambda a: F.startswith(c, a))
        return F.nullif(F.array_position(F.transform("keys", begins), F.lit(True)), F.lit(0)).cast("int") - 1

    likely = rows.where(F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(HEADED["name"][0]))))
    placed = likely.select(*sheet, "row_idx", keys.alias("keys")).select(*sheet, "row_idx", *(place(a).alias(f"at_{f}") for f, a in HEADED.items()))
    heads = placed.where("at_name IS NOT NULL AND (at_code_ul IS NOT NULL OR at_code_fl IS NOT NULL)")
    fields = [f"at_{f}" for f in HEADED]
    return heads.groupBy(*sheet).agg(F.min_by(F.struct(F.col("row_idx").alias("header_at"), *fields), "row_idx").alias("h")).select(*sheet, "h.*")


def scan_workbook(rows: DataFrame, tax: str) -> DataFrame:
    """Rows of workbooks with a sheet a year (file, table, row_idx, cells, and table_at if there is one) to a flat map.

    A sheet is scanned in order. "1. Name" opens a section or, if the sheet has had that section, a group;
    a code that ends in 0 closes the group; other rows belong to an open one. Levels: 0 a section's first
    row, 2 a row that opens a group, 3 a row of a group, 1 others. A row's year is its cell's, else its
    sheet's ("2019 - form"); rows without a name, a code or a year are passed over. A slug has the group
    only if a section's name stands in several groups in any year; within a year the rows whose name
    differs from that of a slug's first row get --2, --3 and so on.

    Each state is the last of its events above the row, so the scan is windows over the sheet.
    """
    sheet = ["file", *(c for c in ("table_at", "table") if c in rows.columns)]
    head = headers(rows, sheet)
    cell = lambda f: F.coalesce(text.clean(F.get("cells", F.col(f"at_{f}"))), F.lit(""))
    col = lambda f: F.nullif(cell(f), F.lit("")).try_cast("double").cast("int")
    flat = rows.join(head, sheet).where(F.col("row_idx") > F.col("header_at")).select(
        *sheet, "row_idx", cell("name").alias("said"), row_code(cell("code_ul")).alias("code_ul"), row_code(cell("code_fl")).alias("code_fl"),
        F.coalesce(text.parse_year(cell("year")), F.nullif(F.regexp_extract(text.clean(F.col("table")), r"^(\d{4})\s*[-_ ]\s*.+$", 1), F.lit("")).cast("int")).alias("year"), col("col_ul").alias("col_ul"), col("col_fl").alias("col_fl"),
    )
    flat = flat.where("said <> '' AND (code_ul <> '' OR code_fl <> '') AND year IS NOT NULL")
    number = F.regexp_extract("said", r"(?s)^(\d+)\s*\.\s*(.+)$", 1)
    flat = flat.withColumn("number", F.nullif(number, F.lit(""))).withColumn("name", F.when(F.col("number").isNotNull(), text.clean(F.regexp_extract("said", r"(?s)^(\d+)\s*\.\s*(.+)$", 2))).otherwise(F.col("said")))
    flat = shape.first_flag(flat, [*sheet, "number"], ["row_idx"])
    upto = Window.partitionBy(*sheet).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    round_code = F.endswith(F.coalesce(F.nullif("code_ul", F.lit("")), "code_fl"), F.lit("0"))
    opens, starts = F.col("number").isNotNull(), F.col("number").isNotNull() & (F.col("is_first") == 1)
    event = F.when(starts, "").when(opens, F.col("name")).when(round_code, "")
    seen = flat.withColumn("event", event).select("*", F.coalesce(F.last("number", ignorenulls=True).over(upto), F.lit("")).alias("section"), F.coalesce(F.last("event", ignorenulls=True).over(upto), F.lit("")).alias("open"), F.row_number().over(Window.partitionBy(*sheet).orderBy("row_idx")).cast("int").alias("sort_order"))
    level = F.when(starts, 0).when(opens, 2).when(F.col("event").isNotNull() | (F.col("open") == ""), 1).otherwise(3)
    placed = seen.withColumn("level", level).withColumn("group", F.when(F.col("level") == 3, F.col("open")).otherwise("")).withColumn("key", text.norm_key(F.col("name"))).withColumn("group_key", text.norm_key(F.col("group")))
    several = placed.groupBy("section", "key").agg((F.min("group_key") != F.max("group_key")).alias("several"))  # a row for each name
    slug = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    base = F.concat(F.when(F.col("several") & (F.col("group") != ""), F.concat(slug(F.col("group_key")), F.lit("--"))).otherwise(""), slug(F.col("key")))
    named = placed.join(several, ["section", "key"]).withColumn("base", F.substring(F.concat(F.lit("s"), F.coalesce(F.nullif("section", F.lit("")), F.lit("0")), F.lit("--"), base), 1, SLUG))
    order = [*sheet[1:], "file", "row_idx"]
    same = Window.partitionBy("year", "base")
    first = F.first("name").over(same.orderBy(*order))
    other = named.withColumn("other", (F.col("name") != first).cast("int"))
    late = F.sum("other").over(same.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    suffixed = other.withColumn("slug", F.when(F.col("other") == 1, F.concat("base", F.lit("--"), late + 1)).otherwise(F.col("base")))
    own = lambda c, name: F.nullif(c, F.lit("")).alias(name)  # noqa: E731  blanks are null, as read_map() has them
    return suffixed.select(F.lit(tax).alias("tax_code"), "year", own(F.col("section"), "section"), F.col("level").cast("int").alias("level"), own(F.col("group"), "group"), "name", "slug", own(unit_of(F.col("name"), F.col("section")), "unit"), own(F.col("code_ul"), "code_ul"), own(F.col("code_fl"), "code_fl"), "col_ul", "col_fl", "sort_order")


def indicators(rows: DataFrame) -> DataFrame:
    """An indicator for each slug as its latest form has it, its group before its name; one that the newest form lacks goes behind."""
    newest = rows.groupBy("tax_code").agg(F.max("year").alias("newest"))  # a row a tax
    latest = rows.join(newest, "tax_code").groupBy("tax_code", "slug").agg(F.max_by(F.struct("section", "group", "name", "unit", "level", "sort_order", "year", "newest"), F.struct("year", "sort_order", "name")).alias("r")).select("tax_code", "slug", "r.*")
    name = F.when(F.coalesce("group", F.lit("")) != "", F.concat("group", F.lit(": "), "name")).otherwise(F.col("name"))
    place = F.col("sort_order") + F.when(F.col("year") < F.col("newest"), OLD).otherwise(0)
    return latest.select("tax_code", "slug", name.alias("name"), "section", "unit", F.coalesce("level", F.lit(0)).alias("level"), place.alias("sort_order"))


def codes(rows: DataFrame, indicator: DataFrame) -> DataFrame:
    """tax_code, payer, row_code, year, col_index and indicator_id of all codes; of two rows with a code the later."""
    long = shape.unpivot_codes(rows, ["tax_code", "year", "slug", "sort_order"])
    last = long.groupBy("tax_code", "year", "payer", "row_code").agg(F.max_by(F.struct("slug", "col_index"), F.struct("sort_order", "slug")).alias("r")).select("tax_code", "year", "payer", "row_code", "r.*")
    return last.join(indicator.select("tax_code", "slug", F.col("id").alias("indicator_id")), ["tax_code", "slug"]).drop("slug")
