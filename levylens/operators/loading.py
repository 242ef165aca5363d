"""Named records of norm files, records of exports and rows of form files, to the domain's tables.

Records are read once: they are written below the shared folder with what they say of region, tax and
payer, which automata of the dimensions find within each row. What remains, the learned prefixes and the
split into rates, benefits and misses, reads only columns of that. Misses come out beside the norms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levylens import session
from levylens.functions import russian, text

from . import resolve

FIELDS = [
    "region_code", "region_name", "oktmo", "mo_name", "tax_name", "period_year", "date_from", "date_to", "object_name", "rate_value", "rate_unit",
    "payer_text", "benefit_category", "benefit_kind", "benefit_size", "benefit_unit", "condition", "basis", "npa_name", "npa_number", "npa_date", "npa_authority",
]
COMMON = ["year", "year_from", "year_to", "region_code", "tax_code", "oktmo", "mo_name", "payer", "for_fl", "for_ul", "for_ip"]
ACT = ["npa_name", "npa_number", "npa_date", "npa_authority", "period_from", "period_to", "source_file"]
RATE = [*COMMON, "payer_text", "object_name", "object_group", "rate_value", "rate_text", "rate_unit", "condition", *ACT]
BENEFIT = [*COMMON, "category", "kind", "size_text", "size_value", "size_unit", "condition", "basis", *ACT]
#: A title is looked for in so many first rows of a table; a miss is kept to so many characters.
TITLE_ROWS, MISS_CHARS = 25, 80


@dataclass
class Loaded:
    """Rates, benefits, and misses (reason, value) of what was read, votes for prefixes with those of runs before, and the number of records."""

    rates: DataFrame
    benefits: DataFrame
    misses: DataFrame
    votes: DataFrame | None
    rows_read: int
    marked: tuple[DataFrame, DataFrame]  # rates and benefits, each row with whether it is its record's first


def observed(rows: DataFrame, write: Callable[[DataFrame], None], *more: Column) -> dict[str, int]:
    """write(rows), and the number of rows it wrote with further aggregates, counted while it does."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    return seen.get


def save(loaded: Loaded, rates: Callable[[DataFrame], None], benefits: Callable[[DataFrame], None], most: int = 20) -> dict:
    """Writes both by the given functions and returns what a log entry states: rows_read, rates, benefits, skipped (records that gave neither) and the first unmapped values.

    The counts are observed while the rows are written; the records are not read again.
    """
    one, two = (observed(rows, lambda x, write=write: write(x.drop("first")), F.count_if("first").alias("records")) for rows, write in zip(loaded.marked, (rates, benefits), strict=True))
    listed = loaded.misses.groupBy("reason").agg(F.slice(F.array_sort(F.collect_set("value")), 1, most).alias("v")).collect() if loaded.misses.limit(1).count() else []
    return {"rows_read": loaded.rows_read, "rates": one["n"], "benefits": two["n"], "skipped": loaded.rows_read - one["records"] - two["records"], "unmapped_regions": [], "unmapped_taxes": []} | {r.reason: r.v for r in listed}


def validity(period: Column, date_from: Column, date_to: Column, act_date: Column, default_year: int | None, this_year: int | None) -> list[Column]:
    """year, year_from and year_to. A year that is named fills both ends that no date gives; without one the first date's year, or the act's; an end over 51 years ahead is none."""
    named = text.parse_year(period)
    of = lambda c: F.substring(text.parse_date(c), 1, 4).cast("int")
    start = F.coalesce(of(date_from), named, of(act_date))
    end = F.coalesce(of(date_to), named)
    default = F.lit(default_year).cast("int")
    year = F.coalesce(named, start, default)
    return [year.alias("year"), F.coalesce(start, default).alias("year_from"), F.when(end <= (F.year(F.current_date()) if this_year is None else F.lit(this_year)) + text.FAR_YEARS, end).alias("year_to")]


def first_payer(columns: list[str]) -> Column:
    """Of columns that each hold a payer, the first that is not all."""
    return F.coalesce(*(F.nullif(c, F.lit("all")) for c in columns), F.lit("all"))


def payer_of(rows: DataFrame, columns: list[str], name: str = "payer") -> DataFrame:
    """F16 over several texts: the first that names a payer decides."""
    session.bind(rows.sparkSession)
    own = [f"payer{k}_" for k in range(len(columns))]
    said = rows.select("*", *(russian.payer(F.col(c)).alias(k) for c, k in zip(columns, own, strict=True)))
    return said.withColumn(name, first_payer(own)).drop(*own)


def _missed(rows: DataFrame, reason: str, value: Column) -> DataFrame:
    return rows.select(F.lit(reason).alias("reason"), F.substring(value, 1, MISS_CHARS).alias("value")).where("value <> ''")


def norms(records: DataFrame, region: DataFrame, alias: DataFrame, tax: str | None = None, default_year: int | None = None, this_year: int | None = None, source: Column | None = None, votes: DataFrame | None = None) -> Loaded:
    """Records with some of FIELDS to rates and benefits. A record gives a rate if it names an object or a rate, a benefit if it has a category, a kind or a size, and nothing if its region or tax stays unknown.

    votes: what earlier runs have learned of municipal codes' beginnings, as Loaded has it. this_year is by default the present one.
    """
    named = lambda c: c if c != "region_code" else "raw_code"
    rows = session.spread(records).select(*(text.clean(F.col(c)).alias(named(c)) if c in records.columns else F.lit("").alias(named(c)) for c in FIELDS), (source if source is not None else F.lit("")).alias("source_file"))
    rows = resolve.placed(rows, region, "raw_code", "region_name")
    rows = rows.withColumn("tax_code", F.lit(tax)) if tax else resolve.by_alias(rows, alias, "tax_name")
    spoken = ["payer_text", "object_name", "benefit_category", "benefit_kind"]
    rows = rows.select("*", *(russian.payer(F.col(c)).alias(f"{c}_payer") for c in spoken))
    seen = Observation()
    session.bind(records.sparkSession)
    rows = session.kept(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    votes = resolve.votes_of(rows, "oktmo", "region_code", votes)
    rows = resolve.by_prefix_vote(rows, "oktmo", "region_code", votes=votes)
    no_region = _missed(rows.where("region_code IS NULL"), "unmapped_regions", F.coalesce(F.nullif("region_name", F.lit("")), "raw_code"))
    no_tax = _missed(rows.where("region_code IS NOT NULL AND tax_code IS NULL"), "unmapped_taxes", F.col("tax_name"))
    rows = rows.where("region_code IS NOT NULL AND tax_code IS NOT NULL")
    bounds = validity(*(F.col(c) for c in ("period_year", "date_from", "date_to", "npa_date")), default_year, this_year)
    rows = rows.select("*", *bounds, text.parse_date(F.col("date_from")).alias("period_from"), text.parse_date(F.col("date_to")).alias("period_to")).withColumn("npa_date", text.parse_date(F.col("npa_date")))
    flags = text.flags_for(F.col("payer"))
    is_rate, is_benefit = F.expr("rate_value <> '' OR object_name <> ''"), F.expr("benefit_category <> '' OR benefit_kind <> '' OR benefit_size <> ''")
    rates = rows.where(is_rate).withColumn("first", F.lit(True)).withColumn("payer", first_payer(["payer_text_payer", "object_name_payer"])).select("*", *flags)
    rates = rates.withColumn("rate_text", F.col("rate_value")).withColumn("rate_value", text.parse_number(F.col("rate_text"))).withColumn("object_group", F.substring_index("object_name", ":", 1))
    benefits = rows.where(is_benefit).withColumn("first", ~is_rate).withColumn("payer", first_payer(["payer_text_payer", "benefit_category_payer", "benefit_kind_payer"])).select("*", *flags)
    called = {"category": "benefit_category", "kind": "benefit_kind", "size_text": "benefit_size", "size_unit": "benefit_unit"}
    benefits = benefits.select("*", *(F.col(c).alias(n) for n, c in called.items()), text.parse_number(F.col("benefit_size")).alias("size_value"))
    return Loaded(rates.select(*RATE), benefits.select(*BENEFIT), no_region.unionByName(no_tax).distinct(), votes, seen.get["n"], (rates.select(*RATE, "first"), benefits.select(*BENEFIT, "first")))


def norms_of_export(export: DataFrame, listed: DataFrame, region: DataFrame, alias: DataFrame, tax: str | None = None, source: Column | None = None) -> Loaded:
    """Records of an export (attrs, tr, tb) with its dictionary (id, value) to rates and benefits. Regions and taxes are resolved once for each id; a value's code stands before its first hyphen. If both have a column file, each file's ids are its own, and it names the source."""
    own = ["file"] * ("file" in export.columns and "file" in listed.columns)
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    either = lambda m, a, b: F.coalesce(F.nullif(F.try_element_at(m, F.lit(a)), F.lit("")), F.try_element_at(m, F.lit(b)))
    seen = Observation()
    source = source if source is not None else F.element_at(F.split("file", "/"), -1) if own else F.lit("")
    rows = session.kept(export.select(*own, "attrs", "tr", "tb", F.coalesce(at("Region_ID"), F.lit("")).alias("region_id"), F.coalesce(at("Nalog_ID"), F.lit("")).alias("tax_id"), source.alias("source_file")).observe(seen, F.count(F.lit(1)).alias("n")))
    listed = session.kept(listed.select(*own, "id", "value"))
    value = lambda ids: rows.select(*own, F.col(ids).alias("id")).distinct().join(listed, [*own, "id"], "left").withColumn("known", F.coalesce("value", F.lit("?"))).withColumn("value", F.coalesce("value", "id"))
    parts = F.split("value", "-", 2)
    places = value("region_id").withColumn("raw", F.trim(parts[0])).withColumn("name", F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), "value"))
    places = resolve.placed(places, region, "raw", "name").select(*own, F.col("id").alias("region_id"), "region_code", F.col("known").alias("region_said"))
    taxes = value("tax_id")
    taxes = (taxes.withColumn("tax_code", F.lit(tax)) if tax else resolve.by_alias(taxes, alias, "value")).select(*own, F.col("id").alias("tax_id"), "tax_code", F.col("known").alias("tax_said"))
    rows = rows.join(resolve.dimension(session.kept(places)), [*own, "region_id"], "left").join(resolve.dimension(session.kept(taxes)), [*own, "tax_id"], "left")
    misses = _missed(rows.where("region_code IS NULL"), "unmapped_regions", F.col("region_said")).unionByName(_missed(rows.where("region_code IS NOT NULL AND tax_code IS NULL"), "unmapped_taxes", F.col("tax_said")))
    year = text.parse_year(F.coalesce(at("TaxPeriod"), F.lit("")))
    rows = rows.where("region_code IS NOT NULL AND tax_code IS NOT NULL").select(
        year.alias("year"), year.alias("year_from"), year.alias("year_to"), "region_code", "tax_code", text.clean(either("attrs", "Oktmo_ID", "Oktmo")).alias("oktmo"), text.clean(at("MunObraz")).alias("mo_name"),
        text.clean(at("LawDoc")).alias("npa_name"), text.clean(at("LawNum")).alias("npa_number"), text.parse_date(F.coalesce(at("LawDate"), F.lit(""))).alias("npa_date"), text.clean(at("LawOrgan")).alias("npa_authority"),
        F.lit(None).cast("string").alias("period_from"), F.lit(None).cast("string").alias("period_to"), "source_file", "tr", "tb",
    )
    child = lambda name: text.clean(F.try_element_at("child", F.lit(name)))

    def flagged(nested: str) -> DataFrame:
        each = rows.select("*", F.posexplode(nested).alias("pos", "child")).withColumn("first", (F.col("pos") == 0) & (F.lit(nested == "tr") | (F.size("tr") == 0)))
        flags = text.payer_flags(F.col("child"))
        return each.select("*", *(flags[k].alias(f"for_{k}") for k in ("fl", "ul", "ip"))).withColumn("payer", text.payer_from_flags(F.col("for_fl"), F.col("for_ul"), F.col("for_ip")))

    rates = flagged("tr").withColumn("object_name", child("TaxObject")).withColumn("rate_text", child("TaxRates")).withColumn("rate_unit", child("Unit")).withColumn("condition", child("Condition")).withColumn("payer_text", F.lit(""))
    rates = rates.withColumn("object_group", text.object_group(F.col("object_name"))[0]).withColumn("rate_value", text.parse_number(F.col("rate_text")))
    benefits = flagged("tb").withColumn("category", child("Category")).withColumn("amount", child("Amount")).withColumn("size_unit", child("Unit")).withColumn("condition", child("Condition")).withColumn("basis", text.clean(either("child", "Base", "LawArticle")))
    benefits = benefits.withColumn("kind", text.benefit_kind(F.col("amount"), F.col("size_unit"))).withColumn("size_text", F.trim(F.concat("amount", F.lit(" "), "size_unit"))).withColumn("size_value", text.parse_number(F.col("amount")))
    return Loaded(rates.select(*RATE), benefits.select(*BENEFIT), misses.distinct(), None, seen.get["n"], (rates.select(*RATE, "first"), benefits.select(*BENEFIT, "first")))


# ---------------------------------------------------------------- forms


def _title_cells(rows: DataFrame) -> DataFrame:
    """file, at and cell of the first rows of each table, tables in their order where rows have it."""
    sheet = [c for c in ("table_at", "table") if c in rows.columns]
    top = rows.where(F.col("row_idx") < TITLE_ROWS)
    return top.select("file", *sheet, "row_idx", F.posexplode("cells").alias("pos", "cell")).select("file", F.struct(*sheet, "row_idx", "pos").alias("at"), text.clean(F.col("cell")).alias("cell")).where("cell <> ''")


def path_parts(path: Column) -> Column:
    """The file's name without its suffix, then its folders, the nearest first."""
    folders = F.split(path, "/")
    name = F.regexp_replace(F.element_at(folders, -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.array(name), F.reverse(F.slice(folders, 1, F.size(folders) - 1)))


def path_year(path: Column) -> Column:
    """F19, of the path alone: the nearest part's year from 2000 on."""
    years = F.filter(F.transform(path_parts(path), text.parse_year), lambda y: y >= 2000)
    return F.get(years, F.lit(0))


def guess_years(rows: DataFrame) -> DataFrame:
    """file and year: of the path, else of the first title cell that speaks of a year or period, else of any title cell."""
    title = _title_cells(rows).withColumn("year", text.parse_year(F.col("cell"))).where("year IS NOT NULL").withColumn("other", (~F.regexp_like(F.lower("cell"), F.lit("год|период"))).cast("int"))
    said = title.groupBy("file").agg(F.min_by("year", F.struct("other", "at")).alias("said"))
    return rows.select("file").distinct().join(said, "file", "left").select("file", F.coalesce(path_year(F.col("file")), "said").alias("year"))


def guess_regions(rows: DataFrame, region: DataFrame) -> DataFrame:
    """file and region_code: of each part of the path a number of two digits that is a region's (the year taken out), else its name; else the first title cell that names one."""
    known = region.where("code <> '00'").select(F.col("code").alias("token"), F.col("code").alias("region_code"))
    parts = rows.select("file").distinct().select("file", path_year(F.col("file")).cast("string").alias("year"), F.posexplode(path_parts(F.col("file"))).alias("part", "said"))
    parts = parts.withColumn("bare", F.when(F.col("year").isNull(), F.col("said")).otherwise(F.replace("said", "year", F.lit(" "))))
    tokens = parts.select("file", "part", F.posexplode(F.regexp_extract_all("bare", F.lit(r"(?<!\d)\d{2}(?!\d)"), F.lit(0))).alias("pos", "token"))
    by_token = tokens.join(known, "token").select("file", F.struct("part", F.lit(0).alias("kind"), "pos").alias("at"), "region_code")
    named = parts.select("file", "part", F.translate("said", "_-", "  ").alias("name"))
    by_part = resolve.by_name(named, region, "name").where("region_code IS NOT NULL").select("file", F.struct("part", F.lit(1).alias("kind"), F.lit(0).alias("pos")).alias("at"), "region_code")
    best = by_token.unionByName(by_part).groupBy("file").agg(F.min_by("region_code", "at").alias("of_path"))
    titles = _title_cells(rows).where(F.length("cell") >= 4).withColumn("name", F.regexp_replace("cell", r"(?iu)^(по|в)\s+", ""))
    said = resolve.by_name(titles, region, "name").where("region_code IS NOT NULL").groupBy("file").agg(F.min_by("region_code", "at").alias("said"))
    return rows.select("file").distinct().join(best, "file", "left").join(said, "file", "left").select("file", F.coalesce("of_path", "said").alias("region_code"))


def guess_places(rows: DataFrame, region: DataFrame) -> DataFrame:
    """file, year and region_code of each file, from its path and its first rows, which are written once."""
    top = session.kept(rows.where(F.col("row_idx") < TITLE_ROWS))
    return guess_years(top).join(guess_regions(top, region), "file")


def forms(rows: DataFrame, codes: DataFrame, region: DataFrame, tax: str, year: int | None = None, region_code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """R8 for whole files: raw rows to facts, and a problem for each file that gives none. codes: tax_code, year, payer, row_code, col_index, indicator_id.

    The rows are written once with clean cells, and what the files are a row a file.
    """
    rows = session.kept(rows.withColumn("cells", F.transform("cells", text.clean)))
    files = rows.select("file").distinct()
    files = files.withColumn("year", F.lit(year)) if year is not None else guess_years(rows)
    files = files.withColumn("region_code", F.lit(region_code)) if region_code is not None else files.join(guess_regions(rows, region), "file", "left")
    files = resolve.dimension(session.kept(files))
    mine = codes.where(F.col("tax_code") == tax)
    placed = rows.join(files.where("year IS NOT NULL AND region_code IS NOT NULL"), "file")
    found = session.kept(resolve.by_row_code(placed, mine, ["year"]))
    facts = found.join(files.select("file", "region_code"), "file").select("year", "region_code", F.lit(tax).alias("tax_code"), "indicator_id", "payer", "value", F.element_at(F.split("file", "/"), -1).alias("source_file"))
    state = files.join(F.broadcast(mine.select("year").distinct().withColumn("mapped", F.lit(True))), "year", "left").join(found.groupBy("file").agg(F.count(F.lit(1)).alias("values")), "file", "left")  # years are few
    problem = F.when(F.col("year").isNull(), "no year").when(F.col("region_code").isNull(), "no region").when(F.col("mapped").isNull(), "no codes for the year").when(F.col("values").isNull(), "no known code")
    return facts, state.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def form_stats(rows: DataFrame, facts: DataFrame, problems: DataFrame, codes: DataFrame, most: int = 20) -> DataFrame:
    """For each file rows_read, values, its problem and, where it has no known code, the first cells that look like one."""
    read = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows_read"))
    saved = facts.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("values"))
    lost = rows.join(problems.where("problem = 'no known code'").select("file"), "file", "left_semi").select("file", F.explode("cells").alias("cell")).withColumn("cell", text.clean(F.col("cell")))
    unknown = lost.where(F.regexp_like("cell", F.lit(r"^\d{3,4}$"))).distinct().withColumn("bare", resolve.bare_code(F.col("cell"))).join(codes.select(resolve.bare_code(F.col("row_code")).alias("bare")), "bare", "left_anti")
    first = unknown.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("cell"))).where(F.col("at") <= most).groupBy("file").agg(F.array_sort(F.collect_list("cell")).alias("unknown_codes"))
    return read.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(saved, "name", "left").join(problems, "file", "left").join(first, "file", "left").select("file", "rows_read", F.coalesce("values", F.lit(0)).alias("values"), "problem", F.coalesce("unknown_codes", F.array().cast("array<string>")).alias("unknown_codes"))


def replace_slices(old: DataFrame, new: DataFrame) -> DataFrame:
    """K2: the facts with every (year, region, tax) that new has taken from new alone."""
    slice_ = ["year", "region_code", "tax_code"]
    return old.join(new.select(*slice_).distinct(), slice_, "left_anti").unionByName(new)
