"""Rates and benefits: validity, payers, search, pages, counts, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = 9999


def valid_in(year: int) -> Column:
    """An unknown start is always valid, an open end for ever."""
    start = F.coalesce("year_from", "year")
    return start.isNull() | ((start <= year) & (F.coalesce("year_to", F.lit(FOREVER)) >= year))


def for_payer(payer: str | None) -> Column:
    """By flag, or by the name all; any other word filters nothing."""
    if payer in ("fl", "ul", "ip"):
        return F.col(f"for_{payer}") == 1
    return F.col("payer") == "all" if payer == "all" else F.lit(True)


def matches(text: str | None, columns: list[str]) -> Column:
    """A case-blind pattern anywhere in the columns, one after the other; null is empty; % and _ are live."""
    needle = (text or "").strip().lower().replace("\\", "\\\\")  # a backslash is a letter like any other
    if not needle:
        return F.lit(True)
    parts = [x for c in columns for x in (F.lit(" "), F.coalesce(c, F.lit("")))][1:]
    return F.lower(F.concat(*parts)).like(f"%{needle}%")


def select_norms(norms: DataFrame, columns: list[str], tax: str | None = None, region: str | None = None, year: int | None = None, payer: str | None = None, text: str | None = None) -> DataFrame:
    for name, value in (("tax_code", tax), ("region_code", region)):
        norms = norms.where(F.col(name) == value) if value is not None else norms
    norms = norms.where(valid_in(year)) if year is not None else norms
    return norms.where(for_payer(payer) & matches(text, columns))


def page(rows: DataFrame, order: list, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of the ordered rows; order ends with a key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_total(rows: DataFrame, order: list, limit: int = 500, offset: int = 0) -> DataFrame:
    """Q9, Q10: a page beside the number of all rows that it is cut from."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, order, limit, offset).crossJoin(F.broadcast(total))  # one row


def rate_order() -> list:
    return ["municipal", F.coalesce("object_group", "object_name"), "object_name", "rate_value", "id"]


BENEFIT_ORDER = ["payer", "category", "id"]


def payer_counts(norms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows by flag, those for all, and all rows; flags overlap."""
    flag = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"n_{c[4:]}")
    return norms.groupBy(*(by or [])).agg(flag("for_fl"), flag("for_ul"), flag("for_ip"), F.count_if(F.col("payer") == "all").alias("n_all"), F.count(F.lit(1)).alias("n_total"))


def profile_counts(rate: DataFrame, benefit: DataFrame) -> DataFrame:
    """Rates, their municipalities (null and '' are one) and benefits, in one row."""
    a = rate.agg(F.count(F.lit(1)).alias("rates"), F.countDistinct(F.coalesce("oktmo", F.lit(""))).alias("municipalities"))
    return a.crossJoin(benefit.agg(F.count(F.lit(1)).alias("benefits")))  # one row each


def explode_years(rows: DataFrame, last: int, first: int = 2000, open_end: bool = False) -> DataFrame:
    """A row for each year of validity from first to last, at least one; year 0 without a start; an open end is one year unless open_end."""
    return rows.withColumn("year", F.explode(years_of(last, first, open_end)))


def years_of(last: int, first: int = 2000, open_end: bool = False) -> Column:
    """The years that explode_years() gives a row."""
    start = F.greatest(F.lit(first), F.col("year_from"))
    end = F.least(F.lit(last), F.coalesce("year_to", F.lit(last) if open_end else start))
    return F.when(F.col("year_from").isNull(), F.array(F.lit(0))).otherwise(F.sequence(start, F.greatest(start, end)))


def explode_payers(rows: DataFrame) -> DataFrame:
    """R2: a row for each flag; without one the named payer, or all."""
    flagged = F.filter(F.array(*(F.when(F.col(f"for_{k}") == 1, k) for k in ("fl", "ul", "ip"))), lambda x: x.isNotNull())
    rest = F.array(F.coalesce(F.nullif("payer", F.lit("")), F.lit("all")))
    return rows.withColumn("payer", F.explode(F.when(F.size(flagged) > 0, flagged).otherwise(rest)))


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates of the records that name a rate or an object, benefits of those with a category, a kind or a size."""
    said = lambda *names: " OR ".join(f"coalesce({n}, '') <> ''" for n in names if n in records.columns) or "false"
    return records.where(f"rate_value IS NOT NULL OR {said('rate_text', 'object_name')}"), records.where(f"size_value IS NOT NULL OR {said('category', 'kind', 'size_text')}")


def explode_nested(records: DataFrame, field: str) -> DataFrame:
    """A row for each child of a nested record, beside the parent's attributes."""
    return records.select("attrs", F.explode(field).alias("child"))
