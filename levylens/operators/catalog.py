"""Dimensions and what data there are for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence(dim: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Dim with 1 or 0 for each table, by whether it has a row for key."""
    for name, rows in tables.items():
        dim = dim.join(rows.select(F.col(key).alias("code")).distinct().withColumn(name, F.lit(1)), "code", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return dim


def regions(region: DataFrame, fact: DataFrame, rate: DataFrame, benefit: DataFrame, tax: str | None = None, year: int | None = None) -> DataFrame:
    """Regions, aggregates first; only the facts are held to the year."""
    of_tax = lambda t: t.where(F.col("tax_code") == tax) if tax is not None else t
    facts = of_tax(fact)
    facts = facts.where(F.col("year") == year) if year is not None else facts
    out = presence(region, "region_code", has_stats=facts, has_rates=of_tax(rate), has_benefits=of_tax(benefit))
    return out.orderBy((F.col("kind") == "aggregate").desc(), "name", "code")


def years(fact: DataFrame, rate: DataFrame, benefit: DataFrame, tax: str | None = None) -> DataFrame:
    """All years of facts and first years of norms; ends of periods do not count."""
    parts = [fact.select("tax_code", "year")] + [t.select("tax_code", F.col(c).alias("year")) for t in (rate, benefit) for c in ("year", "year_from")]
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.where(F.col("tax_code") == tax) if tax is not None else rows
    return rows.where("year IS NOT NULL").select("year").distinct().orderBy("year")


def indicators(indicator: DataFrame, code: DataFrame, tax: str | None = None, year: int | None = None) -> DataFrame:
    """Indicators, of those that have a code in the year if one is given."""
    out = indicator.where(F.col("tax_code") == tax) if tax is not None else indicator
    if year is not None:
        out = out.join(code.where(F.col("year") == year), out.id == code.indicator_id, "left_semi")
    return out.orderBy("section", "sort_order", "id")


def meta(fact: DataFrame) -> DataFrame:
    """By tax the first and last year, regions and rows."""
    return fact.groupBy("tax_code").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.countDistinct("region_code").alias("regions"), F.count(F.lit(1)).alias("n_rows"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last by order; rows that tie to the end are alike in order."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key."""
    both = old.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)))
    return latest(both, keys, ["age_"]).drop("age_")


def refresh(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """A dimension after a load: new rows take the place of old ones with their key, but for the columns kept, which only a new key sets."""
    first = old.select(*keys, *(F.col(c).alias(f"{c}_old") for c in kept), F.lit(True).alias("known_"))
    rows = upsert(old, new.select(*old.columns), keys).join(first, keys, "left")
    return rows.select(*(F.when(F.col("known_"), F.col(f"{c}_old")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in old.columns))


def ambiguous(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(*by).agg(F.countDistinct(value).alias("kinds")).where("kinds > 1")
