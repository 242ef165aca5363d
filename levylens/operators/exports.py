"""Q12: the five tables that a portal gives away as files, each with a fixed header; delimited.csv_bytes() or write_csv() puts them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facts, norms, terms

#: Rows of a file, at most, and terms.
MOST, TERMS = 100_000, 1000
# What the columns of a form are called.
SHOWN = {"value": "значение", "avg": "среднее_по_субъектам", "rank": "ранг"}
RATE = ["id", "year", "year_from", "year_to", "oktmo", "mo_name", "payer", "payer_text", "object_name", "rate_value", "rate_text", "rate_unit", "condition", "npa_name", "npa_number", "npa_date", "npa_authority"]
BENEFIT = ["id", "year", "year_from", "year_to", "oktmo", "mo_name", "payer", "for_fl", "for_ul", "for_ip", "category", "kind", "size_text", "size_value", "size_unit", "condition", "basis", "npa_name", "npa_number", "npa_date", "npa_authority"]
POINT = ["year", "value", "avg", "median", "ratio", "rank", "n"]


def _columns(rows: DataFrame, listed: list[str]) -> DataFrame:
    """The listed columns in order; one that the table lacks is null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in listed))


def form(fact: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, year: int, region_code: str) -> DataFrame:
    table = facts.form_table(fact, region, indicator, tax, year, region_code).orderBy("section", "sort_order", "indicator_id")
    return table.select("section", F.col("name").alias("indicator"), "unit", *(F.col(f"{p}_{c}").alias(f"{p}_{said}") for p in ("ul", "fl", "total") for c, said in SHOWN.items()))


def rates(rate: DataFrame, tax: str, year: int, region_code: str, payer: str | None = None, search: str = "") -> DataFrame:
    found = norms.select_norms(rate, ["object_name", "payer_text", "npa_name"], tax, region_code, year, payer, search)
    order = [F.coalesce(F.col("mo_name") != "", F.lit(False)), F.coalesce("object_group", "object_name"), "object_name", "rate_value", "id"]
    return _columns(norms.page(found, order, MOST), RATE)


def benefits(benefit: DataFrame, tax: str, year: int, region_code: str, payer: str | None = None, search: str = "") -> DataFrame:
    found = norms.select_norms(benefit, ["category", "kind", "condition", "basis"], tax, region_code, year, payer, search)
    return _columns(norms.page(found, norms.BENEFIT_ORDER, MOST), BENEFIT)


def series(fact: DataFrame, region: DataFrame, indicator: DataFrame, tax: str, region_code: str, indicators: list[int], payer: str = "total") -> DataFrame:
    points = facts.series(fact, region, indicator, tax, region_code, indicators, payer)
    named = points.join(indicator.select(F.col("id").alias("indicator_id"), "unit", "section", "sort_order"), "indicator_id")
    return named.orderBy("section", "sort_order", "indicator_id", "year").select(F.col("name").alias("indicator"), "unit", *POINT)


def cloud(cube: DataFrame, tax: str, payer: str = "fl", years: list[int] | None = None, regions: list[str] | None = None) -> DataFrame:
    return terms.cloud(cube, tax, payer, years, regions, limit=TERMS).select("term", "freq", "docs", "score", "is_bigram")
