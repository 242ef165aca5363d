"""Regions, taxes and aliases from their lists, brought into the tables that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens.operators import catalog

REGION = "code string, name string, short_name string, federal_district string, kind string, valid_from string, valid_to string, note string"
TAX = "code string, name string, short_name string, level string, form_code string, sort_order int"
ALIAS = "tax_code string, alias string"


def _read(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).option("sep", sep).schema(schema).csv(path)


def read_regions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Blank bounds are null, other blanks stay blanks."""
    rows = _read(spark, path, REGION, sep)
    blank = [c for c in rows.columns if c not in ("code", "valid_from", "valid_to")]
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in blank else F.col(c) for c in rows.columns))


def read_taxes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return _read(spark, path, TAX, sep)


def read_aliases(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Aliases in the list's order, which decides between aliases of a length; the list is a dimension of one file."""
    return _read(spark, path, ALIAS, sep).coalesce(1).withColumn("at", F.monotonically_increasing_id())


def load_regions(old: DataFrame, new: DataFrame) -> DataFrame:
    """A known region keeps its bounds."""
    return catalog.refresh(old, new, ["code"], ["valid_from", "valid_to"])


def load_taxes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A known tax keeps its place."""
    return catalog.refresh(old, new, ["code"], ["sort_order"])
