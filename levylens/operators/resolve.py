"""Rows of raw tables to regions, taxes and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levylens import session
from levylens.functions import matching, text

#: Rows of a dimension that is broadcast, at most.
SMALL = 100_000


def dimension(table: DataFrame) -> DataFrame:
    """table with a broadcast hint if it is counted to be small; else as it is, for Spark to choose."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def region_code(raw: Column) -> Column:
    """The first two digits, one digit after a zero; null without digits."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.nullif(F.when(F.length(digits) < 3, F.lpad(digits, 2, "0")).otherwise(F.substring(digits, 1, 2)), F.when(digits == "", F.lpad(digits, 2, "0")))


def by_code(rows: DataFrame, region: DataFrame, raw: str, out: str = "region_code") -> DataFrame:
    known = dimension(region.select(F.col("code").alias("found_"), F.col("code").alias(out)))
    return rows.withColumn("found_", region_code(F.col(raw))).join(known, "found_", "left").drop("found_")


def _names(table: DataFrame, value: str, *order: Column | str) -> matching.Names | None:
    """The names (key and value) of a dimension in order; None if it is too large for one list."""
    listed = table.select("key", value, *order).orderBy(*order).limit(SMALL + 1).collect()
    return matching.Names([(r[0], r[1]) for r in listed]) if len(listed) <= SMALL else None


def by_name(rows: DataFrame, region: DataFrame, name: str, out: str = "region_code") -> DataFrame:
    """An equal key, else the first region whose key of over four letters holds or is held by it.

    An automaton of the regions' keys goes to the rows. Regions too many for one meet the distinct names in a join.
    """
    spelled = F.array(*(F.col(c) for c in ("name", "short_name") if c in region.columns))
    known = region.select(F.col("code").alias("code_"), F.posexplode(spelled).alias("at_", "spelled")).where("spelled IS NOT NULL").select("code_", "at_", text.name_key(F.col("spelled")).alias("key")).where("key <> ''")
    names = _names(known, "code_", "code_", "at_")
    if names:
        session.bind(rows.sparkSession)
        return rows.withColumn(out, matching.over_batch(names.named, text.name_key(F.col(name))))
    keys = rows.select(F.col(name).alias("name_")).distinct().withColumn("said_", text.name_key(F.col("name_"))).where("said_ <> ''")
    near = (F.col("said_") == F.col("key")) | ((F.length("key") > 4) & (F.contains("said_", "key") | F.contains("key", "said_")))
    best = keys.join(known, near).groupBy("name_").agg(F.min_by("code_", F.struct(F.col("said_") != F.col("key"), "code_", "at_")).alias(out))
    return rows.join(best, rows[name].eqNullSafe(best.name_), "left").drop("name_")


def prefix_of(code: Column, width: int = 2) -> Column:
    return F.nullif(F.substring(F.regexp_replace(code, r"\D", ""), 1, width), F.lit(""))


def votes_of(rows: DataFrame, code: str, resolved: str, earlier: DataFrame | None = None, width: int = 2) -> DataFrame:
    """Prefix, vote and n: how many resolved rows of each code's first digits have each region; earlier has those of runs before."""
    own = rows.where(F.col(resolved).isNotNull()).select(prefix_of(F.col(code), width).alias("prefix"), F.col(resolved).alias("vote"), F.lit(1).cast("long").alias("n")).where("prefix IS NOT NULL")
    return (own.unionByName(earlier) if earlier is not None else own).groupBy("prefix", "vote").agg(F.sum("n").alias("n"))


def by_prefix_vote(rows: DataFrame, code: str, resolved: str, width: int = 2, votes: DataFrame | None = None) -> DataFrame:
    """Rows without a region take the one that most resolved rows of their code's first digits have; ties go to the least. votes: as votes_of() gives them, by default those of rows."""
    votes = votes_of(rows, code, resolved, width=width) if votes is None else votes
    won = votes.groupBy(F.col("prefix").alias("prefix_")).agg(F.min_by("vote", F.struct(-F.col("n"), "vote")).alias("vote_"))  # at most 10 ** width rows
    won = F.broadcast(won) if width < 5 else won
    return rows.withColumn("prefix_", prefix_of(F.col(code), width)).join(won, "prefix_", "left").withColumn(resolved, F.coalesce(resolved, "vote_")).drop("prefix_", "vote_")


def placed(rows: DataFrame, region: DataFrame, code: str, name: str) -> DataFrame:
    """Rows with region_code by code, else by name."""
    return by_name(by_code(rows, region, code, "by_code_"), region, name, "by_name_").withColumn("region_code", F.coalesce("by_code_", "by_name_")).drop("by_code_", "by_name_")


def regions(rows: DataFrame, region: DataFrame, code: str, name: str, oktmo: str, votes: DataFrame | None = None) -> DataFrame:
    """J9 to J11 in turn: by code, else by name, else by what the rows so resolved, or votes, say of the municipal code's beginning."""
    return by_prefix_vote(placed(rows, region, code, name), oktmo, "region_code", votes=votes)


def tax_aliases(tax: DataFrame, alias: DataFrame) -> DataFrame:
    """tax_code, alias and at: what a tax may be called, its name, short name and code before the listed aliases (tax_code, alias, and at if their order matters)."""
    own = F.array(*(F.col(c) for c in ("name", "short_name", "code") if c in tax.columns))
    place = F.col("sort_order") if "sort_order" in tax.columns else F.lit(0)
    called = tax.select(F.col("code").alias("tax_code"), place.alias("place"), F.posexplode(own).alias("pos", "alias")).where("alias IS NOT NULL").select("tax_code", "alias", F.struct(F.lit(0).alias("listed"), F.col("place").cast("long").alias("a"), F.col("tax_code").alias("b"), F.col("pos").cast("long").alias("c")).alias("at"))
    order = F.col("at").cast("long") if "at" in alias.columns else F.lit(0).cast("long")
    return called.unionByName(alias.select("tax_code", "alias", F.struct(F.lit(1).alias("listed"), order.alias("a"), F.col("alias").alias("b"), F.lit(0).cast("long").alias("c")).alias("at")))


def by_alias(rows: DataFrame, alias: DataFrame, name: str, out: str = "tax_code") -> DataFrame:
    """The tax of the longest alias, by its key, that a text holds; of equals the first by `at`, if the aliases have it, else by spelling.

    An automaton of the aliases goes to the rows. Aliases too many for one meet the distinct texts in a join.
    """
    order = ["at", "alias", "tax_code"] if "at" in alias.columns else ["alias", "tax_code"]
    known = alias.where("alias IS NOT NULL").withColumn("key", text.norm_key(F.col("alias"))).where("key <> ''")
    names = _names(known, "tax_code", *order)
    if names:
        session.bind(rows.sparkSession)
        return rows.withColumn(out, matching.over_batch(names.longest, text.norm_key(F.col(name))))
    keys = rows.select(F.col(name).alias("name_")).distinct().withColumn("said_", text.norm_key(F.col("name_")))
    held = keys.join(known.withColumnRenamed("tax_code", "tax_"), F.contains("said_", "key"))
    best = held.groupBy("name_").agg(F.min_by("tax_", F.struct(-F.length("key"), *("tax_" if c == "tax_code" else c for c in order))).alias(out))
    return rows.join(best, rows[name].eqNullSafe(best.name_), "left").drop("name_")


def bare_code(c: Column) -> Column:
    """A row code without leading zeros and without what a workbook makes of a number."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.0$", ""), "^0+(?=.)", "")


def by_row_code(cells: DataFrame, codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of cells to facts.

    The first cell of three or four digits that is a known code names the row: one spelled alike, else one
    alike but for leading zeros. A code's col_index n takes the n-th number to its right, none the first; a
    row with fewer numbers says nothing of it. Of a file's rows the last wins, in the order of its tables
    (table_at where cells have it, else the table's name) and rows. by: columns of both that must agree.
    """
    by, sheet = by or [], [c for c in ("table_at", "table") if c in cells.columns]
    entry = F.struct("row_code", "indicator_id", "payer", "col_index")
    known = codes.withColumn("bare", bare_code(F.col("row_code"))).groupBy(*by, "bare").agg(F.collect_set(entry).alias("entries"))
    said = F.regexp_replace(F.trim("cell"), r"\.0$", "")
    each = cells.select("file", *sheet, "row_idx", *by, "cells", F.posexplode("cells").alias("pos", "cell")).where(F.regexp_like(F.trim("cell"), F.lit(r"^\d{3,4}(\.0)?$"))).withColumn("said", said).withColumn("bare", bare_code(F.col("cell")))
    first = each.join(known, [*by, "bare"]).groupBy("file", *sheet, "row_idx", *by).agg(F.min_by(F.struct("pos", "said", "cells", "entries"), "pos").alias("m")).select("file", *sheet, "row_idx", *by, "m.*")
    alike = F.filter("entries", lambda e: (e["row_code"] == F.col("said")) | (bare_code(e["row_code"]) == F.col("said")))
    numbers = F.filter(F.transform(F.slice("cells", F.col("pos") + 2, F.size("cells")), text.parse_number), lambda x: x.isNotNull())
    rows = first.withColumn("alike", alike).withColumn("numbers", numbers)
    facts = rows.withColumn("e", F.explode(F.when(F.size("alike") > 0, F.col("alike")).otherwise(F.col("entries")))).select("file", *sheet, "row_idx", *by, "numbers", "e.indicator_id", "e.payer", "e.col_index")
    wanted = F.when(F.col("col_index") > 0, F.col("col_index")).otherwise(1)
    facts = facts.withColumn("value", F.get("numbers", wanted - 1)).where("value IS NOT NULL")
    return facts.groupBy("file", *by, "indicator_id", "payer").agg(F.max_by("value", F.struct(*sheet, "row_idx")).alias("value"))


def unknown_codes(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """Three- or four-digit cells that are no known row code."""
    seen = cells.select(F.explode("cells").alias("cell")).where(F.regexp_like("cell", F.lit(r"^\d{3,4}$"))).distinct()
    return seen.withColumn("bare", bare_code(F.col("cell"))).join(codes.select(bare_code(F.col("row_code")).alias("bare")), "bare", "left_anti").select("cell")


def misses(rows: DataFrame, reason: str, value: str, most: int = 20) -> DataFrame:
    """Unresolved values by reason, the first in order; no more than `most` of a reason are ever held."""
    n = rows.groupBy(reason, value).agg(F.count(F.lit(1)).alias("n_"))
    first = n.withColumn("at_", F.row_number().over(Window.partitionBy(reason).orderBy(value))).where(F.col("at_") <= most)
    return n.groupBy(reason).agg(F.sum("n_").alias("n")).join(first.groupBy(reason).agg(F.array_sort(F.collect_list(value)).alias("examples")), reason)
