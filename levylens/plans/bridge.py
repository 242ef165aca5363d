"""The driver's tables as the domain's: regions, taxes, indicators, facts, norms and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOPS = ["the", "and", "that", "les", "des", "und", "der", "die", "que", "los"]


class Domain:
    """Lazy frames over the parquet files of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def code(key) -> F.Column:
        return F.lpad((key + 1).cast("string"), 2, "0")

    @property
    def region(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        subjects = n.join(r, n.n_regionkey == r.r_regionkey).select(self.code(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("federal_district"), F.lit("subject").alias("kind"))
        return subjects.unionByName(self.spark.createDataFrame([("00", "ALL", "ALL", "aggregate")], subjects.schema))

    @property
    def indicator(self) -> DataFrame:
        rows = [(1, "2", "quantity", "pcs", 10), (2, "1", "revenue", "rub", 30), (3, "2", "lines", "pcs", 20), (4, "1", "orders", "pcs", 40)]
        return self.spark.createDataFrame(rows, "id int, section string, name string, unit string, sort_order int")

    @property
    def fact(self) -> DataFrame:
        """One exchange of lineitem by order, after column pruning; the cells are then few."""
        items = self.table("lineitem").groupBy("l_orderkey", F.when(F.col("l_linestatus") == "O", "ul").otherwise("fl").alias("payer")).agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")).alias("r"), F.count(F.lit(1)).alias("n")
        )
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("tax_code"), self.code(F.col("c_nationkey")).alias("region_code"))
        cells = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("year", "region_code", "tax_code", "payer").agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("o"))
        sums = [F.sum(c).alias(c) for c in "qrno"]
        both = cells.unionByName(cells.groupBy("year", "tax_code", "payer").agg(*sums).withColumn("region_code", F.lit("00")), allowMissingColumns=True)
        return both.selectExpr("year", "region_code", "tax_code", "payer", "stack(4, 1, CAST(q AS DOUBLE), 2, CAST(r AS DOUBLE), 3, CAST(n AS DOUBLE), 4, CAST(o AS DOUBLE)) AS (indicator_id, value)")

    @property
    def norm(self) -> DataFrame:
        """One norm an order."""
        items = self.table("lineitem").groupBy("l_orderkey").agg(
            F.max(F.year("l_shipdate")).alias("last"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("for_ul"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("for_fl"), F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("part")
        )
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = o.join(items, o.o_orderkey == items.l_orderkey, "left").join(self.table("part"), F.col("part") == F.col("p_partkey"), "left")
        start = F.year("o_orderdate")
        flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return rows.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tax_code"), self.code(F.col("c_nationkey")).alias("region_code"), F.lit(None).cast("int").alias("year"),
            F.when(F.col("o_orderkey") % 50 != 0, start).alias("year_from"), F.when(F.col("o_orderstatus") != "O", F.greatest(start, F.coalesce("last", start))).alias("year_to"),
            flag("for_fl"), flag("for_ul"), F.lit(0).alias("for_ip"),
            F.when(F.coalesce("for_fl", F.lit(0)) + F.coalesce("for_ul", F.lit(0)) != 1, "all").when(F.col("for_fl") == 1, "fl").otherwise("ul").alias("payer"),
            F.col("p_name").alias("object_name"), F.substring_index("p_name", " ", 1).alias("object_group"), F.col("o_totalprice").alias("rate_value"),
            F.col("c_mktsegment").alias("category"), (F.col("o_custkey") % 3 == 0).cast("int").alias("municipal"), F.when(F.col("o_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("oktmo"),
        )

    @property
    def text(self) -> DataFrame:
        d = self.table("documents")
        start = (1995 + F.col("doc_id") % 7).cast("int")
        return d.select("doc_id", F.lit("t").alias("tax_code"), F.col("source").alias("region_code"), F.col("lang").alias("payer"), "text", start.alias("year_from"), F.when(F.col("doc_id") % 4 != 0, start + (F.col("doc_id") % 3).cast("int")).alias("year_to"))


# The same in DuckDB's SQL.
CODE = "lpad(CAST({} + 1 AS VARCHAR), 2, '0')"
REGION = f"region_ AS (SELECT {CODE.format('n_nationkey')} AS code, n_name AS name, r_name AS federal_district, 'subject' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '00', 'ALL', 'ALL', 'aggregate')"
INDICATOR = "indicator_ AS (SELECT * FROM (VALUES (1, '2', 'quantity', 'pcs', 10), (2, '1', 'revenue', 'rub', 30), (3, '2', 'lines', 'pcs', 20), (4, '1', 'orders', 'pcs', 40)) v(id, section, name, unit, sort_order))"
FACT = f"""cells_ AS (
  SELECT CAST(year(o_orderdate) AS INT) AS year, {CODE.format('c_nationkey')} AS region_code, o_orderpriority AS tax_code, CASE WHEN l_linestatus = 'O' THEN 'ul' ELSE 'fl' END AS payer,
    CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS r, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
wide_ AS (
  SELECT year, region_code, tax_code, payer, sum(q) AS q, sum(r) AS r, count(*) AS n, count(DISTINCT l_orderkey) AS o FROM cells_ GROUP BY ALL
  UNION ALL SELECT year, '00', tax_code, payer, sum(q), sum(r), count(*), count(DISTINCT l_orderkey) FROM cells_ GROUP BY ALL),
fact_ AS (
  SELECT year, region_code, tax_code, payer, 1 AS indicator_id, CAST(q AS DOUBLE) AS value FROM wide_ UNION ALL SELECT year, region_code, tax_code, payer, 2, CAST(r AS DOUBLE) FROM wide_
  UNION ALL SELECT year, region_code, tax_code, payer, 3, CAST(n AS DOUBLE) FROM wide_ UNION ALL SELECT year, region_code, tax_code, payer, 4, CAST(o AS DOUBLE) FROM wide_),
total_ AS (
  SELECT year, region_code, tax_code, indicator_id, payer, value FROM fact_
  UNION ALL SELECT year, region_code, tax_code, indicator_id, 'total', CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) FROM fact_ GROUP BY year, region_code, tax_code, indicator_id),
subject_ AS (SELECT t.*, name AS region_name FROM total_ t JOIN region_ ON region_code = code AND kind = 'subject')"""
NORM = f"""lines_ AS (SELECT l_orderkey, max(CAST(year(l_shipdate) AS INT)) AS last, max(CAST(l_linestatus = 'O' AS INT)) AS u, max(CAST(l_linestatus = 'F' AS INT)) AS f, min({{'a': l_linenumber, 'b': l_partkey}}).b AS part FROM lineitem GROUP BY 1),
norm_ AS (SELECT o_orderkey AS id, o_orderpriority AS tax_code, {CODE.format('c_nationkey')} AS region_code, CAST(NULL AS INT) AS year,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS year_from,
  CASE WHEN o_orderstatus <> 'O' THEN greatest(CAST(year(o_orderdate) AS INT), coalesce(last, CAST(year(o_orderdate) AS INT))) END AS year_to,
  coalesce(f, 0) AS for_fl, coalesce(u, 0) AS for_ul, 0 AS for_ip, CASE WHEN coalesce(f, 0) + coalesce(u, 0) <> 1 THEN 'all' WHEN f = 1 THEN 'fl' ELSE 'ul' END AS payer,
  p_name AS object_name, split_part(p_name, ' ', 1) AS object_group, o_totalprice AS rate_value, c_mktsegment AS category, CAST(o_custkey % 3 = 0 AS INT) AS municipal, CASE WHEN o_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS oktmo
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines_ ON o_orderkey = l_orderkey LEFT JOIN part ON part = p_partkey)"""
TEXT = """text_ AS (SELECT doc_id, 't' AS tax_code, source AS region_code, lang AS payer, text, CAST(1995 + doc_id % 7 AS INT) AS year_from, CASE WHEN doc_id % 4 <> 0 THEN CAST(1995 + doc_id % 7 + doc_id % 3 AS INT) END AS year_to FROM documents)"""
YEARS = """years_ AS (SELECT doc_id, tax_code, region_code, payer, text, CAST(unnest(generate_series(greatest(2000, year_from), greatest(greatest(2000, year_from), least(2030, coalesce(year_to, greatest(2000, year_from)))))) AS INT) AS year FROM text_)"""
WORDS = f"""raw_ AS (SELECT doc_id, list_filter(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[а-яa-z0-9][а-яa-z0-9-]*', 0), lambda x: length(x) > 1) AS w FROM documents),
place_ AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM raw_),
word_ AS (SELECT doc_id, tax_code, year, region_code, payer, term, pos FROM place_ JOIN (SELECT DISTINCT doc_id, tax_code, year, region_code, payer FROM years_) USING (doc_id)
  WHERE NOT regexp_full_match(term, '[0-9-]+') AND length(term) >= 3 AND term NOT IN ({', '.join(f"'{s}'" for s in STOPS)}))"""
COUNTS = """count_ AS (SELECT tax_code, year, region_code, payer, term, sum(n) AS term_freq, count(*) AS doc_freq, 0 AS is_bigram FROM (SELECT doc_id, tax_code, year, region_code, payer, term, count(*) AS n FROM word_ GROUP BY ALL) GROUP BY tax_code, year, region_code, payer, term),
cube_ AS (SELECT tax_code, year, region_code, payer, term, term_freq, doc_freq, is_bigram FROM count_ UNION ALL SELECT tax_code, year, '00', payer, term, sum(term_freq), sum(doc_freq), is_bigram FROM count_ GROUP BY tax_code, year, payer, term, is_bigram)"""
