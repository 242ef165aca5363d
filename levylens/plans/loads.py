"""Queries for loaders, service operators, methodology and import control, over the driver's tables written out as the files' rows would be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levylens import session
from levylens.functions import russian, text
from levylens.operators import catalog, exports, facts, loading, methodology, norms, resolve, service, shape, terms
from levylens.sources import export, ragged, report
from levylens.streaming import importing

from .bridge import CODE, COUNTS, FACT, INDICATOR, NORM, REGION, STOPS, TEXT, WORDS, YEARS, Domain
from .queries import _PICK, _STATS, _VALID, LAST, ORACLES, RF, TAX, YEAR, query

ALIASES = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("5-LOW", "low")]
WORDED = [("Физические лица", "fl"), ("Организации инвалидов", "ul"), ("Индивидуальные предприниматели", "ip"), ("Все категории", "all")]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _subjects(d: Domain) -> DataFrame:
    return d.region.where("kind = 'subject'")


# ---------------------------------------------------------------- norm files


def _records(d: Domain) -> DataFrame:
    """An order as a record: a third by code, a third by name alone, the rest by what the municipal code tells."""
    o = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, way, year = F.col("o_orderkey"), F.col("o_orderkey") % 3, F.year("o_orderdate")
    code, blank = Domain.code(F.col("c_nationkey")), F.lit("")
    return o.select(
        F.when(way == 0, F.concat(code, F.lit("-000"))).otherwise(blank).alias("region_code"),
        F.when(way == 1, F.concat(F.lit("Республика "), F.initcap("n_name"))).when((way == 2) & (k % 11 == 0), "Nowhere land").otherwise(blank).alias("region_name"),
        F.when((way == 2) & (k % 11 == 0), blank).otherwise(F.concat(code, F.lit(" 301-000"))).alias("oktmo"),
        F.concat(F.lit("Tax of "), F.lower("o_orderpriority")).alias("tax_name"),
        F.when(k % 4 == 0, blank).otherwise(F.concat(F.lit("за "), year, F.lit(" год"))).alias("period_year"),
        F.when(k % 4 == 0, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(blank).alias("date_from"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("31.12."), year + 1)).when(F.col("o_orderstatus") == "P", "01.01.2999").otherwise(blank).alias("date_to"),
        F.when(k % 5 < 3, F.concat("c_mktsegment", F.lit(": class "), k % 7)).otherwise(blank).alias("object_name"),
        F.when(k % 5 < 2, F.concat(F.floor("o_totalprice").cast("string"), F.lit(",5 %"))).otherwise(blank).alias("rate_value"),
        _pick([w for w, _ in WORDED], k).alias("payer_text"),
        F.when(k % 5 == 3, F.lower("c_mktsegment")).otherwise(blank).alias("benefit_category"), F.when(k % 5 == 4, "100 %").otherwise(blank).alias("benefit_size"),
        k.cast("string").alias("npa_number"),
    )


def _loaded(d: Domain) -> loading.Loaded:
    return loading.norms(_records(d), d.region, d.spark.createDataFrame(ALIASES, "tax_code string, alias string"), this_year=2030)


_ORDER = f"""o_ AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS st, o_orderpriority AS tax, o_totalprice AS price, c_mktsegment AS seg, {CODE.format('c_nationkey')} AS code, o_orderkey % 3 AS way FROM orders JOIN customer ON o_custkey = c_custkey),
seen_ AS (SELECT DISTINCT code FROM o_ WHERE way < 2),
rec_ AS (SELECT *, CASE WHEN way = 2 AND k % 11 = 0 THEN NULL WHEN way = 2 AND code NOT IN (SELECT code FROM seen_) THEN NULL ELSE code END AS region_code,
  CASE WHEN st = 'F' THEN y + 1 WHEN st = 'P' THEN NULL WHEN k % 4 = 0 THEN NULL ELSE y END AS year_to,
  CASE k % 4 WHEN 0 THEN 'fl' WHEN 1 THEN 'ul' WHEN 2 THEN 'ip' ELSE 'all' END AS payer FROM o_),
ok_ AS (SELECT * FROM rec_ WHERE region_code IS NOT NULL AND tax <> '4-NOT SPECIFIED')"""


@query(
    """SELECT CAST(k AS VARCHAR) AS npa_number, region_code, tax AS tax_code, y AS year, y AS year_from, year_to, payer, CAST(payer = 'fl' AS INT) AS for_fl, CAST(payer = 'ul' AS INT) AS for_ul, CAST(payer = 'ip' AS INT) AS for_ip,
    CASE WHEN k % 5 < 3 THEN seg ELSE '' END AS object_group, CASE WHEN k % 5 < 2 THEN floor(price) + 0.5 END AS rate_value FROM ok_ WHERE k % 5 < 3""",
    _ORDER,
)
def load_rates(d: Domain) -> DataFrame:
    return _loaded(d).rates.select("npa_number", "region_code", "tax_code", "year", "year_from", "year_to", "payer", "for_fl", "for_ul", "for_ip", "object_group", "rate_value")


@query(
    """SELECT CAST(k AS VARCHAR) AS npa_number, region_code, tax AS tax_code, year_to, payer, CASE WHEN k % 5 = 3 THEN lower(seg) ELSE '' END AS category, CASE WHEN k % 5 = 4 THEN '100 %' ELSE '' END AS size_text, CASE WHEN k % 5 = 4 THEN 100.0::DOUBLE END AS size_value FROM ok_ WHERE k % 5 > 2""",
    _ORDER,
)
def load_benefits(d: Domain) -> DataFrame:
    return _loaded(d).benefits.select("npa_number", "region_code", "tax_code", "year_to", "payer", "category", "size_text", "size_value")


@query(
    """SELECT DISTINCT 'unmapped_regions' AS reason, 'Nowhere land' AS value FROM rec_ WHERE way = 2 AND k % 11 = 0 UNION ALL
    SELECT DISTINCT 'unmapped_taxes', 'Tax of 4-not specified' FROM rec_ WHERE region_code IS NOT NULL AND tax = '4-NOT SPECIFIED'""",
    _ORDER,
)
def load_misses(d: Domain) -> DataFrame:
    return _loaded(d).misses


def _export(d: Domain) -> tuple[DataFrame, DataFrame]:
    o = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    pairs = lambda **kv: F.create_map(*(x for n, v in kv.items() for x in (F.lit(n), v if isinstance(v, Column) else F.lit(v))))
    flags = {"Fl": (k % 2).cast("string"), "UL": F.when(k % 3 == 0, "true").otherwise("0"), "IP": F.lit("")}
    rate = pairs(TaxObject=F.concat(F.lit("Boats:  over "), k % 9), TaxRates=F.concat(k % 50, F.lit(",5")), **flags)
    benefit = pairs(Category=F.col("c_mktsegment"), Amount=F.when(k % 4 == 0, "100").otherwise((k % 90).cast("string")), Unit=F.when(k % 4 == 1, "руб").otherwise("%"), **flags)
    rows = o.select(
        pairs(ID=k.cast("string"), Region_ID=F.concat(F.lit("r"), "c_nationkey"), Nalog_ID=F.concat(F.lit("t"), F.substring("o_orderpriority", 1, 1)), TaxPeriod=F.year("o_orderdate").cast("string"), LawNum=k.cast("string")).alias("attrs"),
        F.when(k % 6 == 0, F.array().cast("array<map<string,string>>")).otherwise(F.array(rate)).alias("tr"), F.when(k % 2 == 0, F.array(benefit, benefit)).otherwise(F.array().cast("array<map<string,string>>")).alias("tb"),
    )
    n = d.table("nation")
    listed = n.select(F.concat(F.lit("r"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(Domain.code(F.col("n_nationkey")), F.lit("-"), "n_name")).otherwise(F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(" - "), "n_name")).alias("value"))
    taxes = d.spark.createDataFrame([("t1", "By urgent"), ("t2", "By high"), ("t3", "By medium"), ("t4", "By none")], "id string, value string")
    return rows, listed.unionByName(taxes)


_EXPORT = f"""x_ AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS year, {CODE.format('c_nationkey')} AS region_code, o_orderpriority AS tax_code, c_mktsegment AS category, CAST(o_orderkey % 2 AS INT) AS for_fl, CAST(o_orderkey % 3 = 0 AS INT) AS for_ul, 0 AS for_ip,
CASE WHEN o_orderkey % 2 + CAST(o_orderkey % 3 = 0 AS INT) <> 1 THEN 'all' WHEN o_orderkey % 2 = 1 THEN 'fl' ELSE 'ul' END AS payer FROM orders JOIN customer ON o_custkey = c_custkey WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3'))"""


@query("SELECT CAST(k AS VARCHAR) AS npa_number, year, region_code, tax_code, payer, for_fl, for_ul, for_ip, 'Boats' AS object_group, 'Boats: over ' || (k % 9) AS object_name, CAST(k % 50 AS DOUBLE) + 0.5 AS rate_value FROM x_ WHERE k % 6 <> 0", _EXPORT)
def export_rates(d: Domain) -> DataFrame:
    rows, listed = _export(d)
    found = loading.norms_of_export(rows, listed, _subjects(d), d.spark.createDataFrame(ALIASES, "tax_code string, alias string"))
    return found.rates.select("npa_number", "year", "region_code", "tax_code", "payer", "for_fl", "for_ul", "for_ip", "object_group", "object_name", "rate_value")


@query(
    """SELECT CAST(k AS VARCHAR) AS npa_number, region_code, tax_code, payer, category, CASE WHEN k % 4 = 0 THEN 'Освобождение от уплаты' WHEN k % 4 = 1 THEN 'Льгота: ' || (k % 90) || ' руб' ELSE 'Пониженный размер: ' || (k % 90) || ' %' END AS kind,
    CASE WHEN k % 4 = 0 THEN 100 ELSE k % 90 END || CASE WHEN k % 4 = 1 THEN ' руб' ELSE ' %' END AS size_text FROM x_, range(2) WHERE k % 2 = 0""",
    _EXPORT,
)
def export_benefits(d: Domain) -> DataFrame:
    rows, listed = _export(d)
    found = loading.norms_of_export(rows, listed, _subjects(d), d.spark.createDataFrame(ALIASES, "tax_code string, alias string"))
    return found.benefits.select("npa_number", "region_code", "tax_code", "payer", "category", "kind", "size_text")


# ---------------------------------------------------------------- files that Spark writes from the tables, read back


def _written(rows: DataFrame) -> str:
    """The folder, below the shared one, to which a column of text is written."""
    path = session.fresh(rows.sparkSession)
    rows.write.text(path)
    return path


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS place, '№ «' || o_orderpriority || '» & > ' || o_orderstatus AS law, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n_tr, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS n_tb, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 50 AS VARCHAR) || ',5' END AS rate FROM orders"""
)
def export_scan(d: Domain) -> DataFrame:
    """An export of a record an order, in lines that do not fit the records, with entities, either quotes and records that close themselves."""
    k, o = F.col("o_orderkey"), d.table("orders")
    head = F.concat(F.lit("<junk/><tp ID='"), k.cast("string"), F.lit("' Region_ID=\"x\" Region_ID = \""), F.col("o_custkey").cast("string"), F.lit("\" LawDoc=\"&#8470; &laquo;"), "o_orderpriority", F.lit("&raquo; &amp; > "), "o_orderstatus", F.lit("\""))
    body = F.concat(F.lit(">\n<tr TaxRates='"), (k % 50).cast("string"), F.lit(",5'/><tb Amount='1'/>\n<tb\nAmount='2'></tb></tp>"))
    path = _written(o.select(F.concat(head, F.when(k % 5 == 0, "/>").otherwise(body)).alias("value")))
    at = lambda name: F.col("attrs")[name]
    return export.read_export(d.spark, path).select(at("ID").alias("id"), at("Region_ID").alias("place"), at("LawDoc").alias("law"), F.size("tr").alias("n_tr"), F.size("tb").alias("n_tb"), F.get("tr", F.lit(0))["TaxRates"].alias("rate"))


@query("SELECT doc_id, CAST(4 AS INT) AS n_cells, regexp_replace(coalesce(text, ''), '[^0-9A-Za-z]+', '', 'g') AS letters, lang, coalesce(source, '') AS source FROM documents")
def ragged_scan(d: Domain) -> DataFrame:
    """A line of cells a document, whose text, quoted, holds line ends, quotes and delimiters; names are written by url_encode, as cells are cleaned, and a null as a blank cell."""
    docs, blank = d.table("documents"), F.lit("")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", blank), F.lit('"'), F.lit('""')), F.lit('"'))
    lang = F.coalesce(F.concat(F.lit("="), F.url_encode("lang")), blank)
    path = _written(docs.select(F.concat_ws(";", F.coalesce(F.col("doc_id").cast("string"), blank), quoted, lang, F.url_encode(F.coalesce("source", blank))).alias("value")))
    rows, cell = ragged.read_ragged(d.spark, path, encoding="utf-8", delimiter=";"), F.col("cells")
    return rows.select(
        F.nullif(cell[0], blank).cast("long").alias("doc_id"), F.size("cells").alias("n_cells"), F.regexp_replace(cell[1], "[^0-9A-Za-z]+", "").alias("letters"),
        F.url_decode(F.substr(F.nullif(cell[2], blank), F.lit(2))).alias("lang"), F.url_decode(cell[3]).alias("source"),
    )


@query(
    """SELECT CAST(k AS VARCHAR) AS npa_number, region_code, tax AS tax_code, payer, floor(price) + 0.5 AS rate_value, 'year=' || y AS source_file FROM ok_ WHERE k % 5 < 2""",
    _ORDER,
)
def import_run(d: Domain) -> DataFrame:
    """Files of records for each year, each part with a title and a header of its own, found, classified, read and loaded by a run over their folder."""
    cells = [c for c in loading.FIELDS if c in _records(d).columns]
    body = _records(d).withColumn("year", F.regexp_extract(F.coalesce(F.nullif("period_year", F.lit("")), "date_from"), r"\d{4}", 0))
    lines = body.select("year", F.lit(2).alias("place"), F.concat_ws(";", *cells).alias("value"))
    titles = body.select("year").distinct().select("year", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("Title").alias("value")), F.struct(F.lit(1).alias("place"), F.lit(";".join(cells)).alias("value")))).alias("x")).select("year", "x.*")
    path = session.fresh(d.spark)
    lines.unionByName(titles).repartition("year").sortWithinPartitions("year", "place").select("year", "value").write.partitionBy("year").text(path)
    aliases = {c: [c.replace("_", " ")] for c in cells}
    found: list[DataFrame] = []

    def kinds(rows: DataFrame) -> DataFrame:
        return importing.classify(rows, _codes(d), importing.bind_headers(rows, aliases, ["region code", "rate value"]))

    def load(rows: DataFrame) -> None:
        records = importing.named_records(rows, importing.bind_headers(rows, aliases, ["region code", "rate value"]), cells)
        own = loading.norms(records.withColumn("source", F.element_at(F.split("file", "/"), -2)), d.region, d.spark.createDataFrame(ALIASES, "tax_code string, alias string"), this_year=2030, source=F.col("source"))
        found.append(session.kept(own.rates))

    importing.run(d.spark, path, d.spark.createDataFrame([], importing.LEDGER), kinds, {"rates": load})
    return found[0].where("rate_value IS NOT NULL").select("npa_number", "region_code", "tax_code", "payer", "rate_value", "source_file")


# ---------------------------------------------------------------- form files


def _form_rows(d: Domain) -> DataFrame:
    """A file of two sheets for each nation, its region in the name of every second, else in a title. The eighth has no year, the ninth no region, the tenth no known code; each fifth row lacks its second number."""
    c, k = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    n = F.col("c_nationkey")
    year = F.when(n == 8, "x").otherwise((2010 + n % 4).cast("string"))
    file = F.concat(F.lit("/in/"), year, F.lit("/5tn_"), F.when(n % 2 == 0, Domain.code(n)).otherwise("x"), F.lit("_f"), (n + 100).cast("string"), F.lit("q.xlsx"))
    code = F.concat(F.lit("0"), (F.when(n == 10, 500).otherwise(100) * (k % 4 + 1)).cast("string"))
    numbers = F.when(k % 5 == 0, F.array(k.cast("string"))).otherwise(F.array(k.cast("string"), F.concat((k * 2).cast("string"), F.lit(",0"))))
    body = c.select(file.alias("file"), F.when(k % 2 == 0, "second").otherwise("first").alias("table"), (k % 2).cast("int").alias("table_at"), (k + 30).alias("row_idx"), F.concat(F.array("c_name", code), numbers).alias("cells"))
    title = c.select(file.alias("file"), F.lit("second").alias("table"), F.lit(0).alias("table_at"), F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("по форме"), F.concat(F.lit("по "), F.when(n == 9, "форме").otherwise(F.initcap("n_name")))).alias("cells")).distinct()
    return body.unionByName(title)


def _file_number() -> Column:
    return (F.regexp_extract("file", r"_f(\d+)q", 1).cast("int") - 100).alias("n")


def _codes(d: Domain) -> DataFrame:
    rows = [("tn", y, p, str(100 * i), c, i) for y in (2010, 2011, 2012) for i in (1, 2, 3) for p, c in (("ul", 1), ("fl", 2))]
    return d.spark.createDataFrame(rows, "tax_code string, year int, payer string, row_code string, col_index int, indicator_id int")


_FORM = f"""f_ AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_nationkey <> 8 THEN 2010 + c_nationkey % 4 END AS year, CASE WHEN c_nationkey <> 9 THEN {CODE.format('c_nationkey')} END AS region_code, c_custkey % 4 + 1 AS ind, c_nationkey <> 10 AS known FROM customer)"""


@query(
    """SELECT CAST(year AS INT) AS year, region_code, 'tn' AS tax_code, CAST(ind AS INT) AS indicator_id, payer, CAST(arg_max(k * CASE payer WHEN 'ul' THEN 1 ELSE 2 END, (k % 2) * 1000000000 + k) AS DOUBLE) AS value
    FROM f_, (VALUES ('ul'), ('fl')) p(payer) WHERE year < 2013 AND region_code IS NOT NULL AND known AND ind < 4 AND (payer = 'ul' OR k % 5 <> 0) GROUP BY ALL""",
    _FORM,
)
def load_forms(d: Domain) -> DataFrame:
    found, _ = loading.forms(_form_rows(d), _codes(d), _subjects(d), "tn")
    return found.drop("source_file")


_PROBLEM = "CASE WHEN year IS NULL THEN 'no year' WHEN region_code IS NULL THEN 'no region' WHEN year = 2013 THEN 'no codes for the year' WHEN NOT known THEN 'no known code' END"


@query(f"SELECT DISTINCT CAST(n AS INT) AS n, {_PROBLEM} AS problem FROM f_ WHERE {_PROBLEM} IS NOT NULL", _FORM)
def form_problems(d: Domain) -> DataFrame:
    _, problems = loading.forms(_form_rows(d), _codes(d), _subjects(d), "tn")
    return problems.select(_file_number(), "problem")


@query(
    f"""SELECT CAST(n AS INT) AS n, count(*) + 1 AS rows_read, CAST(CASE WHEN {_PROBLEM} IS NULL THEN count(DISTINCT ind) FILTER (ind < 4) + count(DISTINCT ind) FILTER (ind < 4 AND k % 5 <> 0) ELSE 0 END AS BIGINT) AS \"values\", {_PROBLEM} AS problem,
    CASE WHEN {_PROBLEM} = 'no known code' THEN array_to_string(list_sort(list_distinct(list_concat(list(CAST(k AS VARCHAR)) FILTER (k BETWEEN 100 AND 9999 AND k NOT IN (100, 200, 300)), list('0500') FILTER (ind = 1))))[:20], ',') ELSE '' END AS unknown
    FROM (SELECT n, k, ind, year, region_code, known FROM f_) GROUP BY n, year, region_code, known""",
    _FORM,
)
def form_statistics(d: Domain) -> DataFrame:
    rows = _form_rows(d)
    found, problems = loading.forms(rows, _codes(d), _subjects(d), "tn")
    stats = loading.form_stats(rows, found, problems, _codes(d))
    return stats.select(_file_number(), "rows_read", "values", "problem", F.array_join("unknown_codes", ",").alias("unknown"))


@query("SELECT DISTINCT n AS n, CAST(year AS INT) AS year, region_code FROM f_", _FORM)
def guess_places(d: Domain) -> DataFrame:
    return loading.guess_places(_form_rows(d), _subjects(d)).select(_file_number(), "year", "region_code")


@query("SELECT CAST(n AS INT) AS n, CASE WHEN count(DISTINCT CASE WHEN ind < 4 AND known THEN ind END) >= 3 THEN 'forms' ELSE 'unknown' END AS kind, CASE WHEN kind = 'forms' THEN 'tn' END AS tax FROM f_ GROUP BY 1", _FORM)
def classify_files(d: Domain) -> DataFrame:
    rows = _form_rows(d).withColumn("row_idx", F.col("row_idx") % 2000).withColumn("table", F.lit("own")).withColumn("table_at", F.lit(0))
    none = d.spark.createDataFrame([], "file string, fields array<string>")
    codes = _codes(d).unionByName(d.spark.createDataFrame([("tn", 2010, "ul", c, 1, 9) for c in ("9001", "9002")], _codes(d).schema))
    added = lambda table, at, idx, code: rows.select("file", F.lit(table).alias("table"), F.lit(at).alias("table_at"), F.lit(idx).cast("long").alias("row_idx"), F.array(F.lit("x"), F.lit(code)).alias("cells")).distinct()
    later = added("a later one", 1, 5, "9001").unionByName(added("own", 0, 5_000_000, "9001"))  # neither another table's rows nor those beyond the first are looked at
    extra = added("own", 0, 5, "9001").unionByName(added("own", 0, 6, "9002"))
    return importing.classify(rows.unionByName(later).unionByName(extra), codes, none).select(_file_number(), "kind", "tax")


# ---------------------------------------------------------------- methodology


def _map(d: Domain) -> DataFrame:
    p, k = d.table("part"), F.col("p_partkey")
    return p.select(
        F.lit("tn").alias("tax_code"), (2010 + k % 3).cast("int").alias("year"), F.substring("p_brand", 7, 1).alias("section"), (k % 2).cast("int").alias("level"), F.when(k % 2 == 1, F.col("p_type")).alias("group"), F.col("p_name").alias("name"),
        F.concat(F.lit("s"), k % 40).alias("slug"), F.lit("ed").alias("unit"), F.when(k % 5 != 0, (100 + k % 400).cast("string")).alias("code_ul"), F.when(k % 7 != 0, (100 + k % 300).cast("string")).alias("code_fl"), F.lit(1).alias("col_ul"), F.lit(2).alias("col_fl"), k.cast("int").alias("sort_order"),
    )


_MAP = """m_ AS (SELECT 's' || (p_partkey % 40) AS slug, CAST(2010 + p_partkey % 3 AS INT) AS year, substr(p_brand, 7, 1) AS section, CAST(p_partkey % 2 AS INT) AS level, CASE WHEN p_partkey % 2 = 1 THEN p_type || ': ' ELSE '' END || p_name AS name, CAST(p_partkey AS INT) AS place, p_partkey AS k FROM part)"""


@query("SELECT 'tn' AS tax_code, slug, name, section, 'ed' AS unit, level, CAST(place + CASE WHEN year < (SELECT max(year) FROM m_) THEN 10000 ELSE 0 END AS INT) AS sort_order FROM m_ QUALIFY row_number() OVER (PARTITION BY slug ORDER BY year DESC, place DESC) = 1", _MAP)
def methodology_indicators(d: Domain) -> DataFrame:
    return methodology.indicators(_map(d))


@query(
    """SELECT 'tn' AS tax_code, year, payer, code AS row_code, CASE payer WHEN 'ul' THEN 1 ELSE 2 END AS col_index, CAST(substr(slug, 2) AS INT) AS indicator_id FROM (
    SELECT year, 'ul' AS payer, CAST(100 + k % 400 AS VARCHAR) AS code, slug, place FROM m_ WHERE k % 5 <> 0 UNION ALL SELECT year, 'fl', CAST(100 + k % 300 AS VARCHAR), slug, place FROM m_ WHERE k % 7 <> 0)
    QUALIFY row_number() OVER (PARTITION BY year, payer, code ORDER BY place DESC) = 1""",
    _MAP,
)
def methodology_codes(d: Domain) -> DataFrame:
    known = methodology.indicators(_map(d)).select("tax_code", "slug", F.substring("slug", 2, 9).cast("int").alias("id"))
    return methodology.codes(_map(d), known).select("tax_code", "year", "payer", "row_code", "col_index", "indicator_id")


_SHEET = ["Показатель (наименование)", "Код строки юл", "Код строки фл", "Столбец для юридических лиц"]


def _sheets(d: Domain) -> DataFrame:
    """A sheet for each of three years: a title, a header, and a row for each part, of which each eleventh has a number."""
    p, k = d.table("part"), F.col("p_partkey")
    title = F.concat((2010 + k % 3).cast("string"), F.lit(" - form"))
    name = F.when(k % 11 == 0, F.concat((k % 5 + 1).cast("string"), F.lit(". "), "p_brand", F.lit(" "), "p_size")).otherwise(F.concat(F.initcap("p_name"), F.when(k % 6 == 0, "  и др.").otherwise("")))
    rows = p.select(title.alias("table"), (k + 5).alias("row_idx"), F.array(name, F.when(k % 7 == 0, "").otherwise(F.concat((1000 + k % 997).cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))), F.when(k % 3 == 0, "").otherwise((2000 + k % 991).cast("string")), F.when(k % 4 == 0, "1").otherwise("")).alias("cells"))
    head = lambda at, cells: p.select(title.alias("table"), F.lit(at).cast("long").alias("row_idx"), F.array(*map(F.lit, cells)).alias("cells")).distinct()
    return rows.unionByName(head(0, ["Методичка"])).unionByName(head(2, _SHEET)).withColumn("file", F.lit("m.xlsx"))


@query(
    """SELECT 'tn' AS tax_code, year, section, level, "group", name, CASE WHEN other > 0 THEN base || '--' || (1 + sum(other) OVER (PARTITION BY year, base ORDER BY k ROWS UNBOUNDED PRECEDING)) ELSE base END AS slug,
    CASE WHEN section IN ('1', '2', '3') THEN 'единиц' WHEN section IN ('4', '5') THEN 'тыс. руб.' END AS unit, nullif(code_ul, '') AS code_ul, nullif(code_fl, '') AS code_fl, CASE WHEN k % 4 = 0 THEN 1 END AS col_ul, CAST(NULL AS INT) AS col_fl, CAST(sort_order AS INT) AS sort_order
    FROM (SELECT *, CAST(name <> first_value(name) OVER (PARTITION BY year, base ORDER BY k) AS INT) AS other FROM (
      SELECT *, substr('s' || coalesce(section, '0') || '--' || CASE WHEN several AND "group" IS NOT NULL THEN replace(gkey, ' ', '-') || '--' ELSE '' END || replace(key, ' ', '-'), 1, 180) AS base FROM lev_
      JOIN (SELECT section AS s_, key AS k_, count(DISTINCT gkey) > 1 AS several FROM lev_ GROUP BY ALL) ON s_ IS NOT DISTINCT FROM section AND k_ = key))""",
    """raw_ AS (SELECT p_partkey AS k, CAST(2010 + p_partkey % 3 AS INT) AS year, CASE WHEN p_partkey % 11 = 0 THEN CAST(p_partkey % 5 + 1 AS VARCHAR) END AS number, CASE WHEN p_partkey % 11 = 0 THEN p_brand || ' ' || p_size ELSE
      list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || CASE WHEN p_partkey % 6 = 0 THEN ' и др.' ELSE '' END END AS name,
      CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(1000 + p_partkey % 997 AS VARCHAR) END AS code_ul, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(2000 + p_partkey % 991 AS VARCHAR) END AS code_fl FROM part),
    ev_ AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY k) AS sort_order, last_value(number IGNORE NULLS) OVER (PARTITION BY year ORDER BY k ROWS UNBOUNDED PRECEDING) AS section,
      number IS NOT NULL AND row_number() OVER (PARTITION BY year, number ORDER BY k) = 1 AS starts, coalesce(nullif(code_ul, ''), code_fl) LIKE '%0' AS round FROM raw_ WHERE code_ul <> '' OR code_fl <> ''),
    op_ AS (SELECT *, CASE WHEN starts THEN '' WHEN number IS NOT NULL THEN name WHEN round THEN '' END AS event FROM ev_),
    st_ AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY year ORDER BY k ROWS UNBOUNDED PRECEDING), '') AS open FROM op_),
    lv_ AS (SELECT *, CAST(CASE WHEN starts THEN 0 WHEN number IS NOT NULL THEN 2 WHEN event IS NOT NULL OR open = '' THEN 1 ELSE 3 END AS INT) AS level FROM st_),
    lev_ AS (SELECT *, CASE WHEN level = 3 THEN open END AS "group", trim(regexp_replace(lower(name), '[^0-9a-zа-я]+', ' ', 'g')) AS key, CASE WHEN level = 3 THEN trim(regexp_replace(lower(open), '[^0-9a-z]+', ' ', 'g')) ELSE '' END AS gkey FROM lv_)""",
)
def methodology_scan(d: Domain) -> DataFrame:
    return methodology.scan_workbook(_sheets(d), "tn")


# ---------------------------------------------------------------- service


@query("SELECT c_custkey AS code, c_name AS name, CAST(c_nationkey AS INT) AS sort_order FROM customer ORDER BY c_nationkey, c_name, c_custkey")
def taxes_ordered(d: Domain) -> DataFrame:
    return service.taxes(d.table("customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("sort_order")))


@query("SELECT 'customer' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def meta_counts(d: Domain) -> DataFrame:
    return service.meta(**{t: d.table(t) for t in ("customer", "orders", "part", "events")})


@query("SELECT event_id AS id, event_type AS kind FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_loads(d: Domain) -> DataFrame:
    log = d.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("loaded_at"), F.col("event_type").alias("kind"))
    return service.last_loads(log).select("id", "kind")


@query("SELECT DISTINCT r_name AS federal_district FROM region UNION SELECT 'ALL'")
def districts(d: Domain) -> DataFrame:
    return service.districts(d.region)


@query("SELECT code, name FROM region_ WHERE lower(name) LIKE '%1%' OR code LIKE '%1%'", REGION)
def region_filter(d: Domain) -> DataFrame:
    return service.regions_like(d.region, " 1").select("code", "name")


@query(
    f"""SELECT region_code, region_name, rates, municipalities, n_total AS benefits, n_fl, n_ul, n_ip, n_all, n_total, (SELECT count(DISTINCT indicator_id) FROM total_ WHERE tax_code = '{TAX}' AND year = {YEAR} AND region_code = region AND indicator_id < 3) AS key_indicators,
    (SELECT len(list_distinct(list(y))) FROM (SELECT year AS y FROM fact_ WHERE tax_code = '{TAX}' UNION ALL SELECT year_from FROM norm_ WHERE tax_code = '{TAX}')) AS years FROM (
    SELECT code AS region_code, code AS region, any_value(name) AS region_name, count(*) AS rates, count(DISTINCT coalesce(oktmo, '')) AS municipalities, sum(for_fl) AS n_fl, sum(for_ul) AS n_ul, CAST(sum(for_ip) AS HUGEINT) AS n_ip, count(*) FILTER (payer = 'all') AS n_all, count(*) AS n_total
    FROM norm_ JOIN region_ ON region_code = code WHERE {_PICK} AND code = '03' GROUP BY 1)""",
    REGION, FACT, NORM,
)
def profile(d: Domain) -> DataFrame:
    indicator = d.indicator.withColumn("level", (F.col("id") > 2).cast("int"))
    out = service.profile(d.fact, d.norm, d.norm, d.region, indicator, TAX, YEAR, "03")
    return out.withColumn("years", F.size("years"))


_PAYERS = ("ul", "fl", "total")
_WIDE = lambda names: ", ".join(f"max(CASE WHEN payer = '{p}' THEN {v} END) AS \"{p}_{names[c]}\"" for p in _PAYERS for c, v in (("value", "value"), ("avg", "round(avg, 4)"), ("rank", "rank")))


@query("SELECT section, name AS indicator, unit, " + _WIDE(exports.SHOWN) + " FROM indicator_ i JOIN own_ ON i.id = indicator_id GROUP BY section, name, unit, i.id", REGION, INDICATOR, FACT, _STATS)
def export_form(d: Domain) -> DataFrame:
    return exports.form(d.fact, d.region, d.indicator, TAX, YEAR, RF)


@query("SELECT i.id AS indicator_id, section, name, unit, sort_order, " + _WIDE({"value": "value", "avg": "avg", "rank": "rank"}) + " FROM indicator_ i JOIN own_ ON i.id = indicator_id WHERE i.id < 3 GROUP BY 1, 2, 3, 4, 5", REGION, INDICATOR, FACT, _STATS)
def key_indicators(d: Domain) -> DataFrame:
    return service.key_indicators(d.fact, d.region, d.indicator.withColumn("level", (F.col("id") > 2).cast("int")), TAX, YEAR, RF)


@query(
    f"SELECT id, year, year_from, year_to, oktmo, NULL::VARCHAR AS mo_name, payer, NULL::VARCHAR AS payer_text, object_name, rate_value, NULL::VARCHAR AS rate_text FROM norm_ WHERE {_PICK} AND region_code = '03' AND for_ul = 1 AND lower(object_name) LIKE '%a%' ORDER BY coalesce(object_group, object_name) NULLS FIRST, object_name NULLS FIRST, rate_value, id LIMIT 100000",
    NORM,
)
def export_rate_rows(d: Domain) -> DataFrame:
    norm = d.norm.withColumns({c: F.lit(None).cast("string") for c in ("mo_name", "payer_text", "npa_name")})
    return exports.rates(norm, TAX, YEAR, "03", "ul", "A").select("id", "year", "year_from", "year_to", "oktmo", "mo_name", "payer", "payer_text", "object_name", "rate_value", "rate_text")


@query("SELECT c_custkey AS code, CASE WHEN c_custkey >= 0 AND c_custkey % 2 = 0 OR c_custkey < 0 AND c_custkey % 2 <> 0 THEN 'new ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 5 THEN -1 ELSE c_nationkey END AS valid_from FROM (SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT -c_custkey - 1, c_name, 5 FROM customer WHERE c_custkey % 3 = 0)")
def dimension_refresh(d: Domain) -> DataFrame:
    """Known customers get new names and keep their bound; others come in as they are."""
    c = d.table("customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("valid_from"))
    k = F.col("code")
    old = c.withColumn("valid_from", F.when(k % 6 == 5, -1).otherwise(F.col("valid_from")))
    new = c.where(k % 2 == 0).select("code", F.concat(F.lit("new "), "name").alias("name"), F.lit(99).alias("valid_from")).unionByName(c.where(k % 3 == 0).select((-k - 1).alias("code"), F.when(k % 2 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")).alias("name"), F.lit(5).alias("valid_from")))
    return catalog.refresh(old, new, ["code"], ["valid_from"])


@query(f"SELECT id, region_code, payer, category, (SELECT count(*) FROM norm_ WHERE {_PICK}) AS total FROM norm_ WHERE {_PICK} ORDER BY payer, category, id LIMIT 50 OFFSET 5", NORM)
def benefits_total(d: Domain) -> DataFrame:
    return norms.with_total(norms.select_norms(d.norm, [], TAX, None, YEAR), norms.BENEFIT_ORDER, 50, 5).select("id", "region_code", "payer", "category", "total")


@query(f"SELECT indicator_id, year, value FROM total_ WHERE tax_code = '{TAX}' AND payer = 'total' AND region_code = '{RF}' AND indicator_id IN (1, 2)", REGION, FACT)
def series_flat(d: Domain) -> DataFrame:
    points = facts.series(d.fact, d.region, d.indicator, TAX, RF, [1, 2])
    return service.flat_series(service.nested_series(points)).select("indicator_id", "year", "value")


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","none":null}' AS json FROM customer""")
def json_rows(d: Domain) -> DataFrame:
    return service.as_json(d.table("customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("none")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '—' WHEN p_partkey * 37 >= 1000 THEN replace(format('{:,}', p_partkey * 37), ',', ' ') ELSE CAST(p_partkey * 37 AS VARCHAR) || '.5' END AS shown, CASE WHEN length(p_name) > 12 THEN rtrim(substr(p_name, 1, 11)) || '…' ELSE p_name END AS short FROM part")
def shown_values(d: Domain) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 10 == 0, None).when(k * 37 >= 1000, k * 37.0).otherwise(k * 37 + 0.5)
    return d.table("part").select("p_partkey", service.shown_number(value).alias("shown"), service.shortened(F.col("p_name"), 12).alias("short"))


@query("SELECT id, payer, CAST(payer = 'fl' AS INT) AS for_fl, CAST(payer = 'ul' AS INT) AS for_ul, 0 AS for_ip, split_part(object_name, ':', 1) AS object_group FROM norm_", NORM)
def migrate_flags(d: Domain) -> DataFrame:
    return service.with_flags(d.norm.select("id", "payer", "object_name")).drop("object_name")


@query(f"SELECT region_code, coalesce(name, region_code) AS region_name, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 'zz' ELSE region_code END AS region_code FROM norm_ WHERE {_VALID}) LEFT JOIN region_ ON code = region_code GROUP BY 1, 2", REGION, NORM)
def region_names(d: Domain) -> DataFrame:
    rows = d.norm.where(norms.valid_in(YEAR)).select(F.when(F.col("id") % 9 == 0, "zz").otherwise(F.col("region_code")).alias("region_code"))
    return service.region_name(rows.groupBy("region_code").agg(F.count(F.lit(1)).alias("n")), d.region)


@query("SELECT CAST(p_size AS VARCHAR) AS cell FROM (SELECT DISTINCT 1000 + p_size AS p_size FROM part) WHERE p_size > 1025")
def codes_unknown(d: Domain) -> DataFrame:
    cells = d.table("part").select(F.array("p_name", (1000 + F.col("p_size")).cast("string")).alias("cells"))
    return resolve.unknown_codes(cells, d.spark.range(1000, 1026).select(F.concat(F.lit("0"), F.col("id").cast("string")).alias("row_code")))


@query("SELECT 'p' AS file, 't' AS \"table\", CAST(row_number() OVER (ORDER BY f DESC, k) - 1 AS INT) AS place, k AS row_idx, f AS fields FROM (SELECT p_partkey AS k, CAST(p_name LIKE '%a%' AS BIGINT) + CAST(lower(p_type) LIKE '%steel%' AS BIGINT) AS f FROM part WHERE p_partkey < 40) WHERE f > 0 ORDER BY f DESC, k LIMIT 5")
def header_candidates(d: Domain) -> DataFrame:
    rows = d.table("part").select(F.lit("p").alias("file"), F.lit("t").alias("table"), F.col("p_partkey").alias("row_idx"), F.array("p_name", "p_type").alias("cells"))
    names = rows.select("file", "table", "row_idx", F.array(F.get("cells", F.lit(0)), F.replace(F.get("cells", F.lit(1)), F.lit("A"), F.lit("e"))).alias("cells"))
    return report.header_candidates(names, d.spark.createDataFrame([("first", "a"), ("second", "steel")], "field string, alias string"))


@query("SELECT 's' AS file, CAST(p_size AS VARCHAR) AS \"table\", count(*) AS n_rows, CAST(max(len(string_split(p_name, ' '))) AS INT) AS width FROM part GROUP BY p_size")
def source_shape(d: Domain) -> DataFrame:
    rows = d.table("part").select(F.lit("s").alias("file"), F.col("p_size").cast("string").alias("table"), F.col("p_partkey").alias("row_idx"), F.split("p_name", " ").alias("cells"))
    return report.describe(rows).select("file", "table", "n_rows", "width")


@query("SELECT y, 24 AS rows_a_subject, CAST(count(*) * 8 AS BIGINT) AS n, true AS positive FROM nation, range(2018, 2021) t(y) GROUP BY y")
def made_up_facts(d: Domain) -> DataFrame:
    rows = report.made_up(d.spark, d.region, d.indicator, 2018, 2020)
    return rows.groupBy(F.col("year").cast("long").alias("y")).agg(F.lit(24).alias("rows_a_subject"), F.count(F.lit(1)).alias("n"), (F.min("value") > 0).alias("positive"))


@query(
    """SELECT CAST(p_size AS VARCHAR) AS "table", min_by(k, (-w, k)) AS row_idx, -min(-w) AS width FROM (SELECT p_size, p_partkey AS k, len(string_split(p_name, ' ')) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS w FROM part) GROUP BY p_size"""
)
def widest_rows(d: Domain) -> DataFrame:
    k, name = F.col("p_partkey"), F.split("p_name", " ")
    rows = d.table("part").select(F.lit("s").alias("file"), F.col("p_size").cast("string").alias("table"), k.alias("row_idx"), F.when(k % 3 == 0, F.array_append(name, F.lit("more"))).otherwise(name).alias("cells"))
    return shape.widest_row(rows).select("table", "row_idx", F.size("cells").cast("long").alias("width"))


@query(
    f"""SELECT indicator_id, year, {", ".join(f"max(CASE WHEN payer = '{p}' THEN value END) AS {p}_value, max(CASE WHEN payer = '{p}' THEN round(avg, 4) END) AS {p}_avg, max(CASE WHEN payer = '{p}' THEN rank END) AS {p}_rank" for p in ("ul", "fl", "total"))} FROM (
    SELECT t.*, s.avg, CAST(len(list_filter(vs, lambda v: v > t.value)) + 1 AS INT) AS rank FROM total_ t LEFT JOIN (SELECT indicator_id, year, payer, avg(value) AS avg, list(value) AS vs FROM subject_ WHERE tax_code = '{TAX}' GROUP BY ALL) s USING (indicator_id, year, payer) WHERE tax_code = '{TAX}' AND region_code = '03') GROUP BY 1, 2""",
    REGION, FACT,
)
def form_wide(d: Domain) -> DataFrame:
    by = ["indicator_id", "year", "payer"]
    rows = facts.payer_totals(d.fact.where(F.col("tax_code") == TAX))
    ranked = facts.ranked(rows.where("region_code = '03'").select(*by, "value"), facts.subject_stats(rows, d.region, by), by)
    return shape.wide_for_export(ranked.withColumn("avg", facts.round4(F.col("avg"))), ["indicator_id", "year"])


@query("SELECT id AS indicator_id, name FROM indicator_ i WHERE lower(name) LIKE '%e%' AND EXISTS (SELECT 1 FROM own_ WHERE indicator_id = i.id AND payer = 'total' AND value IS NOT NULL)", REGION, INDICATOR, FACT, _STATS)
def filled_rows(d: Domain) -> DataFrame:
    return service.filled(facts.form_table(d.fact, d.region, d.indicator, TAX, YEAR, RF), " E ").select("indicator_id", "name")


# ---------------------------------------------------------------- terms

_BOTH = """pair_ AS (SELECT a.tax_code, a.year, a.region_code, a.payer, a.term || ' ' || b.term AS term, count(*) AS term_freq, count(DISTINCT a.doc_id) AS doc_freq, 1 AS is_bigram FROM word_ a JOIN word_ b ON a.doc_id = b.doc_id AND a.year = b.year AND b.pos = a.pos + 1 GROUP BY ALL),
both_ AS (SELECT tax_code, year, region_code, payer, term, term_freq, doc_freq, is_bigram FROM count_ UNION ALL SELECT tax_code, year, region_code, payer, term, term_freq, doc_freq, is_bigram FROM pair_),
all_ AS (SELECT * FROM both_ UNION ALL SELECT tax_code, year, '00', payer, term, sum(term_freq), sum(doc_freq), is_bigram FROM both_ GROUP BY tax_code, year, payer, term, is_bigram)"""


@query("SELECT tax_code, year, region_code, payer, term, CAST(term_freq AS BIGINT) AS term_freq, CAST(doc_freq AS BIGINT) AS doc_freq, is_bigram, term AS display FROM all_ QUALIFY row_number() OVER (PARTITION BY tax_code, year, region_code, payer ORDER BY term_freq DESC, doc_freq DESC, term) <= 400", TEXT, YEARS, WORDS, COUNTS, _BOTH)
def cube_unstemmed(d: Domain) -> DataFrame:
    return terms.build_cube(d.text, STOPS, LAST, stem=False)


#: The tables' texts have no Cyrillic, and no other words are stemmed.
ORACLES["stem_terms"] = ORACLES["cube_unstemmed"]


@query("SELECT DISTINCT unnest(list_concat([lower(p_type)], list_filter(regexp_extract_all(lower(p_type), '[a-z0-9][a-z0-9-]*', 0), lambda x: length(x) > 1))) AS word FROM part UNION SELECT 'own'")
def stop_forms(d: Domain) -> DataFrame:
    return terms.stop_forms(d.table("part").select(F.col("p_type").alias("word")), ["own"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ul' WHEN o_orderkey % 3 = 1 THEN 'fl' ELSE 'ip' END AS payer FROM orders")
def payer_of_texts(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    rows = d.table("orders").select("o_orderkey", F.when(k % 3 == 0, "для всех").otherwise("").alias("a"), F.when(k % 3 == 0, "Предприятия и граждане").when(k % 3 == 1, "многодетные семьи").otherwise("Граждане, индивидуальные предприниматели").alias("b"))
    return loading.payer_of(rows, ["a", "b"]).select("o_orderkey", "payer")


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^0-9a-z]+', ' ', 'g') || ' o 5 e 1 2 m2 краи' AS key FROM part")
def norm_key_decomposed(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.norm_key(F.concat("p_type", F.lit(" № 5 é ½ m² край"))).alias("key"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m = 1 THEN flag ELSE flag || '--' || m END AS flag FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey, flag ORDER BY first) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS first FROM lineitem))")
def slug_collisions(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"), "l_linestatus")
    return shape.suffix_collisions(rows, ["l_orderkey", "flag"], "l_linestatus", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "flag")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'fl' ELSE 'ul' END AS payer FROM part")
def payer_wordings(d: Domain) -> DataFrame:
    said = F.when(F.col("p_size") % 2 == 0, "Ветераны и инвалиды").otherwise("Учреждения, граждане")
    return russian.over_distinct(d.table("part").select("p_partkey", said.alias("said")), "said", russian.payer_udf, "payer").select("p_partkey", "payer")
