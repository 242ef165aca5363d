"""Queries over the driver's tables, one or more for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levylens.functions import russian, text
from levylens.operators import catalog, facts, norms, resolve, shape, terms
from levylens.sources import markup
from levylens.streaming import ingest

from . import bridge
from .bridge import COUNTS, FACT, INDICATOR, NORM, REGION, STOPS, TEXT, WORDS, YEARS, Domain

TAX, YEAR, RF = "1-URGENT", 1996, "00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LAST = 2030


def query(sql: str | None = None, *parts: str):
    """Registers a function of a Domain, with SQL after its common table expressions."""

    def put(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return f

    return put


# ---------------------------------------------------------------- facts


@query("SELECT year, region_code, tax_code, indicator_id, payer, value FROM total_", REGION, FACT)
def facts_total(d: Domain) -> DataFrame:
    return facts.payer_totals(d.fact)


@query("SELECT year, indicator_id, payer, round(avg(value), 4) AS avg, round(median(value), 4) AS median, min(value) AS min, max(value) AS max, count(*) AS n FROM subject_ GROUP BY ALL", REGION, FACT)
def subject_stats(d: Domain) -> DataFrame:
    by = ["year", "indicator_id", "payer"]
    r = facts.subject_stats(facts.payer_totals(d.fact), d.region, by)
    return r.select(*by, facts.round4(F.col("avg")).alias("avg"), facts.round4(F.col("median")).alias("median"), "min", "max", "n")


_STATS = f"""s_ AS (SELECT indicator_id, payer, avg(value) AS avg, list(value) AS vs FROM subject_ WHERE tax_code = '{TAX}' AND year = {YEAR} GROUP BY ALL),
own_ AS (SELECT t.indicator_id, t.payer, t.value, s.avg, CAST(len(list_filter(vs, lambda v: v > t.value)) + 1 AS INT) AS rank FROM total_ t LEFT JOIN s_ s USING (indicator_id, payer) WHERE tax_code = '{TAX}' AND year = {YEAR} AND region_code = '{RF}')"""


@query(
    "SELECT i.id AS indicator_id, section, name, unit, sort_order, " + ", ".join(f"max(CASE WHEN payer = '{p}' THEN value END) AS {p}_value, max(CASE WHEN payer = '{p}' THEN round(avg, 4) END) AS {p}_avg, max(CASE WHEN payer = '{p}' THEN rank END) AS {p}_rank" for p in ("ul", "fl", "total")) + " FROM indicator_ i JOIN own_ ON i.id = indicator_id GROUP BY 1, 2, 3, 4, 5",
    REGION, INDICATOR, FACT, _STATS,
)
def form_table(d: Domain) -> DataFrame:
    return facts.form_table(d.fact, d.region, d.indicator, TAX, YEAR, RF)


@query(
    f"""SELECT i.id AS indicator_id, y.year, i.name, o.value, round(s.avg, 4) AS avg, round(s.median, 4) AS median, CASE WHEN s.avg <> 0 THEN round(o.value / s.avg, 4) END AS ratio,
    CASE WHEN s.avg <> 0 AND o.value IS NOT NULL THEN CAST(len(list_filter(s.vs, lambda v: v > o.value)) + 1 AS INT) END AS rank, coalesce(s.n, 0) AS n
    FROM indicator_ i CROSS JOIN (SELECT DISTINCT year FROM total_ WHERE tax_code = '{TAX}') y
    LEFT JOIN (SELECT * FROM total_ WHERE tax_code = '{TAX}' AND payer = 'total' AND region_code = '03') o ON o.indicator_id = i.id AND o.year = y.year
    LEFT JOIN (SELECT indicator_id, year, avg(value) AS avg, median(value) AS median, list(value) AS vs, count(*) AS n FROM subject_ WHERE tax_code = '{TAX}' AND payer = 'total' GROUP BY 1, 2) s ON s.indicator_id = i.id AND s.year = y.year WHERE i.id IN (1, 2)""",
    REGION, INDICATOR, FACT,
)
def series_points(d: Domain) -> DataFrame:
    return facts.series(d.fact, d.region, d.indicator, TAX, "03", [1, 2])


@query(f"SELECT region_code, region_name, value FROM subject_ WHERE tax_code = '{TAX}' AND year = {YEAR} AND indicator_id = 2 AND payer = 'total' ORDER BY value DESC, region_code LIMIT 100", REGION, FACT)
def ranking_top(d: Domain) -> DataFrame:
    return facts.ranking(d.fact, d.region, TAX, YEAR, 2)


@query(
    """SELECT t.year, t.region_code, t.tax_code, t.indicator_id, t.payer, t.value, CAST(1 + (SELECT count(*) FROM subject_ s WHERE s.year = t.year AND s.tax_code = t.tax_code AND s.indicator_id = t.indicator_id AND s.payer = t.payer AND s.value > t.value) AS INT) AS rank FROM total_ t""",
    REGION, FACT,
)
def rank_vs_subjects(d: Domain) -> DataFrame:
    rows, by = facts.payer_totals(d.fact), ["year", "tax_code", "indicator_id", "payer"]
    return facts.ranked(rows, facts.subject_stats(rows, d.region, by), by).select("year", "region_code", "tax_code", "indicator_id", "payer", "value", "rank")


@query(f"SELECT region_code, payer, indicator_id, value, round(value * 100 / sum(value) OVER (PARTITION BY region_code, payer), 4) AS share FROM total_ WHERE tax_code = '{TAX}' AND year = {YEAR} AND indicator_id IN (1, 3, 4)", REGION, FACT)
def structure_share(d: Domain) -> DataFrame:
    rows = facts.payer_totals(d.fact).where((F.col("tax_code") == TAX) & (F.col("year") == YEAR) & F.col("indicator_id").isin(1, 3, 4))
    return facts.structure_share(rows.select("region_code", "payer", "indicator_id", "value"), ["region_code", "payer"])


# ---------------------------------------------------------------- catalogue


@query(
    f"""SELECT code, name, federal_district, kind, CAST(EXISTS (SELECT 1 FROM fact_ f WHERE f.region_code = code AND f.tax_code = '{TAX}' AND f.year = {YEAR}) AS INT) AS has_stats,
    CAST(EXISTS (SELECT 1 FROM norm_ f WHERE f.region_code = code AND f.tax_code = '{TAX}' AND rate_value > 400000) AS INT) AS has_rates, CAST(EXISTS (SELECT 1 FROM norm_ f WHERE f.region_code = code AND f.tax_code = '{TAX}' AND payer = 'all') AS INT) AS has_benefits FROM region_""",
    REGION, FACT, NORM,
)
def region_presence(d: Domain) -> DataFrame:
    return catalog.regions(d.region, d.fact, d.norm.where("rate_value > 400000"), d.norm.where("payer = 'all'"), TAX, YEAR)


@query("SELECT DISTINCT year FROM (SELECT year FROM fact_ UNION SELECT year_from FROM norm_ UNION SELECT year FROM norm_) WHERE year IS NOT NULL", REGION, FACT, NORM)
def years_union(d: Domain) -> DataFrame:
    return catalog.years(d.fact, d.norm, d.norm)


@query(f"SELECT * FROM indicator_ i WHERE EXISTS (SELECT 1 FROM fact_ WHERE indicator_id = i.id AND year = {YEAR} AND value > 100000)", REGION, INDICATOR, FACT)
def indicators_for_year(d: Domain) -> DataFrame:
    return catalog.indicators(d.indicator, d.fact.where("value > 100000").select("indicator_id", "year"), year=YEAR)


@query("SELECT tax_code, min(year) AS year_min, max(year) AS year_max, count(DISTINCT region_code) AS regions, count(*) AS n_rows FROM fact_ GROUP BY 1", REGION, FACT)
def catalog_stats(d: Domain) -> DataFrame:
    return catalog.meta(d.fact)


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def latest_wins(d: Domain) -> DataFrame:
    return catalog.latest(d.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_dedupe(d: Domain) -> DataFrame:
    old = d.table("customer").select("c_custkey", "c_acctbal")
    return catalog.upsert(old, old.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"])


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1")
def ambiguous_names(d: Domain) -> DataFrame:
    return catalog.ambiguous(d.table("part"), ["p_brand", "p_size"], "p_type")


# ---------------------------------------------------------------- norms

_VALID = f"(coalesce(year_from, year) IS NULL OR (coalesce(year_from, year) <= {YEAR} AND coalesce(year_to, 9999) >= {YEAR}))"
_PICK = f"tax_code = '{TAX}' AND {_VALID}"


@query(f"SELECT id, region_code, municipal, object_group, object_name, rate_value FROM norm_ WHERE {_PICK} AND for_ul = 1 AND coalesce(object_group, '') || ' ' || coalesce(object_name, '') LIKE '%a%' ORDER BY municipal, coalesce(object_group, object_name) NULLS FIRST, object_name NULLS FIRST, rate_value, id LIMIT 500 OFFSET 20", NORM)
def rates_page(d: Domain) -> DataFrame:
    rows = norms.select_norms(d.norm, ["object_group", "object_name"], TAX, None, YEAR, "ul", " A ")
    return norms.page(rows, norms.rate_order(), 500, 20).select("id", "region_code", "municipal", "object_group", "object_name", "rate_value")


@query(f"SELECT id, region_code, payer, category FROM norm_ WHERE {_PICK} ORDER BY payer, category, id LIMIT 500", NORM)
def benefits_page(d: Domain) -> DataFrame:
    return norms.page(norms.select_norms(d.norm, [], TAX, None, YEAR), norms.BENEFIT_ORDER).select("id", "region_code", "payer", "category")


@query(f"SELECT region_code, sum(for_fl) AS n_fl, sum(for_ul) AS n_ul, sum(for_ip) AS n_ip, count(*) FILTER (payer = 'all') AS n_all, count(*) AS n_total FROM norm_ WHERE {_VALID} GROUP BY 1", NORM)
def benefit_counts(d: Domain) -> DataFrame:
    return norms.payer_counts(d.norm.where(norms.valid_in(YEAR)), ["region_code"])


@query(f"SELECT (SELECT count(*) FROM norm_ WHERE {_VALID}) AS rates, (SELECT count(DISTINCT coalesce(oktmo, '')) FROM norm_ WHERE {_VALID}) AS municipalities, (SELECT count(*) FROM norm_ WHERE payer = 'all') AS benefits", NORM)
def profile_counts(d: Domain) -> DataFrame:
    return norms.profile_counts(d.norm.where(norms.valid_in(YEAR)), d.norm.where("payer = 'all'"))


@query("SELECT id, CAST(unnest(CASE WHEN year_from IS NULL THEN [0] ELSE generate_series(greatest(1996, year_from), greatest(greatest(1996, year_from), least(2030, coalesce(year_to, greatest(1996, year_from))))) END) AS INT) AS year FROM norm_", NORM)
def period_explode(d: Domain) -> DataFrame:
    return norms.explode_years(d.norm, LAST, 1996).select("id", "year")


@query("SELECT id, unnest(CASE WHEN for_fl + for_ul + for_ip > 0 THEN list_filter([CASE WHEN for_fl = 1 THEN 'fl' END, CASE WHEN for_ul = 1 THEN 'ul' END, CASE WHEN for_ip = 1 THEN 'ip' END], lambda x: x IS NOT NULL) ELSE [payer] END) AS payer FROM norm_", NORM)
def payer_explode(d: Domain) -> DataFrame:
    return norms.explode_payers(d.norm).select("id", "payer")


# ---------------------------------------------------------------- terms


def _cells(d: Domain, bigrams: bool = False, unigrams: bool = True) -> DataFrame:
    return terms.partial_cells(d.text, STOPS, unigrams, bigrams, stem=False)


_AS_LONG = "tax_code, year, region_code, payer, term, CAST(term_freq AS BIGINT) AS term_freq, CAST(doc_freq AS BIGINT) AS doc_freq, is_bigram"


@query(f"SELECT {_AS_LONG} FROM count_", TEXT, YEARS, WORDS, COUNTS)
def terms_unigram(d: Domain) -> DataFrame:
    return terms.count_terms(_cells(d), LAST)


@query(
    """SELECT tax_code, year, region_code, payer, term, CAST(sum(n) AS BIGINT) AS term_freq, count(*) AS doc_freq, 1 AS is_bigram FROM (
    SELECT a.doc_id, a.tax_code, a.year, a.region_code, a.payer, a.term || ' ' || b.term AS term, count(*) AS n FROM word_ a JOIN word_ b ON a.doc_id = b.doc_id AND a.year = b.year AND b.pos = a.pos + 1 GROUP BY ALL) GROUP BY tax_code, year, region_code, payer, term""",
    TEXT, YEARS, WORDS,
)
def terms_bigram(d: Domain) -> DataFrame:
    return terms.count_terms(_cells(d, True, False), LAST)


@query(f"SELECT {_AS_LONG} FROM cube_", TEXT, YEARS, WORDS, COUNTS)
def terms_rollup_all(d: Domain) -> DataFrame:
    return terms.with_all_regions(terms.count_terms(_cells(d), LAST))


_TOP = "top_ AS (SELECT * FROM cube_ QUALIFY row_number() OVER (PARTITION BY tax_code, year, region_code, payer ORDER BY term_freq DESC, doc_freq DESC, term) <= 400)"


@query(f"SELECT {_AS_LONG} FROM top_", TEXT, YEARS, WORDS, COUNTS, _TOP)
def terms_topn(d: Domain) -> DataFrame:
    return terms.top_terms(terms.with_all_regions(terms.count_terms(_cells(d), LAST)))


@query("SELECT term, min(surface) AS display FROM (SELECT lower(p_name) AS term, p_name AS surface, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY n = max(n) OVER (PARTITION BY term)) GROUP BY 1")
def display_form(d: Domain) -> DataFrame:
    return terms.display_forms(d.table("part").select(F.lower("p_name").alias("term"), F.col("p_name").alias("surface")))


_CLOUD = """c_ AS (SELECT term, max(is_bigram) AS is_bigram, CAST(sum(CASE WHEN payer = 'en' THEN term_freq ELSE 0 END) AS BIGINT) AS freq, CAST(sum(CASE WHEN payer = 'en' THEN doc_freq ELSE 0 END) AS BIGINT) AS docs, sum(CASE WHEN payer <> 'en' THEN term_freq ELSE 0 END) AS other FROM top_ WHERE region_code = '00' GROUP BY 1),
t_ AS (SELECT sum(freq) AS a, sum(other) AS b, count(*) FILTER (freq > 0) AS total_terms FROM c_)"""


@query("SELECT term, is_bigram, freq, docs, CAST(freq AS DOUBLE) AS score, total_terms FROM c_, t_ WHERE freq > 0 ORDER BY freq DESC, term LIMIT 120", TEXT, YEARS, WORDS, COUNTS, _TOP, _CLOUD)
def cloud_freq(d: Domain) -> DataFrame:
    return terms.cloud(terms_topn(d), "t", "en")


@query("SELECT term, is_bigram, freq, docs, round(freq * greatest(0, ln((CAST(freq AS DOUBLE) / a) / ((CAST(other AS DOUBLE) + 1) / (b + 1)))), 4) AS score, total_terms FROM c_, t_ WHERE freq > 0 ORDER BY score DESC, freq DESC, term LIMIT 120", TEXT, YEARS, WORDS, COUNTS, _TOP, _CLOUD)
def cloud_distinctive(d: Domain) -> DataFrame:
    return terms.cloud(terms_topn(d), "t", "en", mode="distinctive")


@query()
def stem_terms(d: Domain) -> DataFrame:
    return terms.build_cube(d.text, STOPS, LAST)


@query("SELECT o_orderkey, wording, CASE o_orderkey % 5 WHEN 0 THEN 'fl' WHEN 1 THEN 'ul' WHEN 2 THEN 'ip' WHEN 3 THEN 'all' ELSE 'fl' END AS payer FROM (SELECT o_orderkey, ['Физические лица', 'Организации инвалидов', 'Индивидуальные предприниматели', 'Все категории налогоплательщиков', 'Ветераны'][CAST(o_orderkey % 5 + 1 AS INT)] AS wording FROM orders)")
def payer_detect(d: Domain) -> DataFrame:
    wording = F.element_at(F.array(*map(F.lit, ["Физические лица", "Организации инвалидов", "Индивидуальные предприниматели", "Все категории налогоплательщиков", "Ветераны"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return russian.over_distinct(d.table("orders").select("o_orderkey", wording.alias("wording")), "wording", russian.payer_udf, "payer")


# ---------------------------------------------------------------- shapes and resolution


@query("SELECT p_partkey, 'ul' AS payer, substr(p_brand, 7) AS row_code, p_size AS col_index FROM part WHERE substr(p_brand, 7) <> '' UNION ALL SELECT p_partkey, 'fl', CASE WHEN p_size % 2 = 0 THEN p_type END, 1 FROM part WHERE p_size % 2 = 0")
def code_unpivot(d: Domain) -> DataFrame:
    p = d.table("part").select("p_partkey", F.substring("p_brand", 7, 99).alias("code_ul"), F.col("p_size").alias("col_ul"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("code_fl"), F.lit(1).alias("col_fl"))
    return shape.unpivot_codes(p, ["p_partkey"])


#: An order's lines in a total order.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_quantity > 40 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, sum(CAST(l_quantity < 5 AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS run FROM lineitem)")
def ffill_sections(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", *LINE, (F.col("l_quantity") < 5).alias("reset"), F.when(F.col("l_quantity") > 40, F.col("l_partkey")).alias("section"))
    return shape.fill_down(rows, ["l_orderkey"], LINE, "section", "reset").select("l_orderkey", "l_linenumber", "l_partkey", "section")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag AS INT) AS is_break, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1 AS INT) AS is_first FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)")
def section_flags(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", *LINE, "l_returnflag")
    marked = shape.break_flag(rows, LINE, "l_returnflag", ["l_orderkey"])
    return shape.first_flag(marked, ["l_orderkey", "l_returnflag"], LINE).select("l_orderkey", "l_linenumber", "l_partkey", "is_break", "is_first")


@query("SELECT id, code AS region_code FROM (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN CAST(c_nationkey + 1 AS VARCHAR) ELSE lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '-000' END AS raw, c_nationkey + 1 AS n FROM customer) LEFT JOIN region_ ON code = lpad(CAST(n AS VARCHAR), 2, '0')", REGION)
def resolve_code(d: Domain) -> DataFrame:
    n = F.col("c_nationkey") + 1
    raw = F.when(F.col("c_nationkey") % 3 == 0, n.cast("string")).otherwise(F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("-000")))
    return resolve.by_code(d.table("customer").select(F.col("c_custkey").alias("id"), raw.alias("raw")), d.region, "raw").select("id", "region_code")


@query("SELECT n_nationkey, min(code) AS region_code FROM nation JOIN region_ ON code <> '00' AND lower(name) = lower(n_name) GROUP BY 1", REGION)
def resolve_name(d: Domain) -> DataFrame:
    rows = d.table("nation").select("n_nationkey", F.concat(F.lit("Республика "), F.initcap("n_name")).alias("raw"))
    return resolve.by_name(rows, d.region.where("kind = 'subject'"), "raw").select("n_nationkey", "region_code")


@query(
    f"""SELECT c_custkey, coalesce(own, vote) AS region_code FROM (SELECT c_custkey, substr(CAST(c_custkey AS VARCHAR), 1, 2) AS p, CASE WHEN c_custkey % 4 <> 0 THEN {bridge.CODE.format('c_nationkey')} END AS own FROM customer)
    LEFT JOIN (SELECT p, own AS vote FROM (SELECT substr(CAST(c_custkey AS VARCHAR), 1, 2) AS p, {bridge.CODE.format('c_nationkey')} AS own, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, own) = 1) USING (p)"""
)
def resolve_prefix_vote(d: Domain) -> DataFrame:
    rows = d.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("oktmo"), F.when(F.col("c_custkey") % 4 != 0, Domain.code(F.col("c_nationkey"))).alias("region_code"))
    return resolve.by_prefix_vote(rows, "oktmo", "region_code").select("c_custkey", "region_code")


_ALIASES = [("a", "building"), ("b", "build"), ("c", "auto"), ("d", "mobile"), ("e", "machinery")]


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'a' WHEN 'AUTOMOBILE' THEN 'd' WHEN 'MACHINERY' THEN 'e' END AS tax_code FROM customer")
def alias_longest(d: Domain) -> DataFrame:
    alias = d.spark.createDataFrame(_ALIASES, "tax_code string, alias string")
    return resolve.by_alias(d.table("customer").select("c_custkey", "c_mktsegment"), alias, "c_mktsegment").select("c_custkey", "tax_code")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS DOUBLE) AS number, CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def parse_values(d: Domain) -> DataFrame:
    o = d.table("orders")
    number = F.when(F.col("o_orderkey") % 7 == 0, "н/д").otherwise(F.concat(F.lit(" "), F.regexp_replace(F.floor("o_totalprice").cast("string"), r"(\d)(?=(\d{3})+$)", "$1 "), F.lit(",00 руб")))
    return o.select("o_orderkey", text.parse_number(number).alias("number"), text.parse_year(F.concat(F.lit("за "), F.year("o_orderdate"), F.lit(" год"))).alias("year"), text.parse_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("date"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^0-9a-z]+', ' ', 'g') || ' краи россии скои' AS key FROM part")
def norm_key(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.norm_key(F.concat("p_type", F.lit(" – Край (Российской)"))).alias("key"))


@query(
    """SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, CAST(p - 1 AS INT) AS pos,
      CASE WHEN regexp_matches(h[p], '^[a-z]+:') THEN h[p] WHEN h[p] LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || h[p] WHEN h[p] LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h[p] ELSE CASE WHEN regexp_matches(url, '[^/]/[^/]*$') THEN regexp_replace(url, '([^/])/[^/]*$', '\\1') ELSE url END || '/' || h[p] END AS link
      FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS p FROM (SELECT page_id, url, regexp_extract_all(html, 'href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS h FROM pages))) GROUP BY 1, 2"""
)
def links(d: Domain) -> DataFrame:
    return markup.links(d.table("pages"))


@query("SELECT CAST(len(string_split(p_name, ' ')) AS INT) AS width, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, width LIMIT 6")
def row_width_hist(d: Domain) -> DataFrame:
    return shape.width_histogram(d.table("part").select(F.split("p_name", " ").alias("cells")))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def events_by_day(d: Domain) -> DataFrame:
    return ingest.totals_by_day(d.table("events"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def ledger_unseen(d: Domain) -> DataFrame:
    files = d.table("orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("modificationTime"), "o_orderkey")
    ledger = files.where("o_orderkey % 3 = 0").select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp").cast("double").alias("mtime"))
    return ingest.unseen(files, ledger).select("o_orderkey")


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS object_group, nullif(substr(p_type, length(split_part(p_type, ' ', 1)) + 2), '') AS rest, CASE WHEN p_size % 3 = 0 THEN 'Освобождение от уплаты' WHEN p_size % 3 = 1 THEN 'Пониженный размер: ' || p_size || ' %' ELSE 'Льгота: ' || p_size || ' руб' END AS kind FROM part")
def norm_labels(d: Domain) -> DataFrame:
    group, rest = text.object_group(F.regexp_replace("p_type", "^([^ ]+) ", "$1:  "))
    size = F.col("p_size")
    kind = text.benefit_kind(F.when(size % 3 == 0, "100").otherwise(size.cast("string")), F.when(size % 3 == 0, "").when(size % 3 == 1, "%").otherwise("руб"))
    return d.table("part").select("p_partkey", group.alias("object_group"), rest.alias("rest"), kind.alias("kind"))
