"""Loaders, forms, import control and reports on small files like those that portals publish."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from levylens.functions import russian, text
from levylens.operators import loading, methodology, resolve, service, terms
from levylens.sources import containers, delimited, markup, report
from levylens.streaming import importing, ingest

REGIONS = [("00", "Российская Федерация", "РФ", "aggregate"), ("16", "Республика Татарстан", "Татарстан", "subject"), ("50", "Московская область", None, "subject"), ("77", "г. Москва", "Москва", "subject")]
ALIASES = [("tn", "транспортный"), ("zn", "земельный"), ("niul", "имущество организаций")]


@pytest.fixture
def region(spark):
    return spark.createDataFrame(REGIONS, "code string, name string, short_name string, kind string")


@pytest.fixture
def alias(spark):
    return spark.createDataFrame(ALIASES, "tax_code string, alias string")


HEADER = "Код региона;Наименование региона;ОКТМО;Налог;Налоговый период;Объект;Ставка;Налогоплательщик;Категория льготы;Вид льготы;Размер льготы;Условие;Основание;НПА;Дата с;Дата по"
LINES = [
    "77;г. Москва;45301000;Транспортный налог;2023;Легковые автомобили: до 100 л.с.;12,00;Физические лица;;;;;;Закон;;",
    ";Московская область;46000000;Транспортный налог;2023;;;Физические лица;Ветераны;Освобождение;100 %;;;Закон;;",
    "16;;92000000;Земельный налог;;Земли;1,5;Организации;Инвалиды;;50;;;Закон;01.01.2020;31.12.2024",
]
COLUMNS = {"region_code": ["код региона"], "region_name": ["наименование региона"], "oktmo": ["октмо"], "tax_name": ["налог"], "period_year": ["налоговый период"], "object_name": ["объект"], "rate_value": ["ставка"], "payer_text": ["налогоплательщик"], "benefit_category": ["категория льготы"], "benefit_kind": ["вид льготы"], "benefit_size": ["размер льготы"], "date_from": ["дата с"], "date_to": ["дата по"]}


def test_a_norm_file_gives_rates_and_benefits(spark, region, alias, tmp_path):
    (tmp_path / "norms.csv").write_bytes("\n".join(["Сведения о ставках", HEADER, *LINES]).encode("cp1251"))
    rows = delimited.read_tables(spark, str(tmp_path))
    cells = [r.cells for r in rows.orderBy("row_idx").collect()]
    at = delimited.find_header(cells, ["код региона", "ставка"])
    columns = delimited.map_columns(cells[at], COLUMNS)
    assert at == 1 and columns["tax_name"] == 3 and columns["period_year"] == 4
    got = loading.norms(delimited.records(rows, columns, at), region, alias)
    rates, benefits = got.rates.orderBy("region_code").collect(), got.benefits.orderBy("region_code").collect()
    assert [(r.region_code, r.tax_code, r.rate_value, r.payer, r.for_fl, r.object_group) for r in rates] == [("16", "zn", 1.5, "ul", 0, "Земли"), ("77", "tn", 12.0, "fl", 1, "Легковые автомобили")]
    assert (rates[0].year, rates[0].year_from, rates[0].year_to) == (2020, 2020, 2024)
    assert [(b.region_code, b.payer, b.size_value) for b in benefits] == [("16", "ul", 50.0), ("50", "fl", 100.0)]
    assert got.misses.count() == 0


def test_misses_and_learned_prefixes(spark, region, alias):
    rows = spark.createDataFrame([("77", "", "45301000", "транспортный", "1"), ("", "", "45-302000", "транспортный", "2"), ("", "Атлантида", "", "транспортный", "3"), ("50", "", "", "водный", "4"), ("", "", "", "транспортный", "5")], "region_code string, region_name string, oktmo string, tax_name string, rate_value string")
    got = loading.norms(rows, region, alias)
    assert {(r.region_code, r.rate_value) for r in got.rates.collect()} == {("77", 1.0), ("77", 2.0)}
    assert {tuple(r) for r in got.misses.collect()} == {("unmapped_regions", "Атлантида"), ("unmapped_taxes", "водный")}


EXPORT = """<List><li ID="1" List_value="77-Москва"/><li ID="2" List_value="Транспортный налог"/></List>
<tp ID="9" Region_ID="1" Nalog_ID="2" TaxPeriod="2023" LawNum='5'><tr TaxObject="Лодки: до 100 л.с." TaxRates="12" Fl="1" UL="1" IP="0"/><tb Category="Герои" Amount="100" Unit="%" Fl="1"/><tb Category="Фонды &amp; союзы" Amount="50" Unit="%" UL="1" IP="1"/></tp><tp ID="10" Region_ID="7" Nalog_ID="2"/>"""


def test_an_export_gives_rates_and_benefits(spark, region, alias, tmp_path):
    (tmp_path / "a.xml").write_text(EXPORT, encoding="utf-8")
    got = loading.norms_of_export(markup.read_export(spark, str(tmp_path)), markup.read_list(spark, str(tmp_path)), region, alias)
    r = got.rates.collect()
    assert [(x.region_code, x.tax_code, x.year, x.rate_value, x.for_fl, x.for_ul, x.for_ip, x.payer, x.object_group) for x in r] == [("77", "tn", 2023, 12.0, 1, 1, 0, "all", "Лодки")]
    b = got.benefits.orderBy("size_value").collect()
    assert [(x.category, x.kind, x.payer) for x in b] == [("Фонды & союзы", "Пониженный размер: 50 %", "all"), ("Герои", "Освобождение от уплаты", "fl")]
    assert [tuple(m) for m in got.misses.collect()] == [("unmapped_regions", "?")]


def test_forms_of_both_layouts(spark, region):
    codes = [("tn", 2019, p, c, None, i) for i, (c, p) in enumerate([("1100", "ul"), ("2100", "fl"), ("1400", "ul"), ("2400", "fl")])]
    codes += [("tn", 2006, p, c, k, 7) for c in ("010", "120") for k, p in ((1, "ul"), (2, "fl"))]
    codes = spark.createDataFrame(codes, "tax_code string, year int, payer string, row_code string, col_index int, indicator_id int")
    rows = [("/in/5tn_2019_50.xlsx", "1", k, c) for k, c in enumerate([["Отчёт"], ["Показатель", "Код", "Всего"], ["a", "1100", "100"], ["b", "2100.0", "900"], ["c", "1400", "", "5 000"], ["d", "2400", "7000,0"]])]
    rows += [("/in/none.xlsx", "1", 0, ["по Атлантиде", "за 2006 год"]), ("/in/none.xlsx", "1", 1, ["x", "010", "999", "88888"])]
    rows = spark.createDataFrame(rows, "file string, table string, row_idx long, cells array<string>")
    facts, problems = loading.forms(rows, codes, region, "tn")
    got = {(r.year, r.region_code, r.indicator_id, r.payer): r.value for r in facts.collect()}
    assert got == {(2019, "50", 0, "ul"): 100.0, (2019, "50", 1, "fl"): 900.0, (2019, "50", 2, "ul"): 5000.0, (2019, "50", 3, "fl"): 7000.0}
    assert [tuple(p) for p in problems.collect()] == [("/in/none.xlsx", "no region")]
    again, _ = loading.forms(rows.where("file LIKE '%none%'"), codes, region, "tn", year=2006, region_code="16")
    assert {(r.payer, r.value) for r in again.collect()} == {("ul", 999.0), ("fl", 88888.0)}
    old = facts.withColumn("value", F.lit(1.0)).unionByName(facts.withColumn("year", F.lit(2000)))
    assert sorted(r.value for r in loading.replace_slices(old, facts).where("year = 2019").collect()) == [100.0, 900.0, 5000.0, 7000.0]
    assert [r.cell for r in resolve.unknown_codes(spark.createDataFrame([(["1100", "7777", "x"],)], "cells array<string>"), codes).collect()] == ["7777"]


def test_cells_tags_and_charsets():
    assert markup.html_cells("<td>foo<span>bar</span></td><td colspan=2>a<br/>b</td>") == ["foo bar", "a b", ""]
    assert delimited.detect_encoding(b"a;encoding=foo;b") == "utf-8"
    assert delimited.detect_encoding(b"<meta charset=foo>") == "utf-8"
    assert delimited.detect_encoding(b"<meta charset=windows-1251>") == "cp1251"
    assert delimited.detect_encoding(b"<?xml version='1.0' encoding='KOI8-R'?>") == "koi8-r"
    assert delimited.find_header([["12%", "-5", "a"], ["x", "y"]]) == 0
    assert delimited.dedupe(["a", "", "a", "", "a"]) == ["a", "col", "a__1", "col__1", "a__2"]
    assert delimited.map_columns(["Ставка налога", "Ставка"], {"rate": ["ставка"], "text": ["ставка налога", "ставка"]}) == {"text": 0, "rate": 1}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("in/a.csv", "x;y\n1;2")
        z.writestr("b.csv.gz", gzip.compress(b"p,q"))
        z.writestr("readme.md", "no")
    assert [(n, r) for n, r in containers.tables("all.zip", packed.getvalue())] == [("in/a.csv:csv", [["x", "y"], ["1", "2"]]), ("b.csv.gz:csv", [["p", "q"]])]


def test_a_run_passes_over_bad_files_and_known_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.xls").write_bytes(b"old")
    ledger = spark.createDataFrame([], importing.LEDGER)
    seen = []
    kinds = lambda rows: rows.select("file").distinct().select("file", F.lit("rates").alias("kind"))
    work = {"rates": lambda rows: seen.append(sorted({r.file.rsplit("/")[-1] for r in rows.collect()})), "forms": lambda rows: seen.append("never")}
    done, ledger = importing.run(spark, str(tmp_path), ledger, kinds, work, after=lambda k: seen.append(k))
    assert seen == [["a.csv"], {"rates"}] and sorted(f.rsplit("/")[-1] for f in done.failed) == ["b.zip", "c.xls"]
    kept = spark.createDataFrame(ledger.collect(), importing.LEDGER)
    assert [r.kind for r in kept.collect()] == ["rates"]
    done, _ = importing.run(spark, str(tmp_path), kept, kinds, work)
    assert done.loaded == {} and len(seen) == 2
    assert ingest.unseen(delimited.files(spark, str(tmp_path)), kept).count() == 2


def test_reports_and_made_up_facts(spark, region):
    rows = spark.createDataFrame([("f", "t", 0, ["Отчёт", ""]), ("f", "t", 1, ["Код региона", "Ставка", "x"]), ("f", "t", 2, ["77", "1"])], "file string, table string, row_idx long, cells array<string>")
    names = spark.createDataFrame([("region_code", "код региона"), ("rate_value", "ставка"), ("rate_value", "размер ставки")], "field string, alias string")
    assert [tuple(r) for r in report.header_candidates(rows, names).collect()] == [("f", "t", 0, 1, 2)]
    assert report.describe(rows, 1).collect()[0].preview == [["Отчёт", ""]]
    assert [r.line for r in report.report(rows, names).collect()] == ["f [t] 3 rows, up to 3 cells; header 1, fields 2"]
    indicator = spark.createDataFrame([(1,), (2,)], "id int")
    one, two, other = (sorted(map(tuple, report.made_up(spark, region.repartition(n), indicator, 2018, 2020, seed=s).collect())) for n, s in ((1, 7), (5, 7), (1, 8)))
    assert one == two != other and len(one) == 3 * 2 * 3 * 2


HEAD = ["№", "Показатель", "Код строки для юридических лиц", "Код строки для физических лиц", "Столбец для юридических лиц", "Графа для физических лиц"]


def sheet_rows(title, at, rows):
    return [("m.xlsx", title, at, k, r) for k, r in enumerate([["Методичка"], HEAD, *rows])]


def test_methodology_of_a_workbook(spark, tmp_path):
    one = [
        ["", "1. Всего, единиц", "1100", "2100"],
        ["", "Показатель без кода", "", ""],
        ["", "1. Автомобили легковые", "1311.0", "2311"],
        ["", "до 100 л.с.", "1312", "2312"],
        ["", "свыше 100 л.с.", "1313", ""],
        ["", "Прочие", "1350", "2350"],
        ["", "до 100 л.с.", "1351", ""],
        ["", "1 . Мотоциклы", "1361", ""],
        ["", "До 100 л.с.", "1362", ""],
        ["", "4. По водным, тыс. руб.", "040", "045"],
        ["", "4. Сумма (всего)", "15", ""],
        ["", "Сумма всего", "17", ""],
        ["", "Сумма - всего", "19", ""],
    ]
    two = [["", "1. Всего, единиц", "010", "010", "1", "2"], ["", "2. Вне", "021", "", "", ""]]
    rows = sheet_rows("2019 - 5-ТН", 1, one) + sheet_rows("2006_форма", 0, two) + sheet_rows("без года", 2, two)
    rows = spark.createDataFrame(rows, "file string, table string, table_at int, row_idx long, cells array<string>")
    flat = methodology.scan_workbook(rows, "tn")
    got = [(r.section, r.level, r.group, r.name, r.slug, r.unit, r.code_ul, r.code_fl) for r in flat.where("year = 2019").orderBy("sort_order").collect()]
    cars, bikes = "Автомобили легковые", "Мотоциклы"
    assert got == [
        ("1", 0, None, "Всего, единиц", "s1--всего-единиц", "единиц", "1100", "2100"),
        ("1", 2, None, cars, "s1--автомобили-легковые", "единиц", "1311", "2311"),
        ("1", 3, cars, "до 100 л.с.", "s1--автомобили-легковые--до-100-л-с", "единиц", "1312", "2312"),
        ("1", 3, cars, "свыше 100 л.с.", "s1--свыше-100-л-с", "единиц", "1313", None),
        ("1", 1, None, "Прочие", "s1--прочие", "единиц", "1350", "2350"),
        ("1", 1, None, "до 100 л.с.", "s1--до-100-л-с", "единиц", "1351", None),
        ("1", 2, None, bikes, "s1--мотоциклы", "единиц", "1361", None),
        ("1", 3, bikes, "До 100 л.с.", "s1--мотоциклы--до-100-л-с", "единиц", "1362", None),
        ("4", 0, None, "По водным, тыс. руб.", "s4--по-водным-тыс-руб", "тыс. руб.", "040", "045"),
        ("4", 2, None, "Сумма (всего)", "s4--сумма-всего", "тыс. руб.", "15", None),
        ("4", 3, "Сумма (всего)", "Сумма всего", "s4--сумма-всего--сумма-всего", "тыс. руб.", "17", None),
        ("4", 3, "Сумма (всего)", "Сумма - всего", "s4--сумма-всего--сумма-всего--2", "тыс. руб.", "19", None),
    ]
    assert [(r.slug, r.col_ul, r.col_fl, r.sort_order) for r in flat.where("year = 2006").orderBy("sort_order").collect()] == [("s1--всего-единиц", 1, 2, 1), ("s2--вне", None, None, 2)]
    assert flat.select("year").distinct().count() == 2
    methodology.write_map(flat, str(tmp_path / "map"))
    assert sorted(map(str, methodology.read_map(spark, str(tmp_path / "map")).collect())) == sorted(map(str, flat.collect()))
    known = methodology.indicators(flat).orderBy("sort_order").collect()
    assert [(k.name, k.sort_order) for k in known][:3] == [("Всего, единиц", 1), (cars, 2), (f"{cars}: до 100 л.с.", 3)] and known[-1].sort_order == 10_002
    codes = methodology.codes(flat, methodology.indicators(flat).select("tax_code", "slug", F.xxhash64("slug").alias("id")))
    assert [r.col_index for r in codes.where("year = 2006 AND payer = 'fl' AND row_code = '010'").collect()] == [2]


def test_stop_words_and_payers(spark):
    lists = spark.createDataFrame([("Налоговых",), ("а также",)], "word string")
    got = {r.word for r in terms.stop_forms(lists).collect()}
    assert {"налоговых", "а также", "также", russian.stem("налоговых")} <= got
    assert russian.detect_payer("для всех", "Пенсионеры и организации") == "fl"
    assert russian.detect_payer("Организации", "граждане") == "ul" and russian.detect_payer(None, "") == "all"
    assert russian.detect_payer("Пенсионеры, индивидуальные предприниматели") == "ip"
    for words in (["многодетные", "многодетным", "многодетных"], ["организациями", "организации", "организация"], ["инвалидов", "инвалиды"]):
        assert len({russian.stem(w) for w in words}) == 1
    row = spark.createDataFrame([("Инвалиды и инвалидам",), (None,)], "t string").select(russian.stems_udf(text.tokenize(F.col("t"))).alias("s")).collect()
    assert [r.s for r in row] == [["инвалид", "инвалид"], []]


def test_a_log_row_and_a_migrated_table(spark):
    row = service.load_entry(spark, "rates", "a.csv", 3, 2, {"skipped": 1}).collect()[0]
    assert (row.rows_read, row.rows_saved, row.details) == (3, 2, '{"skipped":"1"}')
    old = spark.createDataFrame([("fl", "Лодки: до 5"), ("all", "Земли")], "payer string, object_name string")
    new = service.with_flags(old)
    assert [(r.for_fl, r.for_ul, r.object_group) for r in new.collect()] == [(1, 0, "Лодки"), (0, 0, "Земли")]
    assert service.with_flags(new).columns == new.columns
