"""Scalar functions, readers, resolution and ingestion on small inputs."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from levylens.functions import russian, text
from levylens.operators import catalog, norms, resolve, shape
from levylens.sources import containers, delimited, markup
from levylens.streaming import ingest


def values(spark, rows, *exprs, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], schema).select(*exprs).collect()]


@pytest.mark.parametrize("words", [["многодетные", "многодетным", "многодетных"], ["организациями", "организации", "организация"], ["инвалидов", "инвалиды", "инвалид"]])
def test_stems_agree(words):
    assert len(set(map(russian.stem, words))) == 1


def test_stem_values():
    assert russian.stem("инвалидов") == "инвалид" and russian.stem("ёж") == "еж" and russian.stem("usa") == "usa"


@pytest.mark.parametrize("wording,payer", [("Физические лица", "fl"), ("Организации инвалидов", "ul"), ("Инвалиды I и II групп", "fl"), ("Индивидуальные предприниматели", "ip"), ("Граждане и индивидуальные предприниматели", "ip"), ("Все категории налогоплательщиков", "all"), (None, "all")])
def test_payers(wording, payer):
    assert russian.detect_payer(wording) == payer


def test_a_whole_word_goes_before_the_beginning_of_one():
    assert russian.detect_payer("Общественные объединения инвалидов") == "ul"  # the beginning of a word, as nothing else is before it
    assert russian.detect_payer("Общественность и пенсионеры, общества") == "fl"  # the whole word is behind
    assert russian.detect_payer("", None, "Юлианская семья") == "ul" and russian.detect_payer("всё") == "all"


def test_a_backslash_is_a_letter(spark):
    rows = spark.createDataFrame([(1, "a\\b"), (2, "ab"), (3, "a%b")], "id int, t string")
    found = lambda needle: [r.id for r in rows.where(norms.matches(needle, ["t"])).orderBy("id").collect()]
    assert found("a\\") == [1] and found("\\") == [1] and found("a%b") == [1, 2, 3] and found("A_B") == [1, 3]


def test_many_names_in_many_texts(spark, monkeypatch):
    import random

    from levylens.functions import matching

    rng = random.Random(5)
    names = [("".join(rng.choices("abc ", k=rng.randint(1, 9))).strip() or "z", str(k)) for k in range(300)]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 14))).strip() for _ in range(1500)]
    found = matching.Names(names)
    for t in texts:
        held = [(-len(k), i, v) for i, (k, v) in enumerate(names) if k in t]
        assert found.longest(t) == (min(held)[2] if held else None)
        equal = [v for k, v in names if k == t]
        near = [v for k, v in names if len(k) > 4 and t and (k in t or t in k)]
        assert found.named(t) == ((equal + near + [None])[0] if t else None), t
    assert matching.Names([]).named("x") is None and matching.Names([]).longest("x") is None
    region = spark.createDataFrame([(v.rjust(3, "0"), k) for k, v in names], "code string, name string")
    alias = region.select(F.col("code").alias("tax_code"), F.col("name").alias("alias"))
    rows = spark.createDataFrame([(t or None,) for t in texts], "raw string")
    one, two = resolve.by_name(rows, region, "raw"), resolve.by_alias(rows, alias, "raw")
    assert "NestedLoop" not in one._jdf.queryExecution().toString() + two._jdf.queryExecution().toString()
    got = [sorted(map(repr, x.distinct().collect())) for x in (one, two)]
    monkeypatch.setattr(resolve, "SMALL", 10)  # too many for an automaton: by joins
    assert got == [sorted(map(repr, x.distinct().collect())) for x in (resolve.by_name(rows, region, "raw"), resolve.by_alias(rows, alias, "raw"))]


def test_dimensions_and_votes(spark, tmp_path):
    from levylens.operators import loading
    from levylens.sources import dimensions

    (tmp_path / "r.csv").write_text("code,name,short_name,federal_district,kind,valid_from,valid_to,note\n01,Адыгея,,ЮФО,subject,,,\n77,Москва,М,ЦФО,subject,2000,,x\n", encoding="utf-8")
    (tmp_path / "t.csv").write_text("code,name,short_name,level,form_code,sort_order\ntn,Транспортный налог,ТН,regional,5-ТН,10\nzn,Земельный налог,ЗН,local,5-МН,20\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("tax_code,alias\ntn,с машин\nzn,с земли\n", encoding="utf-8")
    new = dimensions.read_regions(spark, str(tmp_path / "r.csv"))
    old = new.where("code = '77'").withColumn("valid_from", F.lit("1990")).withColumn("name", F.lit("old"))
    got = {r.code: r for r in dimensions.load_regions(old, new).collect()}
    assert (got["77"].name, got["77"].valid_from, got["01"].valid_from, got["01"].short_name) == ("Москва", "1990", None, "")
    tax = dimensions.read_taxes(spark, str(tmp_path / "t.csv"))
    assert {r.code: r.sort_order for r in dimensions.load_taxes(tax.withColumn("sort_order", F.lit(1)), tax).collect()} == {"tn": 1, "zn": 1}
    alias = resolve.tax_aliases(tax, dimensions.read_aliases(spark, str(tmp_path / "a.csv")))
    said = spark.createDataFrame([("Земельный налог",), ("налог с машин",), ("ТН",), ("прочее",)], "t string")
    assert {r.t: r.tax_code for r in resolve.by_alias(said, alias, "t").collect()} == {"Земельный налог": "zn", "налог с машин": "tn", "ТН": "tn", "прочее": None}
    one = loading.norms(spark.createDataFrame([("77", "45301000", "тн", "1")], "region_code string, oktmo string, tax_name string, rate_value string"), new, alias)
    one.votes.write.parquet(str(tmp_path / "votes"))
    later = spark.createDataFrame([("", "45-302000", "тн", "2"), ("01", "45", "тн", "3")], "region_code string, oktmo string, tax_name string, rate_value string")
    two = loading.norms(later, new, alias, votes=spark.read.parquet(str(tmp_path / "votes")))
    assert {(r.region_code, r.rate_value) for r in two.rates.collect()} == {("01", 2.0), ("01", 3.0)}  # one vote each: the least
    assert {(v.prefix, v.vote, v.n) for v in two.votes.collect()} == {("45", "77", 1), ("45", "01", 1)}
    only = loading.norms(later.where("region_code = ''"), new, alias, votes=spark.read.parquet(str(tmp_path / "votes")))
    assert [r.region_code for r in only.rates.collect()] == ["77"]


def test_scalars(spark):
    x = F.col("x")
    assert values(spark, ["1 234,56", "2,2 %", "-", None, "н/д", "от 5 до 10", "1.234.567"], text.parse_number(x)) == [(1234.56,), (2.2,), (None,), (None,), (None,), (5.0,), (1.234,)]
    assert values(spark, ["за 2019 год", "нет данных", None], text.parse_year(x)) == [(2019,), (None,), (None,)]
    assert values(spark, ["1.2.2020", "31-12-2021", "2019-05-06", "x"], text.parse_date(x)) == [("2020-02-01",), ("2021-12-31",), ("2019-05-06",), (None,)]
    assert values(spark, ["Код  региона (Б)", "Пермский край", None], text.norm_key(x)) == [("код региона б",), ("пермскии краи",), ("",)]
    assert values(spark, [" a   b – c ", None], text.clean(x)) == [("a b - c",), ("",)]
    assert values(spark, ["Гидроциклы (с каждой л.с.):  свыше 100 л.с. ", "plain"], *text.object_group(x)) == [("Гидроциклы (с каждой л.с.)", "свыше 100 л.с."), ("plain", None)]
    assert values(spark, ["Ёлка-2 и a стол"], text.tokenize(x)) == [(["елка-2", "стол"],)]


def test_year_bounds_and_flags(spark):
    rows = spark.createDataFrame([("2021", None, None, None), (None, "1.1.2020", None, None), ("2021", "1.1.2020", "31.12.2024", None), (None, None, None, "5.6.2018")], "p string, a string, b string, c string")
    assert [tuple(r) for r in rows.select(*text.year_bounds(*map(F.col, "pabc"))).collect()] == [(2021, 2021, 2021), (None, 2020, None), (2021, 2020, 2024), (None, 2018, None)]
    m = spark.createDataFrame([({"Fl": "1", "UL": "да", "fl": "0"},), ({"Yur": "0"},)], "m map<string,string>")
    f = text.payer_flags(F.col("m"))
    assert [tuple(r) for r in m.select(f["fl"], f["ul"], f["ip"], text.payer_from_flags(f["fl"], f["ul"], f["ip"])).collect()] == [(1, 1, 0, "all"), (0, 0, 0, "all")]


def test_delimited_and_headers():
    raw = "Отчёт\nКод региона;Наименование;Ставка\n77;Москва;2,2 %\n50;Область\n".encode("cp1251")
    rows = delimited.parse_delimited(raw)
    assert rows[2:] == [["77", "Москва", "2,2 %"], ["50", "Область"]]
    assert delimited.find_header(rows, ["код региона", "ставка"]) == 1
    assert delimited.dedupe(["a", "", "a", ""]) == ["a", "col", "a__1", "col__1"]
    assert delimited.map_columns(["Код региона РФ", "Регион", "Ставка налога"], {"code": ["код региона"], "name": ["регион"], "rate": ["ставка"]}) == {"name": 1, "code": 0, "rate": 2}
    assert delimited.detect_delimiter("a|b|c\n1|2|3") == "|" and delimited.detect_delimiter("abc") == ","


def test_html_rows():
    page = "<table><tr><th colspan=2>Регион</th><th>Ставка</th></tr><tr><td>77<td>&laquo;Москва&raquo;<td>2,2<br/>%</tr><tr><td>last"
    assert markup.html_rows(page) == [["Регион", "", "Ставка"], ["77", "«Москва»", "2,2 %"], ["last"]]


def small_workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>label</t></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>1100</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_containers():
    assert list(containers.tables("f.xlsx", small_workbook())) == [("one", [[], ["label", "", "1100"]]), ("two", [["x"]])]
    assert list(containers.tables("f.csv.gz", gzip.compress(b"a,b\n1,2"))) == [("csv", [["a", "b"], ["1", "2"]])]
    with pytest.raises(NotImplementedError):
        list(containers.tables("f.xls", b""))


def test_read_tables_and_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n", encoding="utf-8")
    (tmp_path / "~$b.csv").write_text("junk")
    rows = delimited.read_tables(spark, str(tmp_path), "*.csv").orderBy("row_idx").collect()
    assert [r.cells for r in rows] == [["x", "y"], ["1", "2"]]
    found = delimited.files(spark, str(tmp_path), "*.csv")
    empty = spark.createDataFrame([], "path string, kind string, size long, mtime double")
    assert ingest.unseen(found, empty).count() == 1
    assert ingest.unseen(found, ingest.remember(empty, found, "csv")).count() == 0


EXPORT = """<List><li ID="1" List_value="77-Москва"/><li ID="2" List_value="tn &amp; x"/></List>
<tp ID='5' Region_ID="1" Nalog_ID="2" TaxPeriod="2023"><tr TaxObject="a &lt; b" TaxRates="12" Fl="1" UL="1" IP="0"/><tb Category="A" Amount="100" Fl="1"/><tb Category="B > C" UL='1'/></tp>
<tp ID="6" Region_ID="1"/><broken <tp ID="7"><tr TaxRates="3"/>"""


def test_xml_export(spark, tmp_path):
    (tmp_path / "e.xml").write_text(EXPORT, encoding="utf-8")
    got = {r.attrs["ID"]: r for r in markup.read_export(spark, str(tmp_path / "e.xml")).collect()}
    assert set(got) == {"5", "6", "7"}
    assert got["5"].tr[0]["TaxObject"] == "a < b" and [b["Category"] for b in got["5"].tb] == ["A", "B > C"]
    assert len(got["6"].tr) == 0 and got["7"].tr[0]["TaxRates"] == "3"
    assert sorted(map(tuple, markup.read_list(spark, str(tmp_path / "e.xml")).collect())) == [("1", "77-Москва"), ("2", "tn & x")]
    assert markup.looks_like_export(EXPORT)


def test_row_codes(spark):
    cells = spark.createDataFrame([("f", 1, ["label", "0100", "5", "7"]), ("f", 2, ["total", "1.0", "9"]), ("f", 3, ["100", "x"]), ("f", 4, ["again", "100", "", "8"])], "file string, row_idx long, cells array<string>")
    codes = spark.createDataFrame([("100", 1, "ul", 1), ("100", 1, "fl", 2), ("1", 2, "ul", None)], "row_code string, indicator_id int, payer string, col_index int")
    # row 4 has one number, so it says nothing of the second column; "1.0" has too few digits to be a row's code
    assert sorted(map(tuple, resolve.by_row_code(cells, codes).collect())) == [("f", 1, "fl", 7.0), ("f", 1, "ul", 8.0)]


def test_names_and_misses(spark):
    region = spark.createDataFrame([("16", "Республика Татарстан"), ("77", "Москва"), ("50", "Московская область")], "code string, name string")
    rows = spark.createDataFrame([("татарстан",), ("г. Москва",), ("Московская",), ("x",), (None,)], "raw string")
    got = {r.raw: r.region_code for r in resolve.by_name(rows, region, "raw").collect()}
    assert got == {"татарстан": "16", "г. Москва": "77", "Московская": "50", "x": None, None: None}
    bad = spark.createDataFrame([("region", "b"), ("region", "a"), ("tax", "c")], "reason string, value string")
    assert sorted(map(tuple, resolve.misses(bad, "reason", "value").collect())) == [("region", 2, ["a", "b"]), ("tax", 1, ["c"])]


def test_slugs_pages_and_search(spark):
    rows = spark.createDataFrame([(2020, "s1--a", "A", 1), (2020, "s1--a", "B", 2), (2020, "s1--a", "A", 3)], "year int, slug string, name string, at int")
    assert sorted(r.slug for r in shape.suffix_collisions(rows, ["year", "slug"], "name", "at").collect()) == ["s1--a", "s1--a", "s1--a--2"]
    n = spark.createDataFrame([(1, "Много", None), (2, "детям", "x")], "id int, a string, b string")
    assert [r.id for r in n.where(norms.matches("МНОГО", ["a", "b"])).collect()] == [1]
    assert n.where(norms.matches("  ", ["a"])).count() == 2
    assert catalog.latest(rows, ["year"], ["at"]).collect()[0].at == 3


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", "a", float(i)) for i in range(30)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    ingest.stream_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double", lambda df, _: seen.extend(map(tuple, ingest.totals_by_day(df).collect())), str(tmp_path / "cp"))
    assert sorted(seen) == sorted(map(tuple, ingest.totals_by_day(rows).collect()))
    again = len(seen)
    ingest.stream_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double", lambda df, _: seen.append(1) if df.count() else None, str(tmp_path / "cp"))
    assert len(seen) == again


def test_csv_bytes(spark):
    out = delimited.csv_bytes(spark.createDataFrame([(1, None), (2, "б;в")], "a int, b string"))
    assert out == "﻿a;b\r\n1;\r\n2;\"б;в\"\r\n".encode()


def test_entry_imports_and_stays_whole():
    import __spark_entry__ as e

    assert "ranking_top" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_rows_are_appended_and_slices_replaced(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([(2020, "tn", 1.0), (2021, "tn", 2.0), (2020, "zn", 3.0)], "year int, tax string, value double")
    ingest.append(rows, path, ["tax", "year"])
    ingest.append(rows.where("year = 2021"), path, ["tax", "year"])
    read = lambda: sorted((r.year, r.tax, r.value) for r in spark.read.parquet(path).collect())
    assert read() == [(2020, "tn", 1.0), (2020, "zn", 3.0), (2021, "tn", 2.0), (2021, "tn", 2.0)]
    ingest.replace_slice(rows.where("year = 2021").withColumn("value", F.lit(9.0)), path, ["tax", "year"])
    assert read() == [(2020, "tn", 1.0), (2020, "zn", 3.0), (2021, "tn", 9.0)]


def test_limits(spark):
    from levylens.operators import facts, service, terms

    fact = spark.createDataFrame([(2020, str(r), "tn", 1, "ul", float(r)) for r in range(10, 30)], "year int, region_code string, tax_code string, indicator_id int, payer string, value double")
    region = spark.createDataFrame([(str(r), f"r{r}", "subject") for r in range(10, 30)], "code string, name string, kind string")
    assert [r.region_code for r in facts.ranking(fact, region, "tn", 2020, 1, limit=3).collect()] == ["29", "28", "27"]
    cube = spark.createDataFrame([("tn", 2020, "00", "fl", f"t{k}", 0, k, 1) for k in range(30)], "tax_code string, year int, region_code string, payer string, term string, is_bigram int, term_freq long, doc_freq long")
    assert [r.term for r in terms.cloud(cube, "tn", "fl", limit=2).collect()] == ["t29", "t28"]
    log = spark.createDataFrame([(k, f"2024-01-{k + 1:02d}") for k in range(20)], "id int, loaded_at string")
    assert [r.id for r in service.last_loads(log, 4).collect()] == [19, 18, 17, 16]


def test_decomposed_letters_are_looked_up_not_searched_for(spark):
    odd = text._decomposed()[0]
    rows = [f"a{c}b{c}{c}9" for c in odd] + ["𝟙x", " y", "½½", "ﬃ№"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.norm_key(F.col("x")).alias("key"))
    assert [(r.x, r.key) for r in df.collect() if r.key != delimited.norm_header(r.x.replace("й", "и "))] == []
    assert "instr(" not in df._jdf.queryExecution().optimizedPlan().toString()  # which is a scan of the list for each letter
