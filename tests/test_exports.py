"""The splittable scan of exports, and readers that stream, on files cut anywhere."""

import gzip
import io
import random
import resource
import subprocess
import sys
import zipfile

import pytest

from levylens.operators import loading
from levylens.sources import containers, delimited, export, markup

SAMPLE = """<?xml version="1.0" encoding="windows-1251"?>
<Файл ИдФайл="TAXRATES">
 <List>
  <li ID="2601" List_value="77 - город Москва"/>
  <li ID="2602" List_value="50 - Московская область"/>
  <LI ID="2802" List_value="Транспортный налог &#8470;&nbsp;1"/>
  <li ID="2803" List_value="Земельный налог"/><li ID="" List_value="x"/>
 </List>
 <tp ID="A1" Region_ID="2601" Nalog_ID="2802" TaxPeriod="2023" MunObraz="г. Москва"
     Oktmo_ID="45000000" LawDoc="Закон г. Москвы &quot;О транспортном налоге&quot;"
     LawNum="33" LawDate="09.07.2008">
   <tr TaxObject="Автомобили легковые (с каждой лошадиной силы): до 100 л.с. включительно"
       TaxRates="12" Fl="1" UL="1" IP="0"/>
   <tb Category="Пенсионеры, получающие страховую пенсию" Amount="100" Unit="%" Base="п. 1 ст. 4" Fl="1" UL="0" IP="0"/>
   <tb Category='Организации &laquo;А&raquo; > Б' Amount="50" Unit="%" Fl="0" UL="1" IP="1"></tb>
 </tp>
 <tp ID="A2" Region_ID="2602" Nalog_ID="2803" TaxPeriod="2022" Oktmo_ID="46000000"
     LawDoc="Решение Совета"/>
 <tp ID="A3" Region_ID="9" Nalog_ID="2803" TaxPeriod="2021"><tr TaxRates="3"/></tp>
</Файл>"""


def plain(rows):
    return sorted((r.attrs["ID"], sorted(r.attrs.items()), [sorted(x.items()) for x in r.tr], [sorted(x.items()) for x in r.tb]) for r in rows)


def read(spark, path, block, **options):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", block)
    try:
        rows = export.read_export(spark, path, **options)
        return rows.rdd.getNumPartitions(), rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("encoding", ["cp1251", "utf-8"])
def test_records_are_the_same_for_any_blocks(spark, tmp_path, encoding):
    path = tmp_path / "data.xml"
    path.write_bytes(SAMPLE.encode(encoding))
    one, whole = read(spark, str(path), "128m")
    assert one == 1 and [x[0] for x in plain(whole)] == ["A1", "A2", "A3"]
    first = next(r for r in whole if r.attrs["ID"] == "A1")
    assert first.attrs["LawDoc"] == 'Закон г. Москвы "О транспортном налоге"' and len(first.tr) == 1
    assert [b["Category"] for b in first.tb] == ["Пенсионеры, получающие страховую пенсию", "Организации «А» > Б"]
    for block in (64, 100, 333, 1_000):
        many, rows = read(spark, str(path), block)
        assert many > 1 and plain(rows) == plain(whole)
    listed = {r.id: r.value for r in export.read_list(spark, str(path)).collect()}
    assert listed == {"2601": "77 - город Москва", "2602": "50 - Московская область", "2802": "Транспортный налог №\xa01", "2803": "Земельный налог"}
    assert [a["ID"] for a, _, _ in ((dict(a), b, c) for a, b, c in export.stream_records(io.BytesIO(SAMPLE.encode(encoding)), chunk=50))] == ["A1", "A2", "A3"]


def test_a_lost_end_costs_one_record(spark, tmp_path):
    path = tmp_path / "broken.xml"
    path.write_text("<tp ID='1'><tr A='x'/></tp> <tp ID='2' " + "z " * 60_000 + "</tp><tp ID='3'/><tp ID='4'><tb B='&#1046;&frac12;'/></tp><tp ID='5'><tr C='1'/>", encoding="utf-8")
    _, rows = read(spark, str(path), "128m", longest=100_000)
    got = {r.attrs["ID"]: (r.tr, r.tb) for r in rows}
    assert set(got) == {"1", "3", "4", "5"} and got["4"][1] == [{"B": "Ж½"}] and got["5"][0] == [{"C": "1"}]


def test_gzip_and_several_files_keep_their_own_ids(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(SAMPLE.encode("cp1251"))
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(SAMPLE.replace("город Москва", "x").replace('"77 - x"', '"50 - x"').encode()))
    region = spark.createDataFrame([("77", "Москва"), ("50", "Московская область")], "code string, name string")
    tax = spark.createDataFrame([("tn", "Транспортный налог", None), ("zn", "Земельный налог", "ЗН")], "code string, name string, short_name string")
    from levylens.operators import resolve

    alias = resolve.tax_aliases(tax, spark.createDataFrame([], "tax_code string, alias string"))
    got = loading.norms_of_export(export.read_export(spark, str(tmp_path)), export.read_list(spark, str(tmp_path), by_file=True), region, alias)
    assert sorted((r.source_file, r.region_code, r.tax_code, r.year, r.rate_value, r.for_fl, r.for_ul, r.for_ip) for r in got.rates.collect()) == [("a.xml", "77", "tn", 2023, 12.0, 1, 1, 0), ("b.xml.gz", "50", "tn", 2023, 12.0, 1, 1, 0)]
    kept = {}
    said = loading.save(got, lambda rows: kept.update(r=rows.count()), lambda rows: kept.update(b=rows.count()))
    assert (said["rows_read"], said["rates"], said["benefits"], said["skipped"]) == (6, 2, 4, 4) and kept == {"r": 2, "b": 4}
    assert said["unmapped_regions"] == ["?"]


def test_pages_and_archives_stream():
    rng = random.Random(4)
    page = "<table>" + "".join("<tr class='a'>" + "".join(f"<td>{rng.random()}&nbsp;&laquo;x&raquo;</td>" for _ in range(5)) + "</tr>" for _ in range(200)) + "<TR><td>last"
    whole = markup.html_rows(page)
    assert len(whole) == 201 and whole[-1] == ["last"]
    for chunk in (1, 7, 100):
        assert list(markup.html_stream(io.StringIO(page), chunk)) == whole
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.html", page)
        z.writestr("b.xml", SAMPLE.encode("cp1251"))
        z.writestr("c.xml", "x;y")
    got = list(containers.tables("p.zip", packed.getvalue()))
    assert [n for n, _ in got] == ["a.html:html", "b.xml:export", "c.xml:csv"] and got[0][1] == whole and got[2][1] == [["x", "y"]]
    assert [n for n, _ in containers.streams("p.zip", packed, 2)] == ["c.xml:csv"] and containers.n_parts("p.zip", packed.getvalue()) == 3


def big_workbook(path, rows, sheets=1):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = [f"s{k}" for k in range(sheets)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="{n}"/>' for n in names) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{n}" Target="worksheets/{n}.xml"/>' for n in names) + "</Relationships>")
        for n in names:
            with z.open(f"xl/worksheets/{n}.xml", "w") as f:
                f.write(f"<worksheet {ns}><sheetData>".encode())
                for i in range(rows):
                    f.write(f'<row r="{i + 1}">{"".join(f"<c t=\"inlineStr\"><is><t>{n} cell {i} {k}</t></is></c>" for k in range(8))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")


def test_a_large_sheet_is_read_row_by_row(tmp_path):
    path = tmp_path / "big.xlsx"
    big_workbook(path, 70_000)
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("xl/worksheets/s0.xml").file_size > 30_000_000
    code = f"""
import resource, sys
sys.path[:0] = {sys.path!r}
from levylens.sources import containers
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open({str(path)!r}, "rb") as f:
    n = sum(1 for _, rows in containers.streams("big.xlsx", f) for _ in rows)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    n, kb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 70_000 and kb < 60_000, kb  # kB; all rows at once are some ten times that
    assert resource.getpagesize()


def test_sheets_and_members_are_dealt_among_tasks(spark, tmp_path):
    big_workbook(tmp_path / "w.xlsx", 50, 3)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(12):
            z.writestr(f"m{k}.csv", f"a;b\n{k};{k}\n")
    tmp_path = tmp_path / "venv" / "data"  # what lies above does not matter
    tmp_path.mkdir(parents=True)
    big_workbook(tmp_path / "w.xlsx", 50, 3)
    (tmp_path.parent.parent / "z.zip").rename(tmp_path / "z.zip")
    for folder in ("node_modules", "in/.git"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "no.csv").write_text("x;y")
    rows = delimited.read_tables(spark, f"file://{tmp_path}/")
    got = rows.collect()
    book = sorted({(r.table_at, r.table) for r in got if r.file.endswith("xlsx")})
    assert book == [(0, "s0"), (1, "s1"), (2, "s2")] and sum(r.file.endswith("xlsx") for r in got) == 150
    members = sorted((r.table_at, r.cells) for r in got if r.file.endswith("zip") and r.row_idx == 1)
    assert members == sorted((k, [str(k), str(k)]) for k in range(12)) and len(got) == 150 + 24
    only = delimited.files(spark, str(tmp_path), suffixes=("zip",)).select("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in only] == ["z.zip"]
