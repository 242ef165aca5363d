"""Import runs over folders and streams: known files, bad files, bad loaders, exports, headers of their own."""

import zipfile

import pytest
from pyspark.sql import functions as F

from levylens.operators import loading
from levylens.sources import delimited
from levylens.streaming import importing
from tests.test_exports import SAMPLE

ALIASES = {"region_code": ["код региона"], "region_name": ["регион"], "tax_name": ["налог"], "rate_value": ["ставка"], "object_name": ["объект"], "period_year": ["период"]}


def by_name(rows):
    """Files are what their names begin with."""
    return rows.select("file").distinct().withColumn("kind", F.regexp_extract("file", "/([a-z]+)[^/]*$", 1))


def names(files):
    return sorted(f.rsplit("/", 1)[1] for f in files)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], importing.LEDGER)


def test_only_new_files_are_read(spark, tmp_path, empty):
    for k in range(6):
        (tmp_path / f"rates{k}.csv").write_text(f"a;b\n{k};{k}\n")
    (tmp_path / "rates.log").write_text("a;b\n1;2\n")  # of another suffix
    seen = []
    work = {"rates": lambda rows: seen.append(sorted((r.file.rsplit("/", 1)[1], r.row_idx) for r in rows.collect()))}
    done, ledger = importing.run(spark, str(tmp_path), empty, by_name, work)
    assert done.rows_read == 12 and len(seen[0]) == 12
    ledger = spark.createDataFrame(ledger.collect(), importing.LEDGER)
    (tmp_path / "rates9.csv").write_text("a;b\n9;9\n")
    done, ledger = importing.run(spark, str(tmp_path), ledger, by_name, work)
    assert done.rows_read == 2 and seen[1] == [("rates9.csv", 0), ("rates9.csv", 1)]
    ledger = spark.createDataFrame(ledger.collect(), importing.LEDGER)
    done, again = importing.run(spark, str(tmp_path), ledger, by_name, work)
    assert (done.rows_read, done.kinds, again.count()) == (0, set(), 7)
    (tmp_path / "rates1.csv").write_text("a;b;c\n")  # changed
    done, _ = importing.run(spark, str(tmp_path), ledger, by_name, work)
    assert done.rows_read == 1


def test_a_failure_costs_its_own_file_alone(spark, tmp_path, empty):
    (tmp_path / "rates1.csv").write_text("a;b\n1;2")
    (tmp_path / "rates2.csv").write_text("bad;b")
    (tmp_path / "forms1.csv").write_text("x;y")
    (tmp_path / "other.csv").write_text("p;q")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    kept = []

    def rates(rows):
        if rows.where("exists(cells, c -> c = 'bad')").count():
            raise ValueError("a bad row")
        kept.extend(r.file for r in rows.select("file").distinct().collect())

    def forms(rows):
        raise RuntimeError("a bad loader")

    told = []
    done, ledger = importing.run(spark, str(tmp_path), empty, lambda rows: by_name(rows).withColumn("tax", F.lit("tn")), {"rates": rates, "forms": forms}, after=told.append, totals=told.append)
    assert names(kept) == ["rates1.csv"] and names(done.loaded["rates"]) == ["rates1.csv"] and set(done.loaded) == {"rates"}
    assert {n.rsplit("/", 1)[1]: w.split(":")[0] for n, w in done.failed.items()} == {"rates2.csv": "ValueError", "forms1.csv": "RuntimeError", "broken.zip": "BadZipFile"}
    assert names(r.file for r in done.outcomes.where("state = 'unknown'").collect()) == ["other.csv"]
    assert names(r.path for r in ledger.collect()) == ["rates1.csv"] and told == [["tn"], {"rates"}]


def test_a_stream_of_files(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    (folder / "rates1.csv").write_text("a;b\n1;2")
    (folder / "bad.zip").write_bytes(b"no")
    (folder / "forms1.csv").write_text("x;y")
    seen = []

    def fails(rows):
        raise RuntimeError("no")

    work = {"rates": lambda rows: seen.append(rows.count()), "forms": fails}
    importing.stream(spark, str(folder), str(state), by_name, work)
    assert seen == [2]
    (folder / "rates2.csv").write_text("a;b\n1;2\n3;4")
    importing.stream(spark, str(folder), str(state), by_name, work)
    importing.stream(spark, str(folder), str(state), by_name, work)
    assert seen == [2, 3]
    got = {r.file.rsplit("/", 1)[1]: (r.state, r.batch) for r in importing.outcomes(spark, str(state)).collect()}
    assert got == {"rates1.csv": ("loaded", 0), "forms1.csv": ("failed", 0), "bad.zip": ("failed", 0), "rates2.csv": ("loaded", 1)}
    assert names(r.path for r in spark.read.parquet(str(state / "ledger")).collect()) == ["rates1.csv", "rates2.csv"]


def test_files_of_every_kind_in_one_run(spark, tmp_path, empty):
    (tmp_path / "one.csv").write_bytes("Сведения\nКод региона;Налог;Ставка;Объект\n77;транспортный;5;Лодки\n".encode("cp1251"))
    (tmp_path / "two.csv").write_text("Ставка,Регион,Налог\n7,Московская область,транспортный\n8,Атлантида,транспортный\n", encoding="utf-8")
    (tmp_path / "form.csv").write_text("n;code;v\n" + "".join(f"r;{c};{k}\n" for k, c in enumerate((1100, 1200, 1300, 1400, 1500))))
    (tmp_path / "taxrates.xml").write_bytes(SAMPLE.encode("cp1251"))
    with zipfile.ZipFile(tmp_path / "packed.zip", "w") as z:
        z.writestr("in/more.xml", SAMPLE.encode("cp1251"))
    codes = spark.createDataFrame([("tn", str(c)) for c in (1100, 1200, 1300, 1400, 1500)], "tax_code string, row_code string")
    region = spark.createDataFrame([("77", "Москва"), ("50", "Московская область")], "code string, name string")
    alias = spark.createDataFrame([("tn", "транспортный"), ("zn", "земельный")], "tax_code string, alias string")
    got = {}

    def kinds(rows):
        return importing.classify(rows, codes, importing.bind_headers(rows, ALIASES, ["ставка"]))

    def rates(rows):
        records = importing.named_records(rows, importing.bind_headers(rows, ALIASES, ["ставка"]), list(ALIASES))
        loaded = loading.norms(records, region, alias, source=F.element_at(F.split("file", "/"), -1))
        got["stats"] = loading.save(loaded, lambda x: got.update(rates=sorted((r.source_file, r.region_code, r.rate_value) for r in x.collect())), lambda x: x.count())

    def exports(rows):
        got["export"] = sorted((r.source_file, r.region_code, r.tax_code) for r in loading.norms_of_export(*importing.exports_of(spark, rows), region, alias).rates.collect())

    done, ledger = importing.run(spark, str(tmp_path), empty, kinds, {"rates": rates, "rates-xml": exports, "forms": lambda rows: got.update(forms=rows.count())})
    assert got["rates"] == [("one.csv", "77", 5.0), ("two.csv", "50", 7.0)]
    assert got["stats"] == {"rows_read": 3, "rates": 2, "benefits": 0, "skipped": 1, "unmapped_regions": ["Атлантида"], "unmapped_taxes": []}
    assert got["export"] == [("packed.zip", "77", "tn"), ("taxrates.xml", "77", "tn")] and got["forms"] == 6
    assert {k: names(v) for k, v in done.loaded.items()} == {"rates": ["one.csv", "two.csv"], "forms": ["form.csv"], "rates-xml": ["packed.zip", "taxrates.xml"]}
    assert done.taxes == ["tn"] and ledger.count() == 5
    rows = delimited.read_tables(spark, str(tmp_path), "two.csv")
    assert importing.named_records(rows, importing.bind_headers(rows, ALIASES, ["ставка"]), ["rate_value"], most=1).count() == 1
