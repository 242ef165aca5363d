"""The splittable scan of delimited files against the csv module, for blocks of any size."""

import csv
import io
import random

import duckdb
import pytest

from levylens.plans import loads  # noqa: F401  registers its queries
from levylens.plans.queries import ORACLES, QUERIES
from levylens.sources import delimited, ragged


def planted(seed, delimiter=";", end="\n", n=60):
    rng = random.Random(seed)
    say = lambda: rng.choice(["", "x", "77", "Москва", 'say "hi"', "two\nlines", "a\r\nb\nc", f"p{delimiter}q", '"', '""', " sp ", "long " * 30, "1\n" * 5])
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator=end)
    writer.writerow(["Сведения о ставках"])
    writer.writerow([])
    for _ in range(n):
        writer.writerow([say() for _ in range(rng.randint(1, 6))])
    return out.getvalue() + f'plain 5" pipe{delimiter}x"y{end}"open and shut"tail{delimiter}z{end}{end}last{delimiter}"un closed{end}one{delimiter}two'


def read(spark, path, block, **options):
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{key}", block)
    try:
        rows = ragged.read_ragged(spark, path, **options)
        return {(r.file.rsplit("/", 1)[1], r.row_idx): r.cells for r in rows.collect()}
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


def want(text, delimiter):
    return [[delimited.clean_cell(c) for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]


@pytest.mark.parametrize("block", ["128m", 5_000, 700, 90, 17])
def test_rows_are_those_of_the_csv_module(spark, tmp_path, block):
    n = 60 if block == "128m" or block > 100 else 9
    made = {"a.csv": (planted(1, n=n), ";", "utf-8"), "b.csv": (planted(2, ",", "\r\n", n), ",", "cp1251"), "c.csv": (planted(3, "\t", n=n), "\t", "cp1251")}
    for name, (text, _, encoding) in made.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = read(spark, str(tmp_path), block)
    for name, (text, delimiter, _) in made.items():
        rows = want(text, delimiter)
        mine = [got[name, k] for k in range(len(rows))]
        assert mine == rows, name
    assert len(got) == sum(len(want(t, d)) for t, d, _ in made.values())


def test_state_of_a_line():
    rng = random.Random(9)
    for _ in range(3_000):
        line = "".join(rng.choices(['"', ";", "a", '""', ' "'], k=rng.randint(0, 12)))
        for inside in (False, True):
            text = ('"in\n' if inside else "") + line + "\nZ"
            rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))
            assert ragged.ends_inside(line.encode(), b";", inside) == (rows[-1] != ["Z"]), (line, inside)


def test_read_ragged_agrees_with_read_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("Отчёт\nКод;Имя;Ставка\n77;Москва;2,2 %\n\n50;Область\n".encode("cp1251"))
    key = lambda r: (r.table, r.table_at, r.row_idx, r.cells)
    assert sorted(map(key, ragged.read_ragged(spark, str(tmp_path)).collect())) == sorted(map(key, delimited.read_tables(spark, str(tmp_path)).collect()))
    assert [r.cells for r in ragged.read_ragged(spark, str(tmp_path), delimiter="|", encoding="cp1251").orderBy("row_idx").collect()][1] == ["Код;Имя;Ставка"]
    with pytest.raises(ValueError):
        ragged.read_ragged(spark, str(tmp_path), delimiter="/")


def test_no_delimited_file_is_read_whole(spark, tmp_path, monkeypatch):
    """Files of tables are dealt by blocks; those of wide letters, and no others, go as a whole to one task."""
    folder = tmp_path / "with 5% + space"
    folder.mkdir()
    made = {"a.csv": (planted(1), ";", "utf-8"), "б.TXT": (planted(2, ","), ",", "cp1251"), "c.tsv": (planted(3, "\t"), "\t", "utf-16"), "bad.csv": ('x;y\n"' + "long\n" * 150_000 + '";z\n1;2\n', ";", "utf-8")}
    for name, (text, _, encoding) in made.items():
        (folder / name).write_bytes(text.encode(encoding))
    whole, tables_of = [], delimited.tables_of
    monkeypatch.setattr(delimited, "tables_of", lambda found: (whole.extend(r.path for r in found.collect()), tables_of(found))[1])
    for block in (100_000, 20_000):
        whole.clear()
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.set(f"spark.sql.files.{key}", block)
        try:
            rows = delimited.read_tables(spark, str(folder)).collect()
        finally:
            for key in ("maxPartitionBytes", "openCostInBytes"):
                spark.conf.unset(f"spark.sql.files.{key}")
        assert whole == [f"file:{folder}/c.tsv"]
        assert {r.file for r in rows} == {f"file:{folder}/{name}" for name in made}
        for name, (text, delimiter, _) in made.items():
            mine = [(r.table, r.row_idx, r.cells) for r in rows if r.file.endswith(f"/{name}")]
            if name == "bad.csv":
                assert ("error", 0, ["Error", "field larger than field limit (131072)"]) in [(t, 0, c) for t, _, c in mine] and len(mine) == 3
            else:
                assert sorted(mine) == [("csv", k, cells) for k, cells in enumerate(want(text, delimiter))]


@pytest.mark.parametrize("block", ["128m", 60_000])
def test_cells_of_any_length_are_read(spark, tmp_path, block):
    """the csv module's limit of 131,072 letters ends no scan, whether a cell is quoted or not and wherever its blocks lie."""
    long = ["x" * 131_073, "word;\n" * 40_000, 'say "hi"' * 20_000, "ё" * 140_000]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n").writerows([["a", "b"], *([k, cell, "end"] for k, cell in enumerate(long)), ["y", "z"]])
    (tmp_path / "long.csv").write_text(out.getvalue(), encoding="utf-8")
    got = read(spark, str(tmp_path), block, encoding="utf-8", delimiter=";")
    rows = [["a", "b"], *([str(k), delimited.clean_cell(cell), "end"] for k, cell in enumerate(long)), ["y", "z"]]
    assert [got["long.csv", k] for k in range(len(rows))] == rows and len(got) == len(rows)


def test_a_line_of_any_length_is_read(spark, tmp_path):
    (tmp_path / "long.csv").write_bytes(b'1;"' + b"a" * (33 << 20) + b'\nb";x\n2;c;y\n')
    rows = ragged.read_ragged(spark, str(tmp_path), encoding="utf-8", delimiter=";").selectExpr("row_idx", "length(cells[1])", "cells[2]").collect()
    assert sorted(map(tuple, rows)) == [(0, (33 << 20) + 2, "x"), (1, 1, "y")]


def test_ragged_scan_of_long_texts_nulls_and_marks(spark, tmp_path):
    """the query's rows are those of its SQL."""
    docs = [
        (1, 'two\n"lines"; and', "en", "s1"), (2, "x" * 131_073, "de", "s2"), (3, "word\n" * 40_000, "en", "s3"), (None, "text", "en", "s"), (5, "text", None, "s"), (None, None, None, None),
        (7, "", "", ""), (8, "text", 'e;"n', ' s  –\n"'), (9, "a\rb\r\nc\0d", "=", "%41+ ё"),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["ragged_scan"]).fetchall()
    assert sorted(map(tuple, QUERIES["ragged_scan"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
