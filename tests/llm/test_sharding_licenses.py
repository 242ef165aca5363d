"""Operators 5 and 8 against brute force."""

import zlib

import duckdb
import pytest

from levylens.llm import licenses, sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'b' AS law", "0 AS shard", "'p' AS path")


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    rows = [(i, None if i == 5 else "copy" * 50 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(900)]
    got = sharding.shard(docs(spark, rows).repartition(5), 16, law).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        text = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), law, None)
        sizes[r.shard] = sizes.get(r.shard, 0) + (r.size if law == "bytes" else 1)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    most = max(len((t or "").encode()) + 1 for _, t in rows) if law == "bytes" else 1
    mean = sum(sizes.values()) / 16
    assert all(abs(v - mean) <= most for v in sizes.values())


def test_shards_ties_and_few_rows(spark):
    rows = [(7, "a")] * 5 + [(8, "b"), (None, "c")]
    got = sharding.shard(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [7] * 5 + [8]
    assert len({(r.shard, r.slot) for r in got}) == 6
    assert sharding.shard(docs(spark, rows).where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("law,partitions", [("bytes", 4), ("rows", 4), ("bytes", 100), ("rows", 100)])
def test_shards_are_those_of_a_sort(spark, law, partitions):
    import xxhash

    rows = [(i * 7 - 900, "same" if i % 4 == 0 else "y" * 40_000 if i == 33 else f"t{i} " * (i % 30)) for i in range(700)]
    path = lambda i, t: f"{xxhash.xxh64_intdigest(t.encode(), 42):016X}{i % (1 << 64):016X}"
    order = sorted(rows, key=lambda r: path(*r))
    weight = [len(t) + 1 if law == "bytes" else 1 for _, t in order]
    want, slots, done = {}, [0] * 16, 0
    for (i, _), w in zip(order, weight):
        done += w
        k = min(15, (done * 16 - 1) // sum(weight))
        want[i] = (k, slots[k])
        slots[k] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs(spark, rows), 16, law).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_rows_keep_the_law(spark):
    rows = [(7, "a")] * 40 + [(100 + i, f"b{i}") for i in range(40)]
    for law in ("rows", "bytes"):
        got = sharding.shard(docs(spark, rows), 16, law).collect()
        counts = [sum(r.shard == k for r in got) for k in range(16)]
        weights = [sum(r.size if law == "bytes" else 1 for r in got if r.shard == k) for k in range(16)]
        assert set(counts) == {5} if law == "rows" else all(abs(16 * w - sum(weights)) < 16 * 4 for w in weights)
        assert all(sorted(r.slot for r in got if r.shard == k) == list(range(counts[k])) for k in range(16))


def test_a_tolerance_ends_probes_early(spark):
    rows = [(i, f"text {i}") for i in range(3_000)]
    sizes = {}
    for r in sharding.shard(docs(spark, rows), 16, "bytes", tolerance=0.2).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(v - mean) <= 0.4 * mean for v in sizes.values())


LICENSE_ROWS = [
    (0, None),
    (1, ""),
    (2, "Copyright (c) 2020 Someone\n" + licenses.KNOWN[8][1].upper().replace(",", " ,")),
    (3, "Some prose.\nReleased under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    (4, "released under the mit license and more words"),
    (5, "Copyright 2020 A\nCopyright 2021 B"),
    (6, "LICENSED UNDER CC BY 4.0"),
    (7, "x" * 100_000 + " license"),
]


def test_license_scan(spark):
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.scan(docs(spark, LICENSE_ROWS)).collect()}
    none = (None, 0, "")
    assert got == {0: none, 1: none, 2: ("MIT", 0, ""), 3: (None, 3, "CC-BY-NC-4.0,MIT"), 4: none, 5: none, 6: ("CC-BY-4.0", 1, "CC-BY-4.0"), 7: none}


def test_entire_texts_are_known(spark):
    whole = {}
    for name, text in licenses.entire_texts():
        whole.setdefault(name, text)
    assert set(whole) == {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib"}
    rows = []
    for name, text in sorted(whole.items()):
        with open(f"{licenses.TEXTS}/{name}.txt", encoding="utf-8") as f:
            text = f.read()
        rows += [(name, "Copyright (c) 2024, Someone & Sons\n\n" + text), (name, text.upper().replace(",", " ,\t")), (None, text[:-40]), (None, text + " and more")]
    rows.append(("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2011, A\nAll rights reserved.\n\n" + open(f"{licenses.TEXTS}/BSD-3-Clause.txt", encoding="utf-8").read().replace("* ", "1. ", 1).replace("* ", "2. ", 1).replace("* ", "3. ", 1)))
    rows += [(None, "license " + "very long " * 200_000), ("MIT", "(C) x\n" * 50_000 + licenses.KNOWN[8][1])]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_license_scan_matches_sql(spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(LICENSE_ROWS, columns=["doc_id", "text"]))
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, license, n_notices, notices FROM ({licenses.oracle()})").fetchall()))
    assert sorted((r.doc_id, r.license, r.n_notices, r.notices) for r in licenses.scan(docs(spark, LICENSE_ROWS)).collect()) == want


def test_license_scan_repeated_and_empty(spark):
    rows = docs(spark, [(1, "Licensed under CC BY-NC 4.0.")] * 3)
    assert [r.n_notices for r in licenses.scan(rows).collect()] == [1, 1, 1]
    assert licenses.scan(rows.where("doc_id = 2")).count() == 0


def test_license_scan_is_native(spark):
    plan = licenses.scan(docs(spark, LICENSE_ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
