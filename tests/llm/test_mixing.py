"""Operator 12 against its SQL and against what a mix has to keep."""

import random
import re
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from levylens.llm import mixing


def case(seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) + rng.choice(["", "\t", "\n x", " "]), rng.choice(["hot"] * 6 + ["b", "a", "я", "Z", "", None, "tiny", "zz"])) for i in range(700)]
    rows = [(i, t, s if s != "tiny" or i < 20 else "hot") for i, t, s in rows]
    return [*rows, (900, None, "only null"), (901, "", "empty"), (902, "x " * 30_000, "long"), (3, "one two three", "hot"), (None, "no id", "hot"), *[(77, "one two", "hot")] * 40]


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'q' AS weight", "2 AS key", "3 AS place", "4 AS target")
    return docs, spark.createDataFrame(labels, "doc_id long, quality long").selectExpr("*", "1 AS toxic", "'z' AS source")


LABELS = [(i, i % 2) for i in range(0, 700, 3)] + [(0, 1), (6, None), (None, 1)]


def shares(rows):
    """Targets by the rule as told, round by round, in fractions."""
    size = {}
    for i, t, s in rows:
        if i is not None:
            size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    pool, open_, out = Fraction(3, 2) * sum(size.values()), set(order), {}
    while open_:
        each = pool / sum(weight[s] for s in open_)
        above = {s for s in open_ if each * weight[s] > 2 * size[s]}
        out.update({s: each * weight[s] for s in open_ - above} | {s: Fraction(2 * size[s]) for s in above})
        pool -= sum(2 * size[s] for s in above)
        if not above:
            break
        open_ -= above
    return size, out


def test_mix(spark):
    rows = case()
    docs, labels = frames(spark, rows, LABELS)
    got = mixing.mix(docs.repartition(7), mixing.quality_of(labels)).collect()
    size, target = shares(rows)
    assert len(got) == sum(i is not None for i, _, _ in rows)
    taken, most = {}, {}
    for r in got:
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(float(target[r.source]), rel=1e-12))
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    for s, words in taken.items():  # a document is whole, so the sum is off by half of one at most
        assert abs(words - target[s]) <= most[s] / 2
    again = mixing.mix(docs.repartition(3), mixing.quality_of(labels)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    by_source = {}
    for r in got:
        if r.size:
            by_source.setdefault(r.source, set()).add(r.taken // r.size)
    assert all(max(v) - min(v) <= 1 for v in by_source.values())  # whole epochs come first


def test_matches_sql(spark):
    rows = case(8)
    docs, labels = frames(spark, rows, LABELS)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(LABELS, columns=["doc_id", "quality"]).astype({"doc_id": "Int64", "quality": "Int64"}))
    want = con.execute(mixing.oracle()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in mixing.mix(docs, mixing.quality_of(labels)).collect())


def test_good_documents_come_first(spark):
    docs, labels = frames(spark, [(i, "a b", "s" if i < 4000 else "t") for i in range(4100)], [(i, i % 2) for i in range(4000)])
    got = [r for r in mixing.mix(docs, mixing.quality_of(labels), share=(1, 2)).collect() if r.source == "s"]
    good, bad = (sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


def test_weights_that_are_none_and_an_empty_table(spark):
    docs, _ = frames(spark, case(), LABELS)
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -1.0), (4, 0.0), (5, None)], "doc_id long, weight double")
    assert sorted(map(repr, mixing.mix(docs, odd).collect())) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 900")).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.mix(docs, share=(2, 1))


def test_is_native(spark):
    docs, labels = frames(spark, case(), LABELS)
    plan = mixing.mix(docs, mixing.quality_of(labels))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
