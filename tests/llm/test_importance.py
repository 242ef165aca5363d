"""Operator 13 against brute force and against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from levylens.llm import common, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most_n):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, most_n + 1) for i in range(len(w) - k + 1)]


def brute(rows, aims, most_n=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    rows = [r for r in rows if r[0] is not None]
    s, t = (Counter(bucket(f) for x in texts for f in features(x, most_n)[1]) for texts in ([x for _, x in rows], aims))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        w, f = features(x, most_n)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def case(n=400, seed=2):
    rng = random.Random(seed)
    words = ["the", "The", "ÄÖ", "x1", "слово", "İ", "ı", "n0", "日本", "tax", "rate", "don't", "a-b", "q" * 90] + [f"w{i}" for i in range(200)]
    say = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=k))
    rows = [(i, say(rng.randint(0, 60))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "... --- \x00"), (1003, "one two " * 20_000), (5, "a repeated id " * 9), (None, "no id " * 30), *[(1004, rows[7][1])] * 30]
    return rows, [say(40) for _ in range(20)] + [None, ""]


def frames(spark, rows, aims):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'p' AS payload", "2 AS rank", "3 AS block")
    return docs.repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id long, text string")


@pytest.mark.parametrize("most_n,buckets,most", [(1, 10_000, common.SHARED_BYTES), (1, 10_000, 500), (3, 777, 2_000)])
def test_brute_force(spark, monkeypatch, most_n, buckets, most):
    monkeypatch.setattr(common, "SHARED_BYTES", most)
    rows, aims = case()
    got = importance.resample(*frames(spark, rows, aims), most_n=most_n, buckets=buckets).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, aims, most_n, buckets)
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_matches_sql(spark):
    rows, aims = case(150, 9)
    rows = [r for k, r in enumerate(rows) if r[0] != 5 or k < 150]
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(list(enumerate(aims)), columns=["item_id", "text"]))
    want = con.execute(importance.oracle()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in importance.resample(*frames(spark, rows, aims)).collect())


def test_empty_tables(spark):
    rows, aims = case(40)
    docs, wanted = frames(spark, rows, aims)
    assert importance.resample(docs.where("doc_id < 0"), wanted).count() == 0
    got = importance.resample(docs, wanted.where("item_id < 0")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, [])


def test_ids_and_buckets_are_one_for_each_word_and_tuple(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARED_BYTES", 10)
    docs = spark.createDataFrame([(1, "a b a b"), (2, "B a"), (3, "a b"), (4, None)], "doc_id long, text string").repartition(3)
    blocks = importance.interned(docs, 2).withColumn("own", F.lit(True))
    assert sorted(tuple(map(bytes, r.words)) for r in blocks.collect() if r.words)[0] == (b"a", b"b")
    rows = importance.bucketed(blocks, 2, 100).collect()
    want = Counter()
    for text in ("a b a b", "b a", "a b"):
        for f in features(text, 2)[1]:
            want[zlib.crc32(f.encode()) % 100] += 1
    got = Counter()
    for r in rows:
        got[r.bucket] += r.n
    assert got == want


def test_plan_hashes_after_the_words_are_distinct(spark):
    docs, wanted = frames(spark, *case(60))
    one = importance.interned(docs, 1).withColumn("own", F.lit(True))
    entries = one.select(F.explode("words").alias("w"))
    assert importance.bucketed(one, 1, 10).count() == entries.count() >= entries.distinct().count()
