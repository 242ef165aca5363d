"""Operator 2 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from levylens.llm import repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if n[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def say(rng, n):
    return "".join(rng.choices("abcdefgh ,é", k=n))


def case(seed):
    rng = random.Random(seed)
    shared = [say(rng, k) for k in (150, 198, 199, 200, 201, 260, 400, 900)]
    rows = [(-1, None), (-2, ""), (-3, "z" * 700), (-4, "ab" * 300), (-5, "z" * 199), (-6, say(rng, 30_000))]
    for i in range(60):
        t = say(rng, rng.randint(0, 500))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(shared)
            a = rng.choice([0, 0, rng.randrange(60)])
            t += p[a : len(p) - rng.choice([0, 0, 30])] + say(rng, rng.randint(0, 120))
        rows.append((i, t))
    base = say(rng, 1500)
    for i in range(100, 125):  # near copies
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    return rows + [(200, base), (201, base), (5, rows[8][1]), rows[9], (300, rows[7][1] * 2)]


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, hot):
    rows = case(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS row").repartition(6)
    assert sorted(map(tuple, repeats.digests(df, hot).collect())) == brute(rows)


def test_small_chunks_and_indexes(spark, monkeypatch):
    rows = case(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 2000)
    assert sorted(map(tuple, repeats.digests(df).collect())) == brute(rows)


def test_index_finds_every_window():
    rng = random.Random(4)
    base = say(rng, 500).encode()
    contexts = [bytes(base[a : a + rng.randint(200, 320)]) for a in (rng.randrange(250) for _ in range(30))] + [say(rng, 260).encode()]
    n = Counter(c[k : k + 200] for c in contexts for k in range(len(c) - 199))
    want = [(i, k) for i, c in enumerate(contexts) for k in range(len(c) - 199) if n[c[k : k + 200]] > 1]
    assert list(zip(*(x.tolist() for x in repeats.repeated_windows(contexts)))) == want


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert repeats.digests(df.where("doc_id > 1")).count() == 0
