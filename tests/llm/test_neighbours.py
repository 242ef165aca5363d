"""Operator 7 against brute force."""

import numpy as np
import pytest

from levylens.llm import neighbours


def brute(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        o = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in o]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_recall(spark, monkeypatch, hot):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    monkeypatch.setattr(neighbours, "FEW_ROWS", 40)
    monkeypatch.setattr(neighbours, "CELLS", 5_000)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 24)).astype(np.float32).astype(float)
    if hot:
        x[::3] = x[0]
    ids = np.arange(1200)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [float("nan")] * 24, 1), (5060, [None] + [1.0] * 23, 1), (5080, [1.0], 1), (None, [1.0] * 24, 1)]
    got = neighbours.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")).collect()
    want = brute(ids, x, 20, 20)
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(want)
    hits = 0
    for q, rows_q in found.items():
        assert [a for a, _, _ in rows_q] == list(range(1, 21))
        assert [b for _, b, _ in rows_q] == [b for _, b, s in sorted(rows_q, key=lambda t: (-t[2], t[1]))]
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows_q)
        bar = want[q][-1][1]
        hits += sum(s >= bar - 1e-9 for _, _, s in rows_q)
    assert hits >= 0.9 * 20 * len(want)


def clustered(n, d=64, size=100, cosine=0.9, seed=3):
    """Unit vectors in clusters, members of one at about this cosine, with a few rows copied."""
    rng = np.random.default_rng(seed)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    centre = unit(rng.standard_normal((n // size, d)))[rng.integers(0, n // size, n)]
    x = unit(np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * unit(rng.standard_normal((n, d))))
    x[1 : n // 10 : 20] = x[0 : n // 10 : 20]
    return x.astype(np.float32).astype(float)


def test_near_pairs_are_not_abandoned(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 1200)
    monkeypatch.setattr(neighbours, "FEW_ROWS", 300)
    x = clustered(4000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(np.arange(4000), x, 20, 20)
    found = {(r.query_id, r.vec_id) for r in got}
    true = {(q, v) for q, near in want.items() for v, _ in near}
    assert len(found & true) >= 0.95 * len(true)
    copies = {(q, q + 1) for q in range(0, 400, 20)}
    assert copies <= true and len(copies & found) >= 0.95 * len(copies)


def test_a_scan_that_loses_neighbours_is_seen(spark, monkeypatch):
    whole = neighbours.scan

    def lossy(*given):
        q, v, score = whole(*given)
        keep = v % 2 == 0
        return q[keep], v[keep], score[keep]

    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    monkeypatch.setattr(neighbours, "FEW_ROWS", 200)
    monkeypatch.setattr(neighbours, "scan", lossy)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1000))]
    with pytest.warns(UserWarning, match="recall of 0[.][45]"):
        neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count()


def test_scan_keeps_all_that_reach_the_bar():
    x = clustered(3000)
    ids, turn = np.arange(3000), neighbours.rotation(64)
    turned = x @ turn.T
    rest = np.stack([np.sqrt((turned[:, at + neighbours.COLUMNS :] ** 2).sum(1)) for at in range(0, 64, neighbours.COLUMNS)], axis=1)
    want = brute(ids, x, 20, 20)
    q = np.array(sorted(want))
    bars = np.array([want[i][-1][1] for i in q.tolist()])
    a, b, _ = neighbours.scan(x[q], q, bars, x, turned, rest, turn, ids, 20)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) >= {(i, v) for i, near in want.items() for v, _ in near}


def test_few_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 4, 0.5), (0, 2, 20, 0.5), (0, 3, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5), (20, 3, 4, 0.5)]
    assert neighbours.search(df.where("vec_id > 99")).count() == 0
    assert neighbours.search(df.where("vec_id = 3")).count() == 0


def test_a_repeated_id_is_one_candidate_with_its_first_vector(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.9, 0.1]), (3, [0.9, 0.1]), (3, [0.1, 0.9]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS query_id", "2 AS score", "'x' AS rank")
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.search(df).collect())
    assert got == [(1, 7, 0.5), (2, 3, 0.1)]
