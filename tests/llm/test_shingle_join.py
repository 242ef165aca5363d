"""Operator 9 against brute force."""

import random
import re

import numpy as np
import pytest

from levylens.llm import common, shingle_join as sj


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                label[b] = a
    best: dict = {}
    for i in range(len(rows)):
        best[root(i)] = min(best.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), best[root(i)]) for i in range(len(rows)))


def case(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one  two"), (907, "two one")]
    i = 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 5, 9, 12, 20, 40, 80, 200]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t += rng.choices(vocab, k=rng.randint(1, 3))
            rows.append((i, " ".join(t)))
            i += 1
    return rows + [(0, rows[8][1])]


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_matches_brute_force(spark, n, percent, seed):
    rows = case(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "'g' AS grp").repartition(5)
    assert sorted(map(tuple, sj.join(df, n, percent).collect())) == brute(rows, n, percent)


@pytest.mark.parametrize("cluster_blocks", [0, 4, 99])
def test_blocks_of_a_large_group(spark, monkeypatch, cluster_blocks):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(sj, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(sj, "CLUSTER_BLOCKS", cluster_blocks)
    monkeypatch.setattr(sj, "COLUMNS", 16)
    assert sorted(map(tuple, sj.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())) == brute(rows, 3, 90)


def test_signatures_lose_no_link():
    rng = np.random.default_rng(6)
    for n in (9, 10, 12, 19, 25, 40, 77, 150, 400):
        for percent in (80, 90):
            for _ in range(150):
                union = rng.integers(0, 1 << 63, n).astype(np.uint64)
                cut = n * (100 - percent) // 100
                gone = rng.permutation(n)[:cut]
                side = rng.random(cut) < rng.random()
                x, y = np.delete(union, gone[side]), np.delete(union, gone[~side])
                assert np.intersect1d(sj.signatures(np.sort(x), percent), sj.signatures(np.sort(y), percent)).size, (n, percent)


def test_a_repeated_id_with_two_texts_joins_no_components(spark):
    a = [f"a{i}" for i in range(200)]
    rows = []
    for k in range(8):  # texts just too far apart to link, which share a group
        one = [f"{w}x{k}" for w in a]
        two = one + [f"b{i}x{k}" for i in range(23 + k % 2)]
        d = 10 * k
        rows += [(d + 5, one), (d + 5, two), (d + 2, one[1:]), (d + 3, two + ["end"])]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    seen = {(r.doc_id, r.component_id) for r in sj.join(docs).collect()}
    assert seen == {(10 * k + d, 10 * k + c) for k in range(8) for d, c in ((2, 2), (3, 3), (5, 2), (5, 3))}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sj.join(df.where("doc_id > 1")).count() == 0
    assert [tuple(r) for r in sj.join(df).collect()] == [(1, 1, 1)]
    assert len(common.words(common.one_block("")).hash) == 0


def test_components_of_chains_stars_and_repeated_edges(spark):
    from levylens.llm import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 400)] + [(5, 5), (410, 405), (405, 410)]
    edges += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    rng.shuffle(edges)
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted((n, m) for n, m in label.items() if n != m)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_near_copies_grow_in_proportion(spark, monkeypatch):
    """Of a group of one text's near copies, the products give at most an edge for each class and block it is in."""
    monkeypatch.setattr(sj, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(sj, "CLUSTER_BLOCKS", 0)
    made = []
    whole = sj.products

    def counted(rows, keys, words, percent):
        made.append(common.checkpointed(whole(rows, keys, words, percent)))
        return made[-1]

    monkeypatch.setattr(sj, "products", counted)
    base, got = [f"b{k}" for k in range(150)], []
    for n in (60, 240):
        rows = [(i, " ".join([*base[: i % 140], f"x{i}", *base[i % 140 + 1 :]])) for i in range(n)]
        made.clear()
        out = sj.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
        assert {r.component_id for r in out.collect()} == {0}
        got.append(sum(e.count() for e in made))
    assert got[1] <= 5 * got[0]


def test_one_of_each_by_text_and_with_odd_names(spark):
    a = " ".join(f"a{i}" for i in range(100))
    rows = [(3, a), (5, a + " z"), (5, "another text of six words here"), (5, "another text of six words here"), (8, None), (8, ""), (None, a), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS copy_", "'r' AS row_", "'s' AS stay_id", "'f' AS first_", "1 AS class", "2 AS mark", "'o' AS own0_", "3 AS label")
    out = sj.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((tuple(r) for r in out.collect()), key=repr)
    assert [r[2:] for r in kept] == [("c", "r", "s", "f", 1, 2, "o", 3)] * len(kept)
    assert {(r[0], r[1]) for r in kept} == {(3, a), (5, "another text of six words here"), (None, a), (9, " ")} | {(8, next(r[1] for r in kept if r[0] == 8))} and len(kept) == 5


def test_very_long_texts_and_their_near_copies(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40_000)]
    other = [*words[:20_000], "altered", *words[20_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words))), (4, "\n".join(words).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in sj.join(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert all(r.n_shingles == 39_998 for r in got.values())
