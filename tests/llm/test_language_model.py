"""Operator 3 against plain counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from levylens.llm import language_model as lm


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 1 << 62), (500, 300), (5000, 1 << 62), (3000, 3000)):
        v = np.sort(rng.integers(0, most, n).astype(np.uint64))
        ef = lm.EliasFano.build(v)
        again = lm.EliasFano.of({f"x.{k}": a for k, a in ef.arrays().items()}, "x")
        assert (again.at(np.arange(n)) == v).all()
        keys = np.concatenate([v, rng.integers(0, most, 200).astype(np.uint64), np.array([2**63], np.uint64)])
        at = again.find(keys)
        known = set(v.tolist())
        assert all((a >= 0 and v[a] == k) if int(k) in known else a < 0 for a, k in zip(at, keys))


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_scores(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "The", "of", "x1", "é,", " y"] + [f"w{k}" for k in range(60)], k=rng.randint(0, 50)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "zz " * 20_000), (403, "zz " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS shard")
    got = lm.score(df, shards=5).collect()
    assert len(got) == len(rows)
    uni, pair = Counter(), defaultdict(Counter)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = [*tokens(t), None]
            uni.update(w)
            for a, b in zip(w, w[1:]):
                pair[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    floor = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    text = dict(rows)
    better = 0
    for r in got:
        w = [*tokens(text[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(floor(x)) for x in w), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        # any discount from 0.1 to 0.95 with its quantised part at most a little below
        low = high = math.log10(floor(w[0]))
        for a, b in zip(w, w[1:]):
            ps = [max(pair[a][b] - d, 0) / uni[a] + d * len(pair[a]) / uni[a] * floor(b) if uni[a] else floor(b) for d in (0.1, 0.5, 0.95)]
            low, high = low + math.log10(min(ps) * 0.85), high + math.log10(max(ps))
        assert low * (1 + 1e-9) <= r.score <= high * (1 - 1e-9)
        better += r.score > r.base_score
    assert better > 100


def test_sums_to_at_most_one(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(200)]
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.Model(folder, lm.train(df, folder, 3), 3)
    hashes = np.array([lm.common.word_hash(w) for w in vocab] + [lm.END], np.uint64)
    for c in hashes[:-1]:
        h = np.concatenate([np.stack([np.full(len(hashes), c), hashes], 1).ravel()])
        _, _, own = model.score(h, np.arange(0, len(h), 2))
        assert 0.9 < (10 ** own[1::2]).sum() <= 1 + 1e-9


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = lm.score(df).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0
    assert lm.score(df.where("doc_id < 0")).count() == 0


def test_scores_and_numbers_do_not_depend_on_the_shards(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=rng.randint(0, 60)))) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.score) for r in lm.score(df, shards=n).collect()) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]
    uni, pair = Counter(), defaultdict(Counter)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = [*tokens(t), None]
            uni.update(w)
            for a, b in zip(w, w[1:]):
                pair[a][b] += 1
            pair[None][0] += 1  # an end has a follower of its own
    counts = [n for c in pair.values() for n in c.values()]
    d, least, step = lm.numbers(counts.count(1), counts.count(2), max(uni.values()))
    n, v = sum(uni.values()), len(uni)
    floor = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for (i, score), (_, t) in zip(got[0], sorted(rows)):
        w = [*tokens(t), None]
        want = math.log10(floor(w[0]))
        for a, b in zip(w, w[1:]):
            p = (d * len(pair[a]) / uni[a] if uni[a] else 1.0) * floor(b)
            if pair[a][b]:
                p += 10 ** (least + step * math.floor((math.log10((pair[a][b] - d) / uni[a]) - least) / step))
            want += math.log10(p)
        assert math.isclose(score, want, rel_tol=1e-3), i
