"""Operator 4 on planted texts."""

import random
import zlib

import numpy as np

from levylens.llm import common, toxicity


def corpus(n=900):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    slurs = ["zorgle", "wexxim", "qualdor"]  # unknown to the fixed list
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = rng.choices(words, k=rng.randint(20, 60))
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(slurs))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "x" * 50_000)], labels


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5D AS score")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.learn(d, lab)).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97


def test_no_labels_and_one_kind(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.learn(d, none)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 0, 1) for i in range(1, 30)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.learn(d, one)).collect()} == {1.0}
    assert toxicity.score(d.where("doc_id > 5"), toxicity.learn(d, one)).count() == 0


def test_features_see_obfuscation_and_you():
    lex = toxicity.Lexicon()
    plain, veiled, near, far = toxicity.features(common.one_block("he is an idiot ok", "he is an 1d10t ok", "you are an idiot", "you are a b c d idiot"), lex)
    assert plain[6] > 0 and veiled[6] == 0 and veiled[9] > 0 and plain[9] == 0
    assert near[10] > 0 and far[10] == 0


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    s = rng.random(500)
    knots, values = toxicity.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_scores_do_not_depend_on_the_order_of_rows_that_share_an_id(spark):
    docs, labels = corpus(400)
    twice = docs + [(i, t[::-1]) for i, t in docs if t]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = []
    for rows in (twice, twice[::-1]):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got.append(sorted((r.doc_id, r.score) for r in toxicity.score(d, toxicity.learn(d, lab)).collect()))
    assert got[0] == got[1] and len(got[0]) == len(twice)


def test_trees_take_the_best_of_all_splits(monkeypatch):
    """Each node's split and each leaf against a search over all features and cuts, tree by tree."""
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = (x[:, 0] + (x[:, 1] > 0.3) * (x[:, 2] < 0) * 2 + rng.normal(size=400) * 0.3 > 0.5).astype(float)
    model = toxicity.fit_trees(x, y)
    cuts = [np.unique(np.append(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1]), 0.0)) for c in x.T]
    margin = np.full(400, np.log(y.mean() / (1 - y.mean())))
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q) + 1e-9
        gain = lambda a, b: g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - g[a | b].sum() ** 2 / (h[a | b].sum() + 1)
        at = np.zeros(400, int)
        for node in range(2**toxicity.DEPTH - 1):
            here = at == node
            tried = [(gain(here & (c <= t), here & (c > t)), f, t) for f, c in enumerate(x.T) for t in cuts[f] if h[here & (c <= t)].sum() >= 0.5 and h[here & (c > t)].sum() >= 0.5] if here.sum() >= 10 else []
            best = max((v for v, _, _ in tried), default=0)
            if best > 1e-6:
                mine = x[:, feature[node]]
                assert np.isclose(gain(here & (mine <= cut[node]), here & (mine > cut[node])), best)
            else:
                assert np.isinf(cut[node])
            at[here] = 2 * node + 1 + (x[here, feature[node]] > cut[node])
        want = [-toxicity.RATE * g[at == k].sum() / (h[at == k].sum() + 1) for k in range(2**toxicity.DEPTH - 1, 2 ** (toxicity.DEPTH + 1) - 1)]
        assert np.allclose(leaf, want)
        margin += np.array(want)[at - (2**toxicity.DEPTH - 1)]
    assert np.allclose(model.margin(x), margin)


def test_isotonic_by_definition():
    """The calibration's pools against the greatest least mean, the closed form of isotonic regression."""
    rng = np.random.default_rng(8)
    s = np.round(rng.random(60), 2)
    y = (rng.random(60) < s).astype(float)
    knots, values = toxicity.isotonic(s, y)
    levels = np.unique(s)
    means = [max(min(y[(s >= a) & (s <= b)].mean() for b in levels if b >= v) for a in levels if a <= v) for v in levels]
    for v, m in zip(levels, means):
        pool = [w for w, n in zip(levels, means) if np.isclose(n, m)]
        inside = (s >= pool[0]) & (s <= pool[-1])
        assert np.isclose(np.interp(v, knots, values), (y[inside].sum() + y.mean()) / (inside.sum() + 1))


def test_lexicon_and_features_by_hand(spark):
    docs, labels = corpus(300)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = {r.doc_id: (r.toxic, r.fold) for r in toxicity.training_rows(lab).collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in train) and len(train) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in labels)
    first = [(set(docs[i][1].split()), t) for i, (t, f) in train.items() if f < 4]
    bad, good = sum(t for _, t in first), sum(1 - t for _, t in first)
    odds = {w: np.log((sum(t for x, t in first if w in x) + 0.5) / (bad + 1)) - np.log((sum(1 - t for x, t in first if w in x) + 0.5) / (good + 1)) for w in set().union(*(x for x, _ in first))}
    want = sorted(common.word_hash(w) for w, o in odds.items() if o >= toxicity.ODDS and sum(t for x, t in first if w in x) >= toxicity.LEAST)
    model = toxicity.learn(d, lab)
    assert model.lexicon.words.tolist() == want and want
    assert len(toxicity.learn(d, lab, lexicon_size=2).lexicon.words) + len(toxicity.learn(d, lab, lexicon_size=2).lexicon.beginnings) == 2
    assert len(toxicity.learn(d, lab, least=10_000).lexicon.words) == 0
    known = set(want)
    for (i, text), row in zip(docs[:50], toxicity.features(common.one_block(*[t for _, t in docs[:50]]), model.lexicon)):
        hits = [w for w in text.split() if common.word_hash(w) in known]
        assert np.allclose([row[0], row[1], row[2], row[3]], [np.log1p(len(text.split())), np.log1p(len(hits)), len(hits) / len(text.split()), np.log1p(len(set(hits)))])


def test_labels_with_clashing_names(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    plain = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = plain.selectExpr("*", "'z' AS text", "1 AS fold", "2 AS kind", "3 AS token")
    got = [sorted((r.doc_id, r.score) for r in toxicity.score(d, toxicity.learn(d, x)).collect()) for x in (plain, odd)]
    assert got[0] == got[1]
