"""Operator 4: toxicity by gradient-boosted trees over dense features.

Labelled training rows, at most SAMPLE of them (those with the least hash of their id), are dealt by
another hash to three folds. The first gives a lexicon: words, and beginnings of words, that are far
likelier in texts labelled toxic; a list of fixed words joins it. The second, whose features the
lexicon has not seen, fits the trees; the third fits the isotonic calibration. Then every text is
scored in one pass over the table, without an exchange.

Features: densities and counts of lexicon words, their distinct number, word beginnings, fixed words,
and words that fit only once digits and symbols are read as letters; lexicon words near a
second-person word; second-person words; capitals; words in capitals; exclamation and question marks;
other symbols; the text's length.

Defined cases: null and empty texts get the score of their (all zero) features; without any usable
training label of both kinds every score is the share of label 1, or 0 without labels; a row without
doc_id takes no part; repeated rows get equal scores; a doc_id labelled twice counts once, as toxic if
any of its labels says so; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are learned from at most, and lexicon entries kept at most; parameters of learn(), as are the next two.
SAMPLE, LEXICON = 24_000, 4_000
#: A lexicon entry is in at least LEAST toxic texts of the fold, and its log odds there are at least ODDS.
LEAST, ODDS = 4, 2.0
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
THRESHOLD = 0.7
# Insults and second-person words.
INSULTS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool imbecile jerk bastard bitch asshole shit fuck fucking crap hate kill idiota imbécile crétin connard salaud merde estúpido imbécil basura mierda dummkopf arschloch scheiße trottel abschaum".split()
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos tú usted ustedes vosotros du dich dir dein deine euch ihr".split()
LEET = {ord(a): ord(b) for a, b in zip("013457@$", "oieastas")}
BEGINNINGS = (4, 5, 6)
NEAR = 3

_gap = np.ones(256, bool)
_gap[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_leet_gap = _gap.copy()
_leet_gap[list(LEET)] = False
_leet = common.folding(LEET)
_upper, _mark, _symbol = (np.isin(np.arange(256), x) for x in (range(65, 91), [33, 63], [*range(35, 39), 42, 43, 60, 61, 62, 64, 94, 126]))
FEATURES = 16


def _hashes(listed: list[str]) -> np.ndarray:
    return np.sort(np.array([common.word_hash(w) for w in listed], np.uint64))


def _in(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(listed, x), len(listed) - 1)
    return listed[at] == x


_fixed, _you = _hashes(INSULTS), _hashes(YOU)


def _beginnings(w: common.Words) -> list[np.ndarray]:
    """Hashes of the first bytes of words that are longer, 0 for others."""
    out = []
    for k in BEGINNINGS:
        long = w.end - w.start > k
        h = np.zeros(len(w.hash), np.uint64)
        h[long] = common.mix(common.hash_slices(w.folded, w.start[long], w.start[long] + k) + np.uint64(k))
        out.append(h)
    return out


@dataclass
class Lexicon:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    beginnings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def features(block: common.Block, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each document."""
    w, v = common.words(block, _gap), common.words(block, _leet_gap, _leet)
    known = _in(w.hash, lexicon.words)
    fixed, you = _in(w.hash, _fixed), _in(w.hash, _you)
    begun = np.zeros(len(w.hash), bool)
    for h in _beginnings(w):
        begun |= _in(h, lexicon.beginnings)
    bad = known | fixed | begun
    size = np.diff(block.offsets)
    total = lambda x, first: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    share = lambda x, n: x / np.maximum(n, 1)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(block.ids)), n)
    near = np.zeros(len(bad), bool)
    for k in range(1, NEAR + 1):
        near[k:] |= you[:-k] & (doc[k:] == doc[:-k])
        near[:-k] |= you[k:] & (doc[k:] == doc[:-k])
    kinds = np.unique(np.stack([doc[known], w.hash[known].astype(np.int64) & 0xFFFFFFFF]), axis=1)[0] if known.any() else np.zeros(0, np.int64)
    veiled = _in(v.hash, lexicon.words) | _in(v.hash, _fixed)
    caps = np.concatenate([[0], np.cumsum(_upper[block.data])])
    shouted = (caps[w.end] - caps[w.start] == w.end - w.start) & (w.end - w.start > 1)
    hits, starts = total(known, w.first), total(begun, w.first)
    return np.stack([
        np.log1p(n), np.log1p(hits), share(hits, n), np.log1p(np.bincount(kinds, minlength=len(n))),
        np.log1p(starts), share(starts, n), share(total(fixed, w.first), n), np.log1p(total(bad, w.first)), share(total(bad, w.first), n),
        np.log1p(np.maximum(0, total(veiled, v.first) - total(known | fixed, w.first))),
        share(total(bad & near, w.first), n), share(total(you, w.first), n),
        share(total(_upper[block.data], block.offsets), size), share(total(shouted, w.first), n),
        share(total(_mark[block.data], block.offsets), size), share(total(_symbol[block.data], block.offsets), size),
    ], axis=1)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete binary trees: feature and cut of every inner node, value of every leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = BINS + 2
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    margin, inner = np.full(len(y), base), 2**DEPTH - 1
    trees = []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q) + 1e-9
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) >= 10:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    gl = np.cumsum(np.bincount(bins[rows, f], g[rows], width))[: len(edges[f])]
                    hl = np.cumsum(np.bincount(bins[rows, f], h[rows], width))[: len(edges[f])]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 0.5) | (hs - hl < 0.5)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, edges[f][k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = -RATE * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + 1)
        margin += leaf[at - inner]
        trees.append((feature, cut, leaf))
    return Trees(base, *(np.stack(t) for t in zip(*trees, strict=True)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising step function, smoothed towards the overall share by one row a pool."""
    levels, at, n = np.unique(score, return_inverse=True, return_counts=True)  # equal scores are one row of their sum
    pools: list[list[float]] = []  # sum, weight, least and greatest score
    for s, v, w in zip(levels.tolist(), np.bincount(at, y, len(levels)).tolist(), n.tolist(), strict=True):
        pools.append([v, w, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v1, w1, _, s1 = pools.pop()
            pools[-1] = [pools[-1][0] + v1, pools[-1][1] + w1, pools[-1][2], s1]
    mean = y.mean() if len(y) else 0.0
    knots, values = [], []
    for v, w, a, b in pools:
        knots += [a, b]
        values += [(v + mean) / (w + 1)] * 2
    return np.array(knots), np.maximum.accumulate(np.array(values))


@dataclass
class Model:
    lexicon: Lexicon
    share: float = 0.0
    trees: Trees | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, block: common.Block) -> np.ndarray:
        if self.trees is None:
            return np.full(len(block.ids), self.share)
        m = self.trees.margin(features(block, self.lexicon))
        if self.knots is None or not len(self.knots):
            return 1 / (1 + np.exp(-m))
        #: A little of the uncalibrated score keeps the order within a pool.
        return np.clip(0.99 * np.interp(m, self.knots, self.values) + 0.01 / (1 + np.exp(-m)), 0, 1)


# ---------------------------------------------------------------- learning and scoring


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic and fold of the rows that are learned from; at most `sample`, so the table can be broadcast."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon_size: int = LEXICON, least: int = LEAST, least_odds: float = ODDS) -> Model:
    """A model of at most `sample` labelled rows, with at most lexicon_size entries, each of `least` toxic texts and least_odds log odds or more."""
    train = {r.doc_id: (r.toxic, r.fold) for r in training_rows(labels, sample).collect()}  # at most `sample` small rows
    spark = docs.sparkSession
    if not train:
        return Model(Lexicon())
    share = float(np.mean([t for t, _ in train.values()]))
    known = spark.createDataFrame(pa.table({"doc_id": pa.array(list(train), pa.int64())}))  # through Arrow: no worker starts for it
    rows = common.texts_of(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and other texts of the batch each word or beginning stands."""
        for block in common.blocks(batches, 4 << 20):
            w = common.words(block, _gap)
            doc = np.repeat(np.arange(len(block.ids)), np.diff(w.first))
            label = np.array([train[i][0] for i in block.ids.tolist()])
            use = np.array([train[i][1] < 4 for i in block.ids.tolist()])[doc]
            for kind, h in enumerate([w.hash, *_beginnings(w)]):
                keep = use & (h != 0)
                pairs = np.unique(np.stack([h[keep], doc[keep].astype(np.uint64)]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
                token, at, n = np.unique(pairs[0], return_inverse=True, return_counts=True)
                toxic = np.bincount(at, label[pairs[1].astype(np.int64)], len(token)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), min(kind, 1), np.int32)), pa.array(common.signed(token)), pa.array(toxic), pa.array(n - toxic)], ["kind", "token", "toxic", "clean"])

    bad = sum(t for t, f in train.values() if f < 4)
    good = sum(1 - t for t, f in train.values() if f < 4)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    entries = (
        rows.mapInArrow(count, "kind int, token long, toxic long, clean long")
        .groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least) & (odds >= least_odds)).orderBy(odds.desc(), "kind", "token").limit(lexicon_size).collect()
    )
    lexicon = Lexicon(*(np.sort(np.array([r.token for r in entries if r.kind == k], np.int64).view(np.uint64)) for k in (0, 1)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(list(features(block, lexicon)), pa.list_(pa.float64()))], ["doc_id", "x"])

    measured = rows.mapInArrow(measure, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))  # of several texts of an id, the least row of features
    found = {r.doc_id: r.x for r in measured.collect()}  # at most `sample` rows of FEATURES numbers
    ids = sorted(found)
    x, y, fold = np.array([found[i] for i in ids]).reshape(-1, FEATURES), np.array([train[i][0] for i in ids], float), np.array([train[i][1] for i in ids])
    fit, last = (fold >= 4) & (fold < 8), fold >= 8
    if not (0 < y[fit].sum() < fit.sum()):
        fit = np.ones(len(y), bool)
    if not (0 < y[fit].sum() < fit.sum()):
        return Model(lexicon, share)
    trees = fit_trees(x[fit], y[fit])
    if not (0 < y[last].sum() < last.sum()):
        return Model(lexicon, share, trees)
    return Model(lexicon, share, trees, *isotonic(trees.margin(x[last]), y[last]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    common.bind(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            s = model.score(block)
            out = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in block.ids.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(out), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return common.texts_of(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    common.bind(docs.sparkSession)
    return common.keep_rows(docs, lambda block: model.score(block) < THRESHOLD)
