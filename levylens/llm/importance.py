"""Operator 13: importance resampling towards a target distribution, by an integer word dictionary.

Each block of documents interns its words, and its n-grams as tuples of the words' numbers, with how often
each document has each tuple. The blocks' words make one dictionary of the corpus and the target texts,
which gives each distinct word an id, so an n-gram is a tuple of ids; each distinct tuple's bytes are put
together from the dictionary and hashed to a bucket once, and the buckets are joined back to the blocks'
tuples and so to their counts. Buckets' counts over all documents and over all target texts give each
bucket a gain; a document's weight is the floored mean of its features' gains, and with Gumbel noise drawn
from its id the highest scores are a sample without replacement in proportion to the weights' exponentials.

Texts are read once and not exchanged: what is exchanged are the distinct words of blocks, a row a word and
block however often it stands there, and the scores, for their ranks. A word's key is its bytes; within a
block a 64-bit hash stands for them. Tuples of one word are their word's row of the dictionary.

Defined cases: null texts and texts without words have no features, weight 0 and no rank; a row without
doc_id takes no part; repeated rows are rows of their own; target texts need no id; no target texts, or
an empty table, leave the formulas as they are with T or S of 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontamination import _gap as GAP

#: Words of an n-gram at most, buckets, words of a document that may be drawn, percent drawn, seed.
MOST_N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: A logarithm's unit in gains and scores.
UNIT = 1000
BLOCK = "block long, payload binary, words array<binary>, grams array<array<int>>, counts array<long>"
PAYLOAD = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


class Interned:
    """The words and n-grams of a block's documents, filled part by part."""

    def __init__(self, most_n: int):
        self.most_n = most_n
        self.number: dict[int, int] = {}  # of a word, by its hash
        self.words: list[bytes] = []
        self.grams: dict[tuple[int, ...], int] = {}  # the number of each distinct tuple of words' numbers
        self.counts = np.zeros(0, np.int64)  # of the tuples in the block
        self.rows: list[pa.Table] = []
        self.bytes = 0

    def _numbers(self, w: common.Words) -> np.ndarray:
        code, seen = pd.factorize(common.signed(w.hash))
        where = np.empty(len(seen), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        own = np.empty(len(seen), np.int64)
        for k, (key, i) in enumerate(zip(seen.tolist(), where.tolist(), strict=True)):
            n = self.number.setdefault(key, len(self.words))
            if n == len(self.words):
                self.words.append(w.folded[w.start[i] : w.end[i]].tobytes())
            own[k] = n
        return own[code]

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """The number of each row of word numbers."""
        if grams.shape[1] == 1:
            code, seen = pd.factorize(grams[:, 0])
            seen = seen[:, None]
        else:
            seen, code = np.unique(grams, axis=0, return_inverse=True)
        own = np.array([self.grams.setdefault(gram, len(self.grams)) for gram in map(tuple, seen.tolist())], np.int64)
        return own[code.ravel()]

    def add(self, block: common.Block) -> None:
        n = len(block.ids)
        self.bytes += len(block.data)
        w = common.words(block, GAP)
        numbers, n_words = self._numbers(w), np.diff(w.first)
        doc = np.repeat(np.arange(n), n_words)
        left = np.repeat(w.first[1:], n_words) - np.arange(len(doc))  # words from each on
        docs, places, n_features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, np.int64)
        for k in range(1, self.most_n + 1):
            start = np.flatnonzero(left >= k)
            if len(start):
                docs.append(doc[start])
                places.append(self._places(numbers[start[:, None] + np.arange(k)]))
            n_features += np.maximum(n_words - k + 1, 0)
        size = max(1, len(self.grams))
        held, times = np.unique(np.concatenate(docs) * size + np.concatenate(places), return_counts=True)
        at = held % size
        more = np.bincount(at, times, len(self.grams)).astype(np.int64)
        more[: len(self.counts)] += self.counts
        self.counts = more
        edge = pa.array(np.searchsorted(held, np.arange(n + 1) * size), pa.int32())
        lists = [pa.ListArray.from_arrays(edge, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (times, pa.int64()))]
        self.rows.append(pa.table([pa.array(block.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_features), *lists], schema=PAYLOAD))

    def row(self, block: int) -> pa.RecordBatch:
        """Tuples are listed only if there are others than the words themselves, whose numbers are then the tuples'."""
        grams = list(self.grams) if self.most_n > 1 else []
        lists = ((self.words, pa.binary()), (grams, pa.list_(pa.int32())), (self.counts, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([common.sealed(pa.concat_tables(self.rows))], pa.binary()), *(pa.array([x], pa.list_(kind)) for x, kind in lists)], ["block", "payload", "words", "grams", "counts"])


def interned(docs: DataFrame, most_n: int = MOST_N) -> DataFrame:
    """A row for each block of documents: its documents with their tuples by number, its distinct words and tuples, and the tuples' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = TaskContext.get().partitionId() << 32, Interned(most_n)
        for block in common.blocks(batches):
            own.add(block)
            if own.bytes >= common.SHARED_BYTES:
                yield own.row(at)
                at, own = at + 1, Interned(most_n)
        if own.rows:
            yield own.row(at)

    common.bind(docs.sparkSession)
    return common.written(common.texts_of(docs).mapInArrow(run, BLOCK))


def bucketed(blocks: DataFrame, most_n: int, buckets: int) -> DataFrame:
    """own, block, no, n and bucket of every tuple of every block: the dictionary of all words, the hash of each distinct tuple of ids, and the join back."""
    entries = blocks.select("own", "block", F.posexplode("words").alias("at", "word"))
    counted = blocks.select("own", "block", F.posexplode("counts").alias("no", "n"))
    bucket = lambda text: F.pmod(F.crc32(text), F.lit(buckets)).cast("int").alias("bucket")
    dictionary = common.written(entries.select("word").distinct().withColumn("id", F.monotonically_increasing_id()).select("word", "id", bucket(F.col("word"))))
    if most_n == 1:  # a tuple of one id is its word's row, and has its number
        with_counts = blocks.select("own", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "x")).select("own", "block", "no", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        return common.written(with_counts.join(dictionary, "word").select("own", "block", "no", "n", "bucket"))
    ids = entries.join(dictionary, "word").select("own", "block", "at", "id")
    places = blocks.select("own", "block", F.posexplode("grams").alias("no", "gram")).select("own", "block", "no", F.posexplode("gram").alias("pos", "at"))
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value])
    grams = common.written(places.join(ids, ["own", "block", "at"]).groupBy("own", "block", "no").agg(in_order("id").alias("gram")))
    spelled = grams.select("gram").distinct().select("gram", F.posexplode("gram").alias("pos", "id")).join(dictionary.select("id", F.hex("word").alias("word")), "id")
    hashed = spelled.groupBy("gram").agg(bucket(F.unhex(F.array_join(in_order("word"), "20"))))  # 20 is the space's byte
    return common.written(grams.join(hashed, "gram").join(counted, ["own", "block", "no"]).select("own", "block", "no", "n", "bucket"))


def totals_of(tuples: DataFrame, buckets: int) -> list[int]:
    """The features in each bucket, over all documents."""
    out = [0] * buckets
    for r in tuples.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(own: list[int], wanted: list[int]) -> np.ndarray:
    """What a feature of each bucket speaks for the target distribution."""
    all_own, all_wanted, k = sum(own), sum(wanted), len(own)
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (all_own + k) / ((s + 1.0) * (all_wanted + k)))) for s, t in zip(own, wanted, strict=True)], np.int64)


def weighted(blocks: DataFrame, tuples: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document, a block with its tuples at a time."""

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        gain = np.zeros(1 + max(own.column("no").to_numpy(), default=0), np.int64)
        gain[own.column("no").to_numpy()] = gains[own.column("bucket").to_numpy()]
        rows = pa.concat_tables([common.opened(x) for c in block.column("payload").chunks for x in c]).combine_chunks() if block.num_rows else PAYLOAD.empty_table()
        lists = rows.column("at").combine_chunks()
        edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        times = rows.column("times").combine_chunks().flatten().to_numpy()
        n = rows.column("n_features").to_numpy()
        cols = {"doc_id": rows.column("doc_id").to_numpy(), "n_words": rows.column("n_words").to_numpy(), "n_features": n, "weight": common.sums_of(gain[lists.flatten().to_numpy()] * times, edge) // np.maximum(n, 1)}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    left, right = blocks.select("block", "payload").groupBy("block"), tuples.select("block", "no", "bucket").groupBy("block")
    return left.cogroup(right).applyInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, wanted: DataFrame, most_n: int = MOST_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; wanted has the target texts, percent of the documents of least_words or more are drawn."""
    blocks = interned(docs, most_n)
    aims = interned(wanted.select(F.lit(0).alias("doc_id"), "text"), most_n)
    both = blocks.withColumn("own", F.lit(True)).unionByName(aims.withColumn("own", F.lit(False)))
    tuples = bucketed(both, most_n, buckets)
    rows = weighted(blocks, tuples.where("own"), gains_of(*(totals_of(tuples.where(F.col("own") == own), buckets) for own in (True, False))))
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = common.written(rows.withColumn("score", F.col("weight") + F.floor(-UNIT * F.log(-F.log(u)))))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranks = common.ranked(able, [F.col("score").desc(), "doc_id", "n_features", "weight"], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The registered query for DuckDB, which has no crc32: bytes are folded by a table made from the polynomial."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda table, i: f"SELECT {i} AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')) AS w FROM {table}"
    return f"""
WITH RECURSIVE step(b, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
own AS ({words('documents', 'doc_id')} WHERE doc_id IS NOT NULL), aim AS ({words('benchmark', '0')}),
seen AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION ALL SELECT w FROM aim)),
hashed AS (SELECT w, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % {BUCKETS})::INT AS bucket FROM seen, crc),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT x.range AS bucket, floor({UNIT} * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM range({BUCKETS}) x LEFT JOIN s ON s.bucket = x.range LEFT JOIN t ON t.bucket = x.range),
w AS (SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w ON id = doc_id WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, n_features, weight, weight + floor(-{UNIT} * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS many FROM p)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= many * {PERCENT} // 100 THEN place END::BIGINT AS rank FROM k"""
