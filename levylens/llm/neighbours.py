"""Operator 7: nearest neighbours by an adaptive dimension scan of probed lists.

A bounded sample gives the centroids of the lists; every vector goes to the list of its nearest
centroid. Vectors are turned by a fixed random rotation and scanned in blocks of columns. After each
block the rest of the inner product is at most |q rest| |x rest| (Cauchy-Schwarz); a candidate is
abandoned once that would not bring it to the query's bar, so no true neighbour is abandoned. The
bar is the k-th best of the sample, a proven lower bound. Survivors are measured on the original
vectors in double precision.

Lists over LIST_ROWS vectors are split into blocks, and so are the queries of a list, so no task
holds an unbounded group. The number of probed lists starts at the least that hold TARGET of the true
neighbours of some queries, which are found by brute force over all vectors. What the scan returns
for those queries, without the sample's own hits, is then held against the same truth, and twice the
lists are probed until it has TARGET; a warning tells if all lists do not.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id; ties go to the smaller id; a repeated vec_id is one
candidate, with its first vector in order; fewer than k candidates are all returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE, JUDGES, TARGET = 16_384, 192, 0.97
COLUMNS = 16
LIST_ROWS, QUERY_ROWS = 4_096, 1_024
#: Lists hold FEW_ROWS or so at least, so that a query goes to few of them.
MOST_LISTS, FEW_ROWS = 4_096, 1_024
#: Pairs measured at once, and the share of them alive under which pairs are taken singly.
CELLS, DENSE = 1 << 18, 0.1


_log = logging.getLogger(__name__)


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v, an array of doubles, of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.stack(col.to_numpy(zero_copy_only=False)).astype(np.float64) if len(col) else np.zeros((0, 0))


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means of the sample."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= bar)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x, q)


def scan(qs: np.ndarray, q_ids: np.ndarray, bars: np.ndarray, x: np.ndarray, turned: np.ndarray, rest: np.ndarray, turn: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of a list block's rows that may be among the k best of a query."""
    d, found = qs.shape[1], []
    t = qs @ turn.T
    slack = 1e-9 * (np.maximum(1.0, np.abs(bars)) + np.sqrt((qs**2).sum(1)) * np.sqrt((x**2).sum(1).max()))  # for rounding
    floor = np.where(np.isfinite(bars), bars - slack, -np.inf)
    step = max(1, CELLS // len(ids))
    for low in range(0, len(qs), step):
        own, some = t[low : low + step], slice(low, low + step)
        alive = q_ids[some, None] != ids[None, :]
        part, to, share = np.zeros(alive.shape), 0, 1.0
        # whole blocks of columns while most pairs are alive, then pair by pair
        while to < d and share > DENSE:
            at, to = to, min(d, to + COLUMNS)
            part += own[:, at:to] @ turned[:, at:to].T
            alive &= part + _rest(own, to)[:, None] * rest[None, :, at // COLUMNS] >= floor[some, None]
            share = alive.mean()
        i, j = np.nonzero(alive)
        p = part[i, j]
        while to < d and len(i):
            at, to = to, min(d, to + COLUMNS)
            p = p + np.einsum("ij,ij->i", own[i, at:to], turned[j, at:to])
            keep = p + _rest(own, to)[i] * rest[j, at // COLUMNS] >= floor[some][i]
            i, j, p = i[keep], j[keep], p[keep]
        score = np.einsum("ij,ij->i", qs[some][i], x[j])
        by = np.lexsort((ids[j], -score, i))
        first = np.searchsorted(i, np.arange(len(own)))  # i ascends
        by = by[np.arange(len(by)) - first[i] < k]
        found.append((q_ids[some][i[by]], ids[j[by]], score[by]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _rest(own: np.ndarray, to: int) -> np.ndarray:
    """The lengths of turned vectors in the columns from `to` on."""
    return np.sqrt((own[:, to:] ** 2).sum(1))


def _recall(near: DataFrame, true: set[tuple[int, int]], k: int) -> float:
    """The share of the true pairs of query and neighbour that are among the k best of their query in near."""
    if not true:
        return 1.0
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    got = near.where(F.col("query_id").isin(sorted({q for q, _ in true}))).withColumn("r", rank).where(F.col("r") <= k).collect()
    return len(true & {(r.query_id, r.vec_id) for r in got}) / len(true)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every query, the rows whose id is divisible by `every`."""
    spark = common.bind(vectors.sparkSession)
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, column)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    if not sizes:
        return spark.createDataFrame([], out)
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = common.checkpointed(rows.where(F.size("v") == d))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    s_ids, s = np.array([r.vec_id for r in sample]), np.array([r.v for r in sample])
    c = centroids(s, int(max(1, min(MOST_LISTS, np.sqrt(n), n / FEW_ROWS))))
    lists, turn = len(c), rotation(d)
    spread = spark.sparkContext.broadcast((s_ids, s, c, turn))

    def order(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ centre.T), axis=1, kind="stable")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, centre, _ = spread.value
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                near = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], ["vec_id", "v", "list"])

    placed = common.checkpointed(rows.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    fill = {r.list: -(-r["count"] // LIST_ROWS) for r in placed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    filled = np.array([fill.get(at, 0) for at in range(lists)])

    # how many lists to probe
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    judges = rows.where(is_query).orderBy(F.xxhash64(F.lit("judge"), "vec_id"), "vec_id").limit(JUDGES).collect()
    if not judges:
        return spark.createDataFrame([], out)
    j_ids, j = [r.vec_id for r in judges], np.array([r.v for r in judges])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids, at = _matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
            for i in range(len(j_ids) if len(x) else 0):
                other = np.flatnonzero(ids != j_ids[i])
                score = exact(j[i], x[other])
                best = top(score, ids[other], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(ids[other][best]), pa.array(score[best]), pa.array(at[other][best])], ["i", "vec_id", "score", "list"])

    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id"))
    truth = placed.select("vec_id", "v", "list").mapInArrow(brute, "i long, vec_id long, score double, list int").withColumn("r", rank).where(F.col("r") <= k).select("i", "vec_id", "list").collect()
    places = np.argsort(order(j, c), axis=1)  # place of each list in a judge's order
    need = np.sort([places[r.i, r.list] for r in truth]) if truth else np.array([0])
    probes = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1
    probes = min(lists, probes + probes // 8)

    keys = ["list", "block", "part"]
    pair = "query_id long, vec_id long, score double"
    true = {(j_ids[r.i], r.vec_id) for r in truth}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        turned_by = spread.value[3]
        ids, x = left["vec_id"].to_numpy(), _matrix(left["v"].combine_chunks())
        turned = x @ turned_by.T
        rest = np.stack([_rest(turned, at + COLUMNS) for at in range(0, d, COLUMNS)], axis=1)
        q_ids, bars, qs = right["query_id"].to_numpy(), right["bar"].to_numpy(), _matrix(right["q"].combine_chunks())
        return pa.table([pa.array(c) for c in scan(qs, q_ids, bars, x, turned, rest, turned_by, ids, k)], names)

    def scanned(probes: int) -> DataFrame:
        """What the scan of so many lists returns for each query."""
        step = int(max(1, min(256, 65_536 * lists // max(1, filled.sum() * probes))))  # queries whose rows go out at once

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block of the lists that a query probes, with its first bar."""
            ids_s, x_s, centre, _ = spread.value
            for b in batches:
                q, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                for i in range(0, len(q), step):
                    some = slice(i, i + step)
                    score = q[some] @ x_s.T
                    score[ids[some][:, None] == ids_s[None, :]] = -np.inf
                    bars = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), -np.inf)
                    probed = order(q[some], centre)[:, :probes]
                    row = np.repeat(np.arange(len(probed)), filled[probed].sum(1))
                    listed = np.repeat(probed.ravel(), filled[probed].ravel())
                    before = np.repeat(np.cumsum(filled[probed].ravel()) - filled[probed].ravel(), filled[probed].ravel())
                    own = ids[some][row]
                    yield pa.RecordBatch.from_arrays([pa.array(own), b.column(1).take(pa.array(i + row)), pa.array(bars[row]), pa.array(listed), pa.array(np.arange(len(row)) - before), pa.array(own // every % spread_q)], ["query_id", "q", "bar", "list", "block", "part"])

        #: Queries of one list are dealt to parts of about QUERY_ROWS.
        spread_q = max(1, -(-(n // every) * probes // (lists * QUERY_ROWS)))
        asked = placed.where(is_query).select("vec_id", "v").mapInArrow(ask, "query_id long, q array<double>, bar double, list long, block long, part long")
        blocks = F.create_map(*[F.lit(x) for kv in fill.items() for x in kv]) if fill else None
        held = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("list")).cast("long"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread_q - 1)))).select("vec_id", "v", F.col("list").cast("long").alias("list"), "block", F.col("part").cast("long").alias("part"))
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, pair)

    def nearest_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k best of the sample, so that none is left with fewer than there are."""
        ids_s, x_s, _, _ = spread.value
        for b in batches:
            q, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            for i in range(len(q)):
                if i % 256 == 0:
                    rough = q[i : i + 256] @ x_s.T
                some = top(rough[i % 256], ids_s, k + 1)  # the query itself may be one
                some = some[ids_s[some] != ids[i]][:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), ids[i])), pa.array(ids_s[some]), pa.array(exact(q[i], x_s[some]))], ["query_id", "vec_id", "score"])

    near = common.checkpointed(scanned(probes))
    while (recall := _recall(near, true, k)) < TARGET and probes < lists:
        probes = min(lists, 2 * probes)
        near = common.checkpointed(scanned(probes))
    _log.info("recall of the scan %.4f for %d queries, %d of %d lists", recall, len(j_ids), probes, lists)
    if recall < TARGET:
        warnings.warn(f"the scan of all {lists} lists has a recall of {recall:.4f}, under {TARGET}", stacklevel=2)
    near = near.unionByName(placed.where(is_query).select("vec_id", "v").mapInArrow(nearest_of_sample, pair)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
