"""Operator 8: sharding by histogram sort.

Rows are ordered by a path, the hex digits of a hash of the text, of the id and of a number that tells
equal rows apart, so equal texts lie side by side. Splitters are wanted where the bytes (or rows) before
them reach j/n of all. Each round counts, in one pass, the exact bytes and rows of the 256 children of
every open probe's prefix, and narrows each probe to the child that holds its target: those between
shards until the child is one path, or weighs no more than `tolerance` of a shard; those that only share
a shard out among tasks until it weighs no more than LOOSE of a range. Then the rows are dealt to ranges
once, and each range numbers its own rows: the histogram has the count before it.

A splitter falls between two paths, so shards differ from the mean by less than the largest document,
and by less than a row under the law of rows, if the tolerance is 0. There are as many ranges as shuffle
partitions; at most 256 children for each of them reach the driver.

Defined cases: a null text has no bytes and size 1; a row without doc_id takes no part; a repeated
(doc_id, text) row has a path and a slot of its own beside its copy's; an empty table gives no rows;
fewer rows than shards leave shards empty; texts of any length are one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hex digits by which a probe's prefix grows in a round.
STEP = 2
#: What a range inside a shard may weigh more than wanted, as a share of it.
LOOSE = 0.25


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and path of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(digits(F.xxhash64(text)), digits(F.col("doc_id").cast("long")), digits(F.monotonically_increasing_id())).alias("path"),
    )


def splitters(rows: DataFrame, weight: Column, ranges: int, each: int = 1, tolerance: float = 0.0) -> list[tuple[str, int]]:
    """For j from 1 to ranges - 1: a path at which the weight below reaches j/ranges of all, and the rows below it.

    Every each-th is the least path at which the weight up to and with it exceeds that, or one that is
    less than tolerance * each ranges of weight before it; the others are LOOSE ranges off at most.
    """
    total = rows.agg(F.sum(weight)).first()[0]
    if not total:
        return []
    found: dict[int, tuple[str, int]] = {}
    probes = {j: ("", 0, 0) for j in range(1, ranges)}  # prefix, weight and rows below it
    depth = 0
    while probes:
        prefixes = sorted({p for p, _, _ in probes.values()})
        depth += STEP
        inside = rows if depth == STEP else rows.where(F.substring("path", 1, depth - STEP).isin(prefixes))
        counts = inside.groupBy(F.substring("path", 1, depth).alias("child")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.min("path").alias("least"), F.max("path").alias("most")).collect()
        children: dict[str, list] = {}
        for r in sorted(counts, key=lambda r: r.child):
            children.setdefault(r.child[: depth - STEP], []).append(r)
        for j, (prefix, w, n) in list(probes.items()):
            for r in children[prefix]:
                if (w + r.w) * ranges > total * j:
                    break
                w, n = w + r.w, n + r.n
            if r.least == r.most or r.w * ranges <= total * (LOOSE if j % each else tolerance * each):
                found[j] = (r.least, n)
                del probes[j]
            else:
                probes[j] = (r.child, w, n)
    return [found[j] for j in range(1, ranges)]


def range_of(path: Column, cuts: list[str]) -> Column:
    """How many of the cuts, which are in order, are not above the path: a binary search."""
    if not cuts:
        return F.lit(0)
    paths, top = F.array(*map(F.lit, cuts)), 1 << (len(cuts).bit_length() - 1)
    steps = F.array(*(F.lit(top >> k) for k in range(top.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(paths, at + step - 1) <= path, at + step).otherwise(at))


def shard(docs: DataFrame, shards: int = 16, law: str = "bytes", tolerance: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; law is bytes or rows."""
    weight = {"bytes": F.col("size"), "rows": F.lit(1)}[law]
    rows = common.checkpointed(keyed(docs))
    each = max(1, math.ceil(common.shuffle_partitions(docs.sparkSession) / shards))
    cuts = splitters(rows, weight, shards * each, each, tolerance)
    below = [0, *(n for _, n in cuts)]
    before = F.array(*[F.lit(n - below[i // each * each]).cast("long") for i, n in enumerate(below)])
    dealt = rows.withColumn("range", range_of(F.col("path"), [p for p, _ in cuts]))
    at = F.row_number().over(Window.partitionBy("range").orderBy("path")) - 1
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"),
        F.floor(F.col("range") / each).cast("int").alias("shard"),
        (F.element_at(before, F.col("range") + 1) + at).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
