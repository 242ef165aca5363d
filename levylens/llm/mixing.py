"""Operator 12: mixing sources to target weights, in DataFrame functions only.

Sources share `share` times all words by weight; a source's target stops at `cap` times its size, and
the excess is shared anew by weight among the rest until none is above. Of each source whole epochs are
taken first. The rest of its budget is an Efraimidis-Spirakis sample: each document has the key
-ln(u) / weight, u drawn from a digest of its id and weight being its quality's, so good documents tend
to come first; the source's documents are sorted by the key, their sizes are summed as prefixes, and
documents are taken whole while that brings the sum nearer to the budget.

Rows of (id, source, size, key) are dealt once to ranges of (source, key), so a source of any size is
sorted by many tasks: a range sums its own rows, and a prefix starts from the sums of the ranges before
it. What decides a share is counted in whole numbers, so reruns agree, also in the last digit.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a row without
doc_id takes no part; repeated rows are rows of their own, one after the other; a quality that is
missing, not above zero or not finite counts as 1, and of several the largest counts; sources without
words have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their code points, again and again.
WEIGHTS = (3, 1, 2)
#: What is mixed as a share of all words, and how often a source, and so each of its documents, is taken at most.
SHARE, CAP, SEED = (3, 2), 2, "mix"
#: Hex digits of the digest that u is drawn from.
DIGITS = 13


def quality_of(labels: DataFrame) -> DataFrame:
    """doc_id and weight: good documents are four times as likely to come before bad ones as after."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def keyed(docs: DataFrame, quality: DataFrame | None, seed: str) -> DataFrame:
    """doc_id, source, size and key of every row, and a number that tells equal rows apart."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        weight = F.col("weight").cast("double")
        good = quality.where((weight > 0) & (weight < float("inf"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(weight).alias("weight"))
        rows = rows.join(good, "doc_id", "left")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, DIGITS), 16, 10).cast("long")
    key = -F.log((digest.cast("double") + 0.5) / float(16**DIGITS)) / F.coalesce("weight", F.lit(1.0))
    return rows.select("doc_id", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("place"))


def targets(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """source, source_size, target, epochs (taken of all its documents) and twice the words that remain to be drawn."""
    sources = common.ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    sources = common.written(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))))
    whole = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(19,0)")  # noqa: E731  products of two are exact
    size, weight = F.col("source_size"), F.col("weight")
    words, left, capped, n = *sources.agg(F.sum(size), F.sum(weight)).first(), 0, 0
    while True:  # each round caps a source at least
        pool, parts = share[0] * (words or 0) - share[1] * cap * capped, share[1] * (left or 1)
        above = whole(pool) * whole(weight) > whole(size) * whole(cap * parts)
        own, rest, many = sources.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, weight)), F.count(F.when(above, 1))).first()
        if many == n or not rest:
            break
        capped, left, n = own, rest, many
    target = F.when(above, (size * cap).cast("double")).otherwise((whole(pool) * whole(weight)).cast("double") / float(parts))
    epochs = F.when(size == 0, 0).when(above, cap).otherwise(F.floor(target / size)).cast("long")
    return sources.withColumn("target", target).withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", (2 * (F.col("target") - (F.col("epochs") * size).cast("double"))).alias("rest"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and source of every row.

    quality has doc_id and weight. share is a fraction, below cap; cap, weights and share are whole numbers.
    """
    if not 0 <= share[0] < cap * share[1]:
        raise ValueError("a mix of cap times all words or more leaves nothing to choose")
    rows = common.written(keyed(docs, quality, seed))
    order = ["key", "doc_id", "size", "place"]
    dealt = common.written(rows.repartitionByRange(common.shuffle_partitions(docs.sparkSession), F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    plan = targets(rows, weights, share, cap).alias("t")
    parts = dealt.groupBy("part", "source").agg(F.sum("size").alias("words")).withColumn("below", F.coalesce(before, F.lit(0))).alias("p")  # a row for each source in each range
    parts = parts.join(plan, F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.part", "p.source", "below", "source_size", "target", "epochs", "rest").alias("p")
    after = F.sum("size").over(Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    drawn = dealt.withColumn("after", after).alias("d").join(parts, (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    upto = 2 * (F.col("below") + F.col("after")) - F.col("size")  # twice the middle of the document's place in its source
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.when(upto < F.col("rest"), F.col("size")).otherwise(0)).alias("taken"), F.col("d.source").alias("source"))


def oracle() -> str:
    """The registered query for DuckDB; targets by the sources' order of size to weight instead of rounds."""
    case = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    a, b = SHARE
    return f"""
WITH good AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
             -ln((('0x' || substr(md5('{SEED}:' || d.doc_id), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
      FROM documents d LEFT JOIN good ON good.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL),
s AS (SELECT source, sum(size)::HUGEINT AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {case} END::HUGEINT AS w FROM d GROUP BY source),
r AS (SELECT *, sum(size) OVER () AS words, coalesce(sum(size) OVER below, 0) AS under, sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS left_w FROM s
      WINDOW below AS (ORDER BY size::DECIMAL(38, 0) * 6 / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
c AS (SELECT *, ({a} * words - {b * CAP} * under) * w > {b * CAP} * size * left_w AS above FROM r),
u AS (SELECT {a} * max(words) - {b * CAP} * coalesce(sum(size) FILTER (above), 0) AS pool, {b} * sum(w) FILTER (NOT above) AS parts FROM c),
t AS (SELECT source, size, CASE WHEN above THEN ({CAP} * size)::DOUBLE ELSE (pool * w)::DOUBLE / parts::DOUBLE END AS target, above FROM c, u),
e AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN above THEN {CAP} ELSE floor(target / size::DOUBLE) END::BIGINT AS epochs FROM t),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS after FROM d)
SELECT doc_id, o.size, e.size::BIGINT AS source_size, target,
       (epochs * o.size + CASE WHEN 2 * after - o.size < 2 * (target - (epochs * e.size)::DOUBLE) THEN o.size ELSE 0 END)::BIGINT AS taken, o.source
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source"""
