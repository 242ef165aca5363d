"""Operator 9: n-gram Jaccard join as a blocked sparse product of document by n-gram incidence.

Sets of shingle hashes are compared by class: documents with equal sets are one. Two sets that link
differ in at most H shingles, a bound that follows from their sizes. A class's shingles are dealt by
their hash to somewhat more than H + 1 parts, so two linked classes agree in whole in some; the part's hash is a
signature. Classes that share one form a group, whose incidence matrix is multiplied with its
transpose, block of columns by block of columns: overlap counts accumulate, and classes all of whose
pairs fall below the bound from their sizes, even if all columns left agreed, are dropped. A large
group is cut into blocks: first each block is multiplied by itself and by the next, then the classes
that are still apart from the group's largest component by every block. So copies of one text cost in
proportion to their number, and no link is left out. Groups that share classes are multiplied as one
cluster while that has few blocks. A product gives the edges of a spanning forest of its links, never
all pairs. Components join those.

A part that is empty in both classes says nothing, so there are more parts than H + 1 by what is
usually empty. A class with more empty ones also signs another dealing to 2 H + 4 parts, and if even
that leaves too few, one signature for all of its size. So no link is lost. By the same bound a class
that links shares many signatures with others: one with fewer is dropped before any set is sent.

Signatures are dealt and sorted by Spark; groups are read off the sorted stream, so that one signature
never has to fit in memory, and one holds at most one row of the over H + 1 of each class.

Defined cases: null, empty and white texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle of all its words; a row without doc_id
takes no part; repeated rows have equal sets, thus one component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import SCHEMA, components, local

U = np.uint64
#: Shingle places of a block of a group, and classes of one, at most.
BLOCK_PLACES, BLOCK_CLASSES = 1 << 19, 512
#: Blocks of a cluster that is multiplied as one in any case.
CLUSTER_BLOCKS = 4
COLUMNS = 1024
#: Rows of a product that are compared at once.
ROWS = 128


@lru_cache
def _starts(percent: int) -> tuple[int, ...]:
    """Sizes at which levels start."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return tuple(out)


@lru_cache(maxsize=65536)
def levels(n: int, percent: int) -> list[tuple[int, int]]:
    """The levels of a set of n shingles, each with H. Any two sizes that can link share the level of the smaller."""
    starts = _starts(percent)
    at = int(np.searchsorted(starts, n, "right")) - 1
    out = []
    while at >= 0 and n <= (starts[at + 1] - 1) * 100 // percent:
        least = starts[at + 1] - 1
        out.append((at, (least + least * 100 // percent) * (100 - percent) // (100 + percent)))
        at -= 1
    return out


def shingle_sets(block: common.Block, words: int) -> list[np.ndarray]:
    """Each document's distinct shingles, in order."""
    w = common.words(block)
    g = common.grams(w.hash, words)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= words:
            s = np.sort(g[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(common.grams(w.hash[a:b], b - a) ^ U(b - a) if b > a else np.zeros(0, U))
    return out


def class_key(s: np.ndarray, salt: int = 1) -> int:
    with np.errstate(over="ignore"):
        return int(common.mix(np.array([common.mix(s ^ U(salt)).sum() + U(len(s))], U)).view(np.int64)[0])


def _parts(s: np.ndarray, m: int, tag: int) -> tuple[np.ndarray, int]:
    """Signatures of the parts of a set that are not empty, and the number of those that are."""
    edge = np.searchsorted(s, np.arange(1, m, dtype=U) * U((1 << 64) // m))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(common.mix(s + U(0x51ED27)))])
        edge = np.concatenate([[0], edge, [len(s)]])
        full = edge[1:] > edge[:-1]
        sig = common.mix((sums[edge[1:]] - sums[edge[:-1]]) ^ common.mix(np.arange(m, dtype=U) + U(tag << 32)))
    return sig[full], int(m - full.sum())


def dealings(h: int, percent: int) -> tuple[int, int]:
    """The parts of the first dealing and of the second."""
    return h + 2 + h * (100 - percent) // 160, 2 * h + 4


def least_shared(s: np.ndarray, percent: int) -> int:
    """How many signatures a set that links has in common with others at least.

    Of a set of n, a partner differs in at most D shingles, and in as many parts of the first dealing;
    the others agree, and all but the empty ones are signed. Sets with too many empty parts give 1.
    """
    n, out = len(s), []
    for k, (level, h) in enumerate(levels(n, percent)):
        if h:
            m = dealings(h, percent)[0]
            other = n * 100 // percent if k == 0 else _starts(percent)[level + 1] - 1  # a partner's most shingles
            d = min(h, (n + other) * (100 - percent) // (100 + percent))
            edge = np.concatenate([[0], np.searchsorted(s, np.arange(1, m, dtype=U) * U((1 << 64) // m)), [n]])
            empty = int((edge[1:] == edge[:-1]).sum())
            out.append(max(1, m - d - empty) if empty < m - h else 1)
    return min(out, default=1)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Their last six bits tell the size, for the blocks."""
    out = []
    for level, h in levels(len(s), percent):
        if h:  # else only equal sets link
            found = []
            for deal, m in enumerate(dealings(h, percent)):
                sig, empty = _parts(np.sort(common.mix(s ^ U(0xABCDEF))) if deal else s, m, level * 4 + deal)
                found.append(sig)
                if empty < m - h:
                    break
            else:
                found.append(common.mix(np.array([level * 4 + 2], U)))
            out.append(np.concatenate(found) & ~U(63) | U(_starts(percent)[level + 1].bit_length()))
    return np.concatenate(out) if out else np.zeros(0, U)


def profiles(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, class and least shared signatures of every document; rows has doc_id, text and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in common.blocks(iter([batch])):
                sets = shingle_sets(block, words)
                marks = batch.column(2).slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), marks, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([least_shared(s, percent) for s in sets], pa.int64())], ["doc_id", "mark", "n_shingles", "class", "need"])

    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, class long, need long")


def groups(rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Classes that share signatures enough to link: grp, class, pivot (a class of the group), and block and blocks of the group. Equal groups come once."""
    parts = common.shuffle_partitions(rows.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            sets = shingle_sets(block, words)
            seen: set[int] = set()
            sigs, keys = [], []
            for s in sets:
                key = class_key(s)
                if key not in seen:
                    seen.add(key)
                    sigs.append(signatures(s, percent))
                    keys.append(np.full(len(sigs[-1]), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate(sigs))), pa.array(np.concatenate(keys))], ["sig", "class"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads (sig, class) in order; a group is held up to one block."""

        sig, held, done, most, pivot = None, [], 0, 0, 0

        def flush(last: bool):
            """The held classes as a block of their own; a whole small group is named by its members."""
            nonlocal held, done, pivot
            cls = np.array(held, np.int64)
            whole = last and not done
            if len(cls) and not done:
                pivot = held[0]
            if len(cls) > 1 or len(cls) and done:
                name = class_key(cls.view(U), 7) if whole else sig
                yield name, done, pivot, cls
            held, done = [], done + 1

        ready: list[tuple[int, int, int, np.ndarray]] = []
        waiting = 0

        def release():
            nonlocal ready, waiting
            if ready:
                n = [len(x[3]) for x in ready]
                names, places, pivots = (np.repeat([x[k] for x in ready], n) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, np.concatenate([x[3] for x in ready]), pivots, places)], ["grp", "class", "pivot", "block"])
            ready, waiting = [], 0

        for b in batches:
            s, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
            s, c = s[fresh], c[fresh]
            edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(edge, len(s)))
            if len(s) and s[0] == sig:
                size[0] = max(size[0], 2)  # goes on from the batch before
            size[-1:] = 2  # may go on
            for a, k in zip(edge[size > 1].tolist(), np.diff(np.append(edge, len(s)))[size > 1].tolist()):
                if s[a] != sig:
                    ready += flush(True) if sig is not None else []
                    sig, held, done = int(s[a]), [], 0
                    most = max(2, min(BLOCK_CLASSES, BLOCK_PLACES >> (sig & 63)))
                for x in c[a : a + k].tolist():
                    if not held or held[-1] != x:
                        held.append(x)
                        if len(held) == most:
                            ready += flush(False)
            waiting = sum(len(x[3]) for x in ready)
            if waiting > 50_000:
                yield from release()
        if sig is not None:
            ready += flush(True)
        yield from release()

    signed = rows.mapInArrow(sign, "sig long, class long").repartition(parts, "sig").sortWithinPartitions("sig", "class")
    found = signed.mapInArrow(gather, "grp long, class long, pivot long, block long").groupBy("grp", "block", "class").agg(F.count(F.lit(1)).alias("shared"), F.min("pivot").alias("pivot"))
    found = common.checkpointed(found)
    enough = found.groupBy("class").agg(F.sum("shared").alias("shared")).join(classes, "class").where("shared >= need").select("class")
    found = common.checkpointed(found.drop("shared").join(enough, "class"))
    large = found.where("block > 0").groupBy("grp").agg((F.max("block") + 1).alias("blocks"))
    return found.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def clusters(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of what is multiplied: grp, class, block and blocks.

    Groups that share classes form a cluster, whose members' sets are then sent once for each of its
    blocks and not with every group. Where that would be more than a member has groups, the cluster
    stays in its groups.
    """
    labels = components(found.select(F.col("pivot").alias("a"), F.col("class").alias("b")))
    own = found.groupBy("class").agg(F.sum("blocks").alias("sent")).join(classes.select("class", "n"), "class")
    placed = own.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "sent", "n", F.coalesce("label", "class").alias("cluster"))
    size = placed.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_PLACES, F.count(F.lit(1)) / BLOCK_CLASSES)).cast("long").alias("blocks"), F.avg("sent").alias("sent"), F.count(F.lit(1)).alias("members"))
    placed = common.checkpointed(placed.drop("sent").join(size.where("members > 1"), "cluster"))
    one = F.col("blocks") <= F.greatest(F.lit(float(CLUSTER_BLOCKS)), F.col("sent"))
    whole = placed.where(one).select(F.col("cluster").alias("grp"), "class", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"), "blocks")
    return whole.unionByName(found.join(placed.where(~one).select("class"), "class", "left_semi").select(*whole.columns))


def link_forest(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the place of the first set that its links reach."""
    g = len(sets)
    n = np.array([len(s) for s in sets])
    label = np.arange(g)
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0]) if 100 * both >= percent * (n.sum() - both) else label
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), n)
    while True:  # a column of one class adds to no pair; a class without enough other columns links with none
        use = np.bincount(column, minlength=len(names))
        shared = use[column] > 1
        enough = 100 * np.bincount(row[shared], minlength=g) >= percent * n
        keep = shared & enough[row]
        if keep.all():
            break
        row, column = row[keep], column[keep]
    chosen = np.flatnonzero(enough & (np.bincount(row, minlength=g) > 0))
    if len(chosen) < 2:
        return label
    order = np.argsort(-use, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    column = rank[column]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    alive = chosen
    overlap = np.zeros((len(alive), len(alive)), np.float32)
    left = np.bincount(row, minlength=g).astype(np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        place = np.full(g, -1)
        place[alive] = np.arange(len(alive))
        r, c = place[row[a:b]], column[a:b] - at
        a_block = np.zeros((len(alive), COLUMNS), np.float32)
        a_block[r[r >= 0], c[r >= 0]] = 1
        overlap += a_block @ a_block.T
        left -= np.bincount(row[a:b], minlength=g)
        size, rest = n[alive] * percent / (100 + percent), left[alive]  # 100 o >= percent (a + b - o)
        keep = np.zeros(len(alive), bool)
        for k in range(0, len(alive), ROWS):
            possible = overlap[k : k + ROWS] + np.minimum(rest[k : k + ROWS, None], rest[None, :]) >= size[k : k + ROWS, None] + size[None, :] - 1e-6
            np.fill_diagonal(possible[:, k:], False)
            keep[k : k + ROWS] = possible.any(1)
        if not keep.all():
            alive, overlap = alive[keep], overlap[np.ix_(keep, keep)]
        if not len(alive):
            return label
    size = n[alive]
    open_ = np.ones(len(alive), bool)
    for first in range(len(alive)):  # what each class reaches, the least one first
        if not open_[first]:
            continue
        front = np.array([first])
        open_[first] = False
        while len(front):
            reached = np.zeros(len(alive), bool)
            for k in range(0, len(front), ROWS):
                at = front[k : k + ROWS]
                o = overlap[at].astype(np.int64)
                reached |= (100 * o >= percent * (size[at, None] + size[None, :] - o)).any(0)
            front = np.flatnonzero(reached & open_)
            open_[front] = False
            label[alive[front]] = alive[first]
    return label


def products(rows: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """Edges of a spanning forest of the links between the classes of each key, for components(); rows has keys, class and its packed text."""
    names = [*keys, "class", "text"]
    k = len(keys)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, texts = None, [], []
        edges: list[tuple[int, int]] = []

        def close():
            if len(cls) > 1:
                for a, b in enumerate(link_forest(shingle_sets(common.one_block(*texts), words), percent).tolist()):
                    if a != b:
                        edges.append((cls[b], cls[a]))

        for batch in batches:
            for *now, c, text in zip(*(batch.column(i).to_pylist() for i in range(k + 1)), batch.column(k + 1), strict=True):
                if now != key:
                    close()
                    key, cls, texts = now, [], []
                if not cls or cls[-1] != c:  # a class may come by two ways
                    cls.append(c)
                    texts.append(common.unpack(text))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])
                edges = []
        close()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select(names).repartition(common.shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "class").mapInArrow(lambda batches: local(multiply(batches)), SCHEMA)


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the label of each class, itself if it has none."""
    return members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))


def links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node and label of all linked classes but the least of each component; members has grp, class, block and blocks, texts has class and its packed text."""
    labels = components(products(members.join(texts, "class"), ["grp", "block"], words, percent))
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return labels
    star = lambda: labels.select(F.col("label").alias("a"), F.col("node").alias("b"), F.lit(False).alias("moved"))
    # each block by the next
    turns = large.select("grp", "class", F.explode(F.array_distinct(F.array(F.col("block"), F.pmod(F.col("block") + 1, F.col("blocks"))))).alias("turn"))
    labels = components(star().union(products(turns.join(texts, "class"), ["grp", "turn"], words, percent)))
    # what is apart from the group's largest component, by every block
    placed = common.checkpointed(relabelled(large, labels))
    main = placed.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    apart = common.checkpointed(placed.join(main, "grp").where("label <> main").select("grp", "class", "blocks"))
    spread = apart.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("long").alias("lots"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    base = large.join(spread, "grp").select("grp", "class", "block", each(F.col("lots")).alias("lot"))
    own = apart.join(spread, "grp").select("grp", "class", F.pmod(F.xxhash64("class"), F.col("lots")).alias("lot"), each(F.col("blocks")).alias("block"))
    return components(star().union(products(base.unionByName(own).join(texts, "class"), ["grp", "block", "lot"], words, percent)))


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, label of the component and its least doc_id, for every row with an id."""
    common.bind(docs.sparkSession)
    rows = common.texts_of(docs).withColumn("mark", F.xxhash64("text"))
    known = common.checkpointed(profiles(rows, words, percent))
    classes = common.checkpointed(known.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n_shingles").alias("n"), F.max("need").alias("need")))
    members = common.checkpointed(clusters(groups(rows, classes, words, percent), classes))
    wanted = members.select("class").distinct().join(classes, "class").select("class", "first.doc_id", "first.mark")

    texts = common.checkpointed(common.packed(rows).join(wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("class", "text"))
    labels = links(members, texts, words, percent)
    named = common.checkpointed(classes.select("class", "first.doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", F.coalesce("label", "class").alias("label")))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = known.where("n_shingles > 0").select("doc_id", "mark", "n_shingles", "class").join(named.select("class", "label").join(least, "label"), "class")
    columns = ["doc_id", "mark", "n_shingles", "label", "component_id"]
    return full.select(columns).union(known.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("mark").alias("label"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; sets link when 100 * intersection >= percent * union."""
    return linked(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the text of the least doc_id (of several under that id, the one of the least hash), in one row. Rows without doc_id stay, as do those without words."""
    mark, stays, name = common.free_names(docs, 3)
    first = linked(docs, words, percent).where("doc_id = component_id").groupBy("label", "doc_id").agg(F.min("mark").alias(mark))
    first = first.select(F.col("doc_id").alias(stays), mark).distinct()
    one = docs.where("doc_id IS NOT NULL").withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(name, F.col("doc_id").cast("long")).dropDuplicates([name, mark])
    return one.join(first.withColumnRenamed(stays, name), [name, mark], "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
