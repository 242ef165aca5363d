"""Operator 2: removal of repeated passages by a run-length index over their surroundings.

A byte goes if a WINDOW-byte string that covers it also starts elsewhere. Each window is charged to
its anchor, the GRAM-byte string of least hash in it (the leftmost of equals), so equal windows have
equal anchors at the same offset, and an anchor's windows form one stretch of text, its context. Only
anchors whose string occurs twice go on. Where whole contexts are equal, their hashes settle it. The
distinct contexts of an anchor go, one of each, to a run-length index:

  * a suffix array of the contexts, each ended by a terminator of its own, gives the Burrows-Wheeler
    transform, of which only the runs count;
  * at each run's ends the text position and the length of the match with the neighbouring suffix are
    sampled; inside runs these lengths fall by one from one text position to the next, so a single
    pass over the text, from sample to sample, streams the matching statistics of every position
    against the rest of the collection;
  * a window that starts where the longest match is at least WINDOW is repeated.

An anchor with over HOT distinct contexts is split before: its windows' offsets are halved, and each
half is keyed by the bytes that all its windows share, until the groups are small or a key is a whole
window. Contexts that become alone or equal on the way are settled, so a boundary is found by bisection
and no task holds an unbounded group.

Defined cases: null and empty texts have no bytes and keep the digest of nothing; texts shorter than a
window keep all; rows without doc_id take no part; repeated rows are copies of each other and lose all
windows; rows that share a doc_id with different texts are kept apart by a hash of the text; texts of
any length are treated whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
WINDOW, GRAM = 200, 48
GRAMS = WINDOW - GRAM + 1
PLACE_BITS = 24
#: Keys that are broadcast as frequent, at most.
HOT_KEYS = 1000
#: Window starts handled at once, and bytes of contexts in one index, about.
CHUNK, INDEX_BYTES = 1 << 18, 1 << 20
#: Distinct contexts of an anchor in one index at most, unless their keys are whole windows.
HOT = 4_096
#: Tasks to which the rows of a frequent anchor are dealt.
SALTS = 256


# ---------------------------------------------------------------- anchors


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, ~U(0))
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(block: common.Block) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor and context hashes, the document's place in the block, and first window, anchor offset and further windows of each anchor."""
    size = np.diff(block.offsets)
    starts = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b, k in zip(block.offsets.tolist(), block.offsets[1:].tolist(), size.tolist()) if k >= WINDOW] or [np.zeros(0, np.int64)])
    for at in range(0, len(starts), CHUNK):
        s = starts[at : at + CHUNK]
        low, high = int(s[0]), int(s[-1]) + WINDOW
        data = block.data[low:high]
        sums = common.prefix_hash(data)
        here = np.arange(len(data) - GRAM + 1)
        gram = common.slice_hash(sums, here, here + GRAM)
        least = sliding_least((gram >> U(PLACE_BITS) << U(PLACE_BITS)) | here.astype(U), GRAMS)
        s = s - low
        place = (least[s] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        doc = np.searchsorted(block.offsets, s + low, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1) | (doc[1:] != doc[:-1])]))
        first, last = s[new], s[np.append(new[1:], len(s)) - 1]
        off = place[new] - first
        with np.errstate(over="ignore"):
            context = common.mix(common.slice_hash(sums, first, last + WINDOW) + off.astype(U))
        yield gram[place[new]], context, doc[new], first + low - block.offsets[doc[new]], off, last - first


def _loc(first: np.ndarray, off: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (first << 16) | (off << 8) | more


def anchor_rows(rows: DataFrame) -> DataFrame:
    """key, context, row and loc; loc packs the first window's start, the anchor's offset in it, and the number of further windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            for gram, context, doc, first, off, more in anchors(block):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (common.signed(gram), common.signed(context), block.ids[doc], _loc(first, off, more))], ["key", "context", "row", "loc"])

    return rows.mapInArrow(run, "key long, context long, row long, loc long")


# ---------------------------------------------------------------- the index


def suffix_array(text: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Of bytes + 1, 0 for the terminators, which differ by segment. By doubling, over what is not settled yet."""
    n, first = len(text), 5
    key = text.astype(U)
    code = key.copy()
    ended = text == 0
    for k in range(1, first):
        shifted = np.zeros(n, U)
        shifted[:-1] = key[1:]
        ended_next = np.zeros(n, bool)
        ended_next[:-1] = ended[1:]
        key = code * U(257**k) + np.where(text == 0, U(0), shifted)
        ended = (text == 0) | ended_next
    key = (key << U(23)) | np.where(ended, segment + 1, 0).astype(U)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = first
    open_at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in order that are not settled
    while len(open_at):
        pos = order[open_at]
        pair = (rank[pos].astype(U) << U(32)) | rank[pos + step].astype(U)
        by = np.argsort(pair)
        pos, pair = pos[by], pair[by]
        order[open_at] = pos
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        open_at = open_at[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class RunIndex:
    """The runs of the transform with the samples at their ends."""

    def __init__(self, text: np.ndarray, segment: np.ndarray, left: np.ndarray):
        """left: bytes from each position to its terminator."""
        order = suffix_array(text, segment)
        char = text[order - 1]  # the transform; order 0 meets a terminator at the end
        turn = np.flatnonzero((char[1:] != char[:-1]) | (char[1:] == 0)) + 1
        self.runs = len(turn) + 1
        self.heads, self.tails = order[turn], order[turn - 1]  # text positions at the starts of runs but the first, and at the ends of those before
        self.match = self._common(text, left, self.heads, self.tails)
        self.first, self.last = int(order[0]), int(order[-1])
        self.n = len(text)

    @staticmethod
    def _common(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at a and b, within their segments."""
        wide = np.zeros(len(text) + 8, np.uint8)
        wide[: len(text)] = text - 1  # terminators become 255; lengths are cut by left
        eight = np.zeros(len(text), U)
        for k in range(8):
            eight = (eight << U(8)) | wide[k : k + len(text)].astype(U)
        most = np.minimum(left[a], left[b])
        out, at = most.copy(), np.flatnonzero(most > 0)
        step = 0
        while len(at):
            x = eight[a[at] + step] ^ eight[b[at] + step]
            off = np.flatnonzero(x)
            high = x[off]
            same = np.zeros(len(off), np.int64)
            for k in range(1, 8):
                same += high >> U(64 - 8 * k) == 0
            out[at[off]] = np.minimum(most[at[off]], step + same)
            step += 8
            at = at[(x == 0) & (most[at] > step)]
        return out

    def statistics(self) -> np.ndarray:
        """For each text position the longest match of its suffix elsewhere: a stream from sample to sample."""
        best = np.zeros(self.n, np.int64)
        here = np.arange(self.n)
        for at, edge in ((self.heads, self.first), (self.tails, self.last)):
            reach = np.full(self.n, -1, np.int64)  # sampled position + length
            reach[at] = at + self.match
            reach[edge] = edge  # the first suffix has none before it, the last none after
            sampled = np.maximum.accumulate(np.where(reach >= 0, here, 0))
            best = np.maximum(best, reach[sampled] - here)
        return best


def repeated_windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and place of each window that occurs twice in the contexts."""
    size = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(size + 1) - 1
    text[ends] = 0
    segment = np.repeat(np.arange(len(contexts)), size + 1)
    left = ends[segment] - np.arange(len(text))
    found = np.flatnonzero(RunIndex(text, segment, left).statistics() >= WINDOW)
    return segment[found], found - (ends - size)[segment[found]]


def index_rows(rows: DataFrame) -> DataFrame:
    """Spans (row, first, end) of repeated windows; rows has key, mark, row, loc and bytes, a context of each kind for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, bytes]] = []
        size, key = 0, None

        def spans():
            segment, place = repeated_windows([h[3] for h in held])
            mark, row, loc = (np.array([h[k] for h in held]) for k in range(3))
            keep = mark[segment]
            segment, place = segment[keep], place[keep]
            new = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)])) if len(segment) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(segment)) - 1 if len(new) else new
            start = (loc >> 16)[segment[new]] + place[new]
            return pa.RecordBatch.from_arrays([pa.array(row[segment[new]], pa.int64()), pa.array(start, pa.int64()), pa.array(start + place[last] - place[new] + WINDOW, pa.int64())], ["row", "first", "end"])

        for batch in batches:
            for k, mark, row, loc, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key and size >= INDEX_BYTES:
                    yield spans()
                    held, size = [], 0
                key = k
                held.append((mark, row, loc, text))
                size += len(text)
        if held:
            yield spans()

    parts = common.shuffle_partitions(rows.sparkSession)
    return rows.select("key", "mark", "row", "loc", "bytes").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "row long, first long, end long")


# ---------------------------------------------------------------- hot anchors


def _halves(rows: DataFrame, width: int) -> DataFrame:
    """Cuts each context's windows where offsets from the anchor pass a multiple of width, and keys the pieces by the bytes that the windows of such a cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, mark, row, loc, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first, off, more = loc >> 16, loc >> 8 & 255, loc & 255
                sums = common.prefix_hash(np.frombuffer(text, np.uint8))
                at = 0
                while at <= more:
                    least = (off - at) // width * width  # the cell's offsets are from least to least + width - 1
                    to = min(more, off - least)
                    edges = np.array([[off - least, off - least - width + 1 + WINDOW], [at, to + WINDOW]])
                    shared, own = common.slice_hash(sums, edges[:, 0], edges[:, 1])
                    with np.errstate(over="ignore"):
                        named = common.mix(np.array([np.array(key, np.int64).view(U) + shared + U(least * 256 + width), own + U(off - at)], U))
                    out.append((*named.view(np.int64).tolist(), mark, row, ((first + at) << 16) | ((off - at) << 8) | (to - at), text[at : to + WINDOW]))
                    at = to + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "context", "mark", "row", "loc", "bytes"])

    return rows.select("key", "mark", "row", "loc", "bytes").mapInArrow(run, "key long, context long, mark boolean, row long, loc long, bytes binary")


def _span(loc: Column) -> list[Column]:
    first = F.shiftright(loc, 16)
    return [first.alias("first"), (first + loc.bitwiseAND(255) + WINDOW).alias("end")]


def settle(contexts: DataFrame, hot: int = HOT) -> list[DataFrame]:
    """Spans of the contexts' repeated windows; contexts has key, mark, row, loc and bytes."""
    spans, width = [], 128
    while True:
        sizes = contexts.groupBy("key").count().where(F.col("count") > hot).select("key")
        if width < 1 or not sizes.limit(1).count():
            return [*spans, index_rows(contexts)]
        # two readings of a small set of keys; the rest stays where it is
        spans.append(index_rows(contexts.join(sizes, "key", "left_anti")))
        pieces = common.checkpointed(_halves(contexts.join(sizes, "key", "left_semi"), width))
        kinds = pieces.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "loc")).alias("one"))
        several = kinds.groupBy("key").agg((F.min("context") != F.max("context")).alias("open"))
        kinds = common.checkpointed(kinds.join(several, "key"))
        spans.append(pieces.where("mark").join(kinds.where("n > 1").select("key", "context"), ["key", "context"]).select("row", *_span(F.col("loc"))))
        kept = pieces.join(kinds.where("open").select("key", "context", "n", "one"), ["key", "context"]).where((F.col("row") == F.col("one.row")) & (F.col("loc") == F.col("one.loc")))
        contexts = common.checkpointed(kept.select("key", (F.col("mark") & (F.col("n") == 1)).alias("mark"), "row", "loc", "bytes"))
        width //= 2


# ---------------------------------------------------------------- documents


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted's (key, mark, row, loc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed_text, listed in zip(batch.column(0), batch.column(1), strict=True):
                text = common.unpack(packed_text)
                for x in listed.as_py():
                    first = x["loc"] >> 16
                    out.append((x["key"], x["mark"], x["row"], x["loc"], text[first : first + (x["loc"] & 255) + WINDOW]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "mark", "row", "loc", "bytes"])

    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "mark", "row", "loc")).alias("listed"))  # no more than the row's own windows
    return common.packed(rows.select("row", "text")).join(by_row.hint("shuffle_hash"), "row").select("text", "listed").mapInArrow(run, "key long, mark boolean, row long, loc long, bytes binary")


def _again(found: DataFrame, twice: DataFrame) -> DataFrame:
    """The rows of found whose key is in twice, and open. A key with over a thousandth of them is dealt by row to SALTS tasks."""
    share = (twice.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    frequent = twice.where(F.col("n") > share).select("key", F.lit(True).alias("frequent"))  # under HOT_KEYS rows
    dealt = found.join(F.broadcast(frequent), "key", "left").withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("row", "loc"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    places = F.when(F.col("n") > share, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(twice.select("key", "open", F.explode(places).alias("salt")), ["key", "salt"]).select("key", "context", "row", "loc", "open")


def removed_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """row, first and end of stretches whose bytes all go; they may overlap. rows has row, text and doc_id."""
    found = anchor_rows(rows.select("row", "text"))
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("open")).where("n > 1")
    again = common.checkpointed(_again(found, common.checkpointed(twice)))
    kinds = again.where("open").groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "loc")).alias("one"))
    kinds = common.checkpointed(kinds)
    whole = again.where("NOT open").select("row", "loc").unionByName(again.where("open").join(kinds.where("n > 1").select("key", "context"), ["key", "context"]).select("row", "loc"))
    wanted = kinds.select("key", (F.col("n") == 1).alias("mark"), "one.row", "one.loc")
    contexts = common.checkpointed(_contexts(rows, wanted))
    spans = whole.select("row", *_span(F.col("loc")))
    for more in settle(contexts, hot):
        spans = spans.unionByName(more)
    return spans


def _stays(text: bytes, first: pa.ListScalar, end: pa.ListScalar) -> tuple[bytes, int, int]:
    """What is left of text, the bytes gone, and their runs."""
    gone = np.zeros(len(text) + 1, np.int32)
    if first.is_valid:
        np.add.at(gone, first.values.to_numpy(), 1)
        np.add.at(gone, end.values.to_numpy(), -1)
    gone = np.cumsum(gone)[:-1] > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _with_spans(rows: DataFrame, hot: int) -> DataFrame:
    """rows with the text packed, and first and end of the stretches that go. Equal rows share row; different texts of an id do not."""
    by_row = removed_spans(rows, hot).groupBy("row").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end"))  # no more than the row's own windows
    return common.packed(rows).join(by_row.hint("shuffle_hash"), "row", "left")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    common.bind(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, first, end in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = common.unpack(packed)
                rest, gone, runs = _stays(text, first, end)
                out.append((len(text), gone, runs, hashlib.sha256(rest).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = _with_spans(_rows(common.texts_of(docs)), hot).select("doc_id", "text", "first", "end")
    return spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs (with a text, and n_chars if any) without the bytes that go; a character of which a byte goes, goes whole. Null texts stay null."""
    common.bind(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    row, first, end = common.free_names(docs, 3)
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-2])
            texts = [_stays(common.unpack(t), a, b)[0].decode(errors="ignore") if t.is_valid else None for t, a, b in zip(cols[at], *batch.columns[-2:], strict=True)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    spans = removed_spans(rows.where("text IS NOT NULL").select(F.col(row).alias("row"), "text"), hot).groupBy(F.col("row").alias(row)).agg(F.collect_list("first").alias(first), F.collect_list("end").alias(end))
    joined = common.packed(rows).join(spans.hint("shuffle_hash"), row, "left").select(*names, first, end)
    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
