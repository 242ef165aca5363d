"""Operator 6: benchmark decontamination by spaced seeds.

Words are runs of letters, digits and bytes of other scripts; A-Z count as a-z. Each mask reads SPAN
words and ignores some places, so an altered word spoils only the masks that read it. The items' seed
hashes form a sorted table behind a bit filter. At each hit the whole item is laid along the document
on that diagonal, and the longest stretch is measured in which every window of WINDOW words (all of a
shorter item) agrees in at least SHARE of its places. Items shorter than WINDOW are also looked up by
SHORT_MASKS, so that no placement of two altered words, the most that SHARE allows them, spoils every
mask. Of items shorter than SPAN but of at least LEAST words a number of words may be altered, by default
none. Those limits are parameters (Rules).

Items go out in blocks of at most BLOCK_TOKENS words, whose seed tables have a proven size; larger
benchmarks take several passes over the documents, each written before the next. No documents are
exchanged. Texts that repeat themselves have as many hits as the product of their places; only diagonals
are held, so memory stays in proportion to the texts.

Defined cases: null and empty texts are clean; items that are null, empty or shorter than LEAST words
match nothing; of several longest overlaps of an item the first counts; repeated items count once under each id; rows without an id take no part; repeated rows
give a row each; empty tables give an empty result or all clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed masks over words; 1 is read.
MASKS = ("1110010011", "1101001101", "1011100101", "1100111001")
#: With MASKS, one of them ignores any two of ten places.
SHORT_MASKS = ("0111101010", "0011011110", "0101110110", "0110111100", "1000111011", "1100101101")
SPAN, LEAST, WINDOW, SHARE = 10, 5, 13, 0.8
BLOCK_TOKENS = 1_000_000
BITS = 22
#: Hits of a seed in a document that are written out one by one, and hits that are held at once.
FEW, HITS = 10_000, 1_000_000

_gap = np.ones(256, bool)
_gap[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Rules:
    """What counts as an overlap: items of `least` words or more, `share` of each window's places agreeing; of a window shorter than SPAN all but `altered` words."""

    least: int = LEAST
    share: float = SHARE
    altered: int = 0

    def need(self, window: int) -> float:
        return window - self.altered if window < SPAN else self.share * window

    def masks(self, n: int) -> list[str]:
        """The masks by which an item of n words is looked up."""
        if n < max(1, self.least) or n < SPAN and n <= self.altered:
            return []
        if n < SPAN:  # each choice of altered words is ignored by one of them
            return ["".join("0" if i in left_out else "1" for i in range(n)) for left_out in map(set, combinations(range(n), self.altered))]
        return [*MASKS] if n >= WINDOW else [*MASKS, *SHORT_MASKS]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words that the mask reads, at each place where it fits."""
    n = len(h) - len(mask) + 1
    out = np.full(max(0, n), len(mask) * 31 + MASKS.index(mask) if mask in MASKS else len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1" and n > 0:
                out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


class Table:
    """Seeds of some items."""

    def __init__(self, ids: list[int], texts: list[str], rules: Rules = Rules()):
        found: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.rules = np.array(ids, np.int64), rules
        w = common.words(common.one_block(*texts), _gap)
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        masks: dict[str, list[int]] = {}
        for i, h in enumerate(self.words):
            for mask in rules.masks(len(h)):
                masks.setdefault(mask, []).append(i)
        for mask, items in masks.items():
            hashes = [seeds(self.words[i], mask) for i in items]
            key = np.concatenate(hashes)
            order = np.argsort(key, kind="stable")
            item = np.repeat(items, [len(x) for x in hashes])
            place = np.concatenate([np.arange(len(x)) for x in hashes])
            found.append((mask, key[order], item[order], place[order]))
        self.masks = found
        self.bits = [np.zeros(1 << BITS, bool) for _ in found]
        for bits, (_, key, _, _) in zip(self.bits, found, strict=True):
            bits[(key >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def diagonals(self, w: common.Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents, items, and in order the shifts of an item along a document at which some mask hits.

        A seed's hits are each of its places in a document with each in an item. Those of seeds that
        have few are written out, at most HITS at once; the shifts of a seed that a repetitive text
        holds often are a correlation of its places, in time and memory of the two texts' words.
        """
        parts: list[np.ndarray] = []
        many: dict[tuple[int, int], list[np.ndarray]] = {}
        for bits, (mask, key, item, place) in zip(self.bits, self.masks, strict=True):
            s = seeds(w.hash, mask)
            at = np.flatnonzero(bits[(s >> np.uint64(64 - BITS)).astype(np.int64)])
            low, high = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
            at, low, high = (x[high > low] for x in (at, low, high))
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, "right") - 1
            order = np.lexsort((low, doc))
            at, low, high, doc = (x[order] for x in (at, low, high, doc))
            edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]), [True]]))
            hits = np.diff(edge) * (high - low)[edge[:-1]]  # of a seed in a document
            for g in np.flatnonzero(hits > FEW).tolist():
                a, (x, y) = edge[g], (low[edge[g]], high[edge[g]])
                d, said = int(doc[a]), at[a : edge[g + 1]] - w.first[doc[a]]
                for i in np.unique(item[x:y]).tolist():
                    many.setdefault((d, i), []).append(differences(said, np.sort(place[x:y][item[x:y] == i])))
            light = np.flatnonzero(np.repeat(hits <= FEW, np.diff(edge)))
            total = np.cumsum((high - low)[light])
            for a, b in zip(cuts := [0, *np.unique(np.searchsorted(total, np.arange(HITS, (total[-1] if len(total) else 0) + HITS, HITS), "left") + 1).tolist()], cuts[1:]):
                some = light[a:b]
                n = (high - low)[some]
                k = common.ragged(low[some], n)
                parts.append(np.unique(np.stack([np.repeat(doc[some], n), item[k], np.repeat(at[some] - w.first[doc[some]], n) - place[k]], 1), axis=0))
        for x in parts:
            for pair in np.split(x, np.flatnonzero(np.any(x[1:, :2] != x[:-1, :2], 1)) + 1) if len(x) else []:
                many.setdefault((int(pair[0, 0]), int(pair[0, 1])), []).append(pair[:, 2])
        for (d, i), shifts in sorted(many.items()):
            yield d, i, np.unique(np.concatenate(shifts))


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distinct x - y for x in a and y in b, both in order."""
    if len(a) * len(b) <= HITS:
        return np.unique(a[:, None] - b)
    n, m = int(a[-1] - a[0]) + 1, int(b[-1] - b[0]) + 1
    size = 1 << (n + m - 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[a - a[0]], y[b[-1] - b] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: n + m - 1] > 0.5) + a[0] - b[-1]


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, rules: Rules = Rules()) -> tuple[int, int]:
    """First word and number of words of the longest stretch along the diagonal in which each window agrees; (0, 0) if there is none."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    if b - a < window:
        return 0, 0
    same = np.concatenate([[0], np.cumsum(doc[a + shift : b + shift] == item[a:b])])
    good = np.flatnonzero(same[window:] - same[:-window] >= np.ceil(rules.need(window) - 1e-9))
    if not len(good):
        return 0, 0
    first = np.flatnonzero(np.concatenate([[True], np.diff(good) > 1]))
    runs = np.diff(np.append(first, len(good)))
    k = int(runs.argmax())
    return int(a + shift + good[first[k]]), int(runs[k] - 1 + window)


def find(block: common.Block, table: Table) -> list[dict[int, tuple[int, int]]]:
    """For each document, the item ids that overlap it, each with the first word and the words of its longest overlap, of equals the first."""
    w = common.words(block, _gap)
    found: list[dict[int, tuple[int, int]]] = [{} for _ in block.ids]
    for d, i, shifts in table.diagonals(w):
        said, item, name = w.hash[w.first[d] : w.first[d + 1]], table.words[i], int(table.ids[i])
        best = found[d].get(name, (0, 0))
        for shift in shifts.tolist():
            start, n = overlap(said, item, shift, table.rules)
            if n and (-n, start) < (-best[1], best[0]):
                best = start, n
            if n == len(item):  # no other is longer, and those to come start later
                break
        if best[1]:
            found[d][name] = best
    return found


def tables(benchmark: DataFrame, rules: Rules = Rules()) -> Iterator[tuple[Broadcast, bool]]:
    """The items' seed tables, each of at most about BLOCK_TOKENS words, broadcast, and whether more follow."""
    spark = common.bind(benchmark.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // (4 * BLOCK_TOKENS)) or 1  # a word takes about 4 bytes at the least
    for k in range(parts):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()  # of a proven size
        yield spark.sparkContext.broadcast(Table([r.item_id for r in block], [r.text for r in block], rules)), k < parts - 1


def _through(rows: DataFrame, benchmark: DataFrame, rules: Rules, step: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """rows after a step for each table; all but the last are written before the next, so no more than one table is held."""
    for spread, more in tables(benchmark, rules):
        rows = step(rows, spread)
        if more:
            rows = common.written(rows)
            spread.unpersist()
    return rows


def _marks(rows: DataFrame, spread: Broadcast) -> DataFrame:
    """rows (doc_id, text, found) with the overlaps of one block of items merged into found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in common.blocks(iter([batch])):
                some = batch.slice(at, len(block.ids))
                at += len(block.ids)
                merged = []
                for own, before in zip(find(block, spread.value), some.column(2).to_pylist(), strict=True):
                    for x in before:
                        said = own.get(x["item"], (0, 0))
                        if (-x["n"], x["start"]) < (-said[1], said[0]):
                            own[x["item"]] = (x["start"], x["n"])
                    merged.append([{"item": i, "start": s, "n": n} for i, (s, n) in sorted(own.items())])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(merged, some.schema.field(2).type)], ["doc_id", "text", "found"])

    return rows.mapInArrow(run, rows.schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, contaminated, item_ids in order, and the first word and the words of each item's longest overlap, for every row."""
    rows = common.texts_of(docs).withColumn("found", F.from_json(F.lit("[]"), "array<struct<item: long, start: long, n: long>>"))
    rows = _through(rows, benchmark, rules, _marks)
    return rows.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.col("found.item").alias("item_ids"), F.col("found.start").alias("starts"), F.col("found.n").alias("lengths"))


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no item."""
    return _through(docs, benchmark, rules, lambda rows, spread: common.keep_rows(rows, lambda block: np.array([not x for x in find(block, spread.value)], bool)))
