"""Operator 3: an n-gram language model in an Elias-Fano trie.

Training: blocks of texts count their bigrams, the context by its 64-bit hash and the next word by 40
bits of its own, and deal them by context to shards. Each shard adds its counts up; the discount and
the quantising step are then fixed for all of them, so a score depends on the texts alone and not on
the number of shards. Each shard becomes one file of a trie. Level 1
has the contexts in order (Elias-Fano) with their exact counts; level 2 has each context's successors
after monotone pointers (Elias-Fano), in order within the context, with the discounted probability
quantised to eight bits, rounded down so that no distribution exceeds one. A word's count is its count
as a context, since every token has one successor.

Scoring: p(w | c) = discounted(c, w) + left(c) * p(w), p(w) = (count + 1/2) / (N + (V + 1) / 2). Levels
are mapped into memory from the shared folder (read whole where it is no local file system), and a
block's lookups go to each shard at once, in order: a context is found by its high bits' bucket, its
successor in the bucket relative to the context.

Defined cases: a null or empty text is one end token; without training texts every count is 0, N and V
are 0, and scores are those of the floor; rows without doc_id take no part; repeated rows count and
score each; an empty table gives an empty result; texts of any length count and score whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
FP_BITS = 40
END = common.mix(np.array([0x656E64], U))[0]  # the end token
MARK = U(0)  # what follows it
TOKENS = 2_000_000  # of a block, about


# ---------------------------------------------------------------- Elias-Fano


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        bit = np.arange(len(values), dtype=U) * U(width)
        word, off = (bit >> U(6)).astype(np.int64), bit & U(63)
        np.add.at(out, word, values << off)
        over = off + U(width) > U(64)
        np.add.at(out, word[over] + 1, values[over] >> (U(64) - off[over]))
    return out


def _bits_at(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U)
    bit = i.astype(U) * U(width)
    word, off = (bit >> U(6)).astype(np.int64), bit & U(63)
    low = words[word] >> off
    high = np.where(off > 0, words[word + 1] << ((U(64) - off) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the set bit number k (from 0) of words; before has the set bits before each word."""
    at = np.searchsorted(before, k, "right") - 1
    rest, word, out = (k - before[at]).astype(np.int64), words[at], at.astype(np.int64) * 64
    for half in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(word & U((1 << half) - 1)).astype(np.int64)
        up = rest >= n
        rest -= np.where(up, n, 0)
        word = np.where(up, word >> U(half), word)
        out += np.where(up, half, 0)
    return out


class EliasFano:
    """A rising sequence of 64-bit numbers: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        high = values >> U(width)
        place = high + np.arange(n, dtype=U)
        words = np.zeros((int(place[-1]) if n else 0) // 64 + 2, U)
        np.add.at(words, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
        return cls(n, width, _pack_bits(values & U((1 << width) - 1), width), words, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        small = np.uint32 if self.n < 1 << 32 else np.int64
        return {"shape": np.array([self.n, self.width], np.int64), "low": self.low, "high": self.high, "ones": self.ones.astype(small)}

    @classmethod
    def of(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = a[f"{name}.shape"].tolist()
        return cls(n, width, a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.ones"].astype(np.int64))

    def at(self, i: np.ndarray) -> np.ndarray:
        place = _select(self.high, self.ones, i)
        return ((place - i).astype(U) << U(self.width)) | _bits_at(self.low, i, self.width)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        high = keys >> U(self.width)
        known = np.flatnonzero(high < U(64 * len(self.high) - self.n))
        h = high[known].astype(np.int64)
        flipped = ~self.high
        to = _select(flipped, self.zeros, h) - h
        at = np.where(h > 0, _select(flipped, self.zeros, np.maximum(h - 1, 0)) + 1 - h, 0)
        low = keys[known] & U((1 << self.width) - 1)
        left, right = at.copy(), to.copy()  # a bucket of a frequent context can be long: halve it
        active = np.flatnonzero(left < right)
        while len(active):
            mid = (left[active] + right[active]) >> 1
            less = _bits_at(self.low, mid, self.width) < low[active]
            left[active[less]] = mid[less] + 1
            right[active[~less]] = mid[~less]
            active = active[left[active] < right[active]]
        inside = np.flatnonzero(left < to)
        hit = inside[_bits_at(self.low, left[inside], self.width) == low[inside]]
        out[known[hit]] = left[hit]
        return out


# ---------------------------------------------------------------- files


def _write(fs: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray], tag: str) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw = len(raw).to_bytes(8, "little") + raw
    with fs.open_output_stream(f"{path}.{tag}") as f:
        f.write(raw + b"\0" * (-len(raw) % 64))
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    fs.move(f"{path}.{tag}", path)


def _read(fs: pafs.FileSystem, path: str) -> dict[str, np.ndarray]:
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        data = np.frombuffer(fs.open_input_file(path).read(), np.uint8)
    n = int.from_bytes(data[:8].tobytes(), "little")
    start = -(-(n + 8) // 64) * 64
    return {name: data[start + at : start + at + np.dtype(kind).itemsize * k].view(kind) for name, (kind, k, at) in json.loads(data[8 : 8 + n].tobytes()).items()}


class Shard:
    """One file of the trie."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.contexts, self.pointers, self.successors = (EliasFano.of(arrays, x) for x in ("contexts", "pointers", "successors"))
        self.base, self.count, self.code = int(arrays["base"][0]), arrays["count"], arrays["code"]
        self.discount, self.least, self.step = arrays["numbers"].tolist()

    @staticmethod
    def merge(context: np.ndarray, successor: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Bigrams in any order by context and successor, equal ones added up."""
        names, at = np.unique(context, return_inverse=True)
        key = (at.astype(U) << U(FP_BITS)) | successor
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        return {"names": names, "key": key, "n": n, "count": np.bincount((key >> U(FP_BITS)).astype(np.int64), n, len(names)).astype(np.int64)}

    @staticmethod
    def build(merged: dict[str, np.ndarray], numbers: tuple[float, float, float]) -> dict[str, np.ndarray]:
        """The levels of merged bigrams; numbers are the whole model's discount, least log10 and step."""
        names, key, n, count = (merged[k] for k in ("names", "key", "n", "count"))
        discount, least, step = numbers
        owner = (key >> U(FP_BITS)).astype(np.int64)
        log = np.log10((n - discount) / count[owner])
        code = np.floor((log - least) / step).clip(0, 255).astype(np.uint8)
        base = names[0]
        pointers = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))]).astype(U)
        out = {"base": np.array([base], U), "numbers": np.array(numbers), "count": count.astype(np.uint32 if count.max() < 1 << 32 else np.int64), "code": code}
        for name, values in (("contexts", names - base), ("pointers", pointers), ("successors", key)):
            out |= {f"{name}.{k}": v for k, v in EliasFano.build(values).arrays().items()}
        return out

    def context(self, h: np.ndarray) -> np.ndarray:
        """The place of each context, or -1."""
        ok = np.flatnonzero(h >= U(self.base))
        out = np.full(len(h), -1, np.int64)
        out[ok] = self.contexts.find(h[ok] - U(self.base))
        return out

    def left(self, place: np.ndarray) -> np.ndarray:
        """The share of a context that goes to the lower order: the discounts of its successors."""
        kinds = (self.pointers.at(place + 1) - self.pointers.at(place)).astype(np.int64)
        return self.discount * kinds / self.count[place]

    def discounted(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The discounted probability of each successor of a context, 0 for one not seen."""
        at = self.successors.find((place.astype(U) << U(FP_BITS)) | successor)
        out = np.zeros(len(place))
        seen = at >= 0
        out[seen] = 10 ** (self.least + self.step * self.code[at[seen]].astype(np.float64))
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the context's hash."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def successor_of(h: np.ndarray) -> np.ndarray:
    return common.mix(h + U(1)) >> U(64 - FP_BITS)


# ---------------------------------------------------------------- tokens


def token_blocks(batches: Iterator[pa.RecordBatch], limit: int = TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, the token hashes of all, an end token after each text, and where each text's tokens start."""
    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def out():
        n = np.concatenate(sizes)
        return np.concatenate(ids), np.concatenate(parts), np.cumsum(n) - n

    for block in common.blocks(batches):
        w = common.words(block)
        parts.append(np.insert(w.hash, w.first[1:], END))
        sizes.append(np.diff(w.first) + 1)
        ids.append(block.ids)
        held += len(parts[-1])
        if held >= limit:
            yield out()
            ids, parts, sizes, held = [], [], [], 0
    if ids:
        yield out()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def count_bigrams(docs: DataFrame, shards: int) -> DataFrame:
    """shard and, as packed arrays, some of its contexts with their successors and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, start in token_blocks(batches):
            names, at = np.unique(h, return_inverse=True)
            following = np.append(successor_of(h[1:]), MARK)
            following[h == END] = MARK
            key, n = np.unique((at.astype(U) << U(FP_BITS)) | following, return_counts=True)
            owner = (key >> U(FP_BITS)).astype(np.int64)
            cut = np.searchsorted(owner, np.searchsorted(shard_of(names, shards), np.arange(shards + 1)))
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    kinds, size = np.unique(owner[a:b], return_counts=True)
                    fp = key[a:b] & U((1 << FP_BITS) - 1)
                    cols = [names[kinds].tobytes(), size.astype(np.uint32).tobytes(), fp.astype(np.uint32).tobytes(), (fp >> U(32)).astype(np.uint8).tobytes(), n[a:b].astype(np.uint32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["shard", "context", "size", "low", "high", "n"])

    return docs.mapInArrow(run, "shard int, context binary, size binary, low binary, high binary, n binary")


def numbers(one: int, two: int, most: int) -> tuple[float, float, float]:
    """Discount, least log10 and quantising step of a model with so many bigrams seen once and twice, whose most frequent context was seen `most` times."""
    discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
    least = float(np.log10((1 - discount) / max(most, 1)))
    return discount, least, max(1e-9, -least / 255)


def train(docs: DataFrame, folder: str, shards: int) -> list:
    """Writes the trie of docs (doc_id, text) below folder; a row (shard, path, n, kinds) for each file.

    Each shard's counts are merged and kept first, since the discount and the quantising step are those
    of all shards: neither depends on how contexts are dealt.
    """

    def merge(table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        context = np.repeat(joined("context", U), joined("size", np.uint32))
        successor = joined("low", np.uint32).astype(U) | joined("high", np.uint8).astype(U) << U(32)
        merged = Shard.merge(context, successor, joined("n", np.uint32))
        shard = table["shard"][0].as_py()
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name = f"counts-{shard:05d}-{TaskContext.get().taskAttemptId()}"
        _write(fs, f"{top}/{name}", merged, "writing")
        n, count = merged["n"], merged["count"]
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [name], "n": [int(count.sum())], "kinds": [len(count)], "one": [int((n == 1).sum())], "two": [int((n == 2).sum())], "most": [int(count.max())]})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for path in batch["path"].to_pylist():
                paths.append(path.replace("counts", "trie") + f"-{TaskContext.get().taskAttemptId()}")
                _write(fs, f"{top}/{paths[-1]}", Shard.build(_read(fs, f"{top}/{path}"), whole), "writing")
            yield pa.RecordBatch.from_arrays([batch["shard"], pa.array(paths), batch["n"], batch["kinds"]], ["shard", "path", "n", "kinds"])

    counts = count_bigrams(docs, shards).groupBy("shard").applyInArrow(merge, "shard int, path string, n long, kinds long, one long, two long, most long").toArrow()  # a row for each shard
    if not counts.num_rows:
        return []
    whole = numbers(sum(counts["one"].to_pylist()), sum(counts["two"].to_pylist()), max(counts["most"].to_pylist()))
    files = docs.sparkSession.createDataFrame(counts.select(["shard", "path", "n", "kinds"])).repartition(shards, "shard")
    built = files.mapInArrow(build, "shard int, path string, n long, kinds long").collect()  # a row for each file
    fs, top = pafs.FileSystem.from_uri(folder)
    for path in counts["path"].to_pylist():
        fs.delete_file(f"{top}/{path}")
    return built


class Model:
    """The trie's files, opened when first used in a worker."""

    def __init__(self, folder: str, manifest: list, shards: int):
        self.folder, self.shards = folder, shards
        self.paths = {r.shard: r.path for r in manifest}
        self.n, self.kinds = sum(r.n for r in manifest), sum(r.kinds for r in manifest)
        self.open: dict[int, Shard] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def shard(self, s: int) -> Shard | None:
        if s not in self.paths:
            return None
        if s in self.open:
            return self.open[s]
        fs, top = pafs.FileSystem.from_uri(self.folder)
        found = Shard(_read(fs, f"{top}/{self.paths[s]}"))
        if isinstance(fs, pafs.LocalFileSystem):  # else one shard is held at a time
            self.open[s] = found
        return found

    def score(self, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens h of texts that begin at start: each token's count, and log10 of its base and of its model probability."""
        names, at = np.unique(h, return_inverse=True)
        count, place, left = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64), np.ones(len(names))
        # the context of each token but the texts' first, in order of the context
        follows = np.ones(len(h), bool)
        follows[start] = False
        to = np.flatnonzero(follows)
        to = to[np.argsort((at[to - 1].astype(np.int64) << 32) | at[to])]
        owner = at[to - 1]
        successor = successor_of(names)[at[to]]
        seen = np.zeros(len(to))
        edge = np.searchsorted(shard_of(names, self.shards), np.arange(self.shards + 1))
        cut = np.searchsorted(owner, edge)
        for s in range(self.shards):
            a, b = edge[s], edge[s + 1]
            if a == b or (trie := self.shard(s)) is None:
                continue
            found = trie.context(names[a:b])
            known = np.flatnonzero(found >= 0)
            place[a:b] = found
            count[a + known] = trie.count[found[known]]
            left[a + known] = trie.left(found[known])
            span = np.arange(cut[s], cut[s + 1])
            span = span[place[owner[span]] >= 0]
            seen[span] = trie.discounted(place[owner[span]], successor[span])
        floor = (count + 0.5) / (self.n + 0.5 * (self.kinds + 1))
        p = floor[at]
        base = np.log10(p)
        p[to] = seen + left[owner] * p[to]
        return count[at], base, np.log10(p)


def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Learns from the rows that are not held out, then scores every row."""
    spark = common.bind(docs.sparkSession)
    shards = shards or common.shuffle_partitions(spark)
    rows, folder = common.texts_of(docs), common.shared_folder(spark)
    model = Model(folder, train(rows.where(~held_out(F.col("doc_id"))), folder, shards), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, start in token_blocks(batches):
            count, base, own = model.score(h, start)
            out = np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in ids.tolist()])
            sizes = np.diff(np.append(start, len(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(out), pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), start)), pa.array(np.full(len(ids), model.n)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(own, start))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
