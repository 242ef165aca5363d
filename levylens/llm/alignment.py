"""Operator 11: alignment of two tokenizers by a dictionary of groups.

A text is encoded by a byte-level vocabulary (A) and by a sentence-piece model (B). Byte offsets at
which tokens of both end cut it into groups, a group being its A ids and its B ids. Groups are interned:
a block of documents keeps each distinct group once, and its documents refer to it by number. Links, the
pairs of tokens whose bytes overlap, follow from a group alone, so they are expanded once a distinct
group. A pair's count is the number of documents that hold it: each block counts its own documents by
way of its groups, and the counts are added up. Then each distinct group of the corpus gets the sums
over its links, which are joined back by the group to the blocks, and there multiplied by how often each
document has it.

Only blocks' dictionaries and pair counts are exchanged, never texts or tokens. A group's key is its ids
themselves; within a block a 64-bit hash stands for them.

Texts are cut into words: before each space that follows neither white space nor B's mark, and is not the
last of its text. A's pieces end there, and no piece of a vocabulary like B's spans such a place (both
checked; else texts stay whole), so a group ends there too. A block gives each distinct word to the
tokenizers once, and has its groups from then on. A text with a word that is altered by a tokenizer is
encoded whole, B's part in slices of over SLICE bytes, cut alike.

Defined cases: texts that are null, empty, or altered by a tokenizer have no tokens, zeros and an empty
digest; a row without doc_id takes no part; repeated rows give a row each and count as documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe, common
from .token_files import byte_letters

#: Bytes of a text that B's library, which needs some hundred bytes for each, gets at once.
SLICE = 1 << 16
BLOCK = "block long, payload binary, groups array<binary>, pairs array<long>, docs array<long>"
PAYLOAD = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


class ByteLevel:
    """A: whole texts to ids by pieces, of which each new one goes to the library once."""

    most = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cut = rules["pre_tokenizer"] or {}
        self.by_piece = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        byte = {chr(letter): b for b, letter in {**{b: b for b in range(256)}, **byte_letters()}.items() if letter >= 256 or b not in byte_letters()}
        self.bytes = [bytes(byte.get(c, 0) for c in t) for _, t in sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())]
        self.known: dict[bytes, list[int]] = {}

    def encode(self, block: common.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        if not self.by_piece:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([block.bytes_of(i).decode() for i in range(len(block.ids))], add_special_tokens=False)]
            return _flat(ids)
        lead = np.flatnonzero((block.data & 0xC0) != 0x80)
        first = np.zeros(len(lead), bool)
        first[np.searchsorted(lead, block.offsets[:-1][np.diff(block.offsets) > 0])] = True
        at = lead[byte_bpe.boundaries(np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32), first)] if len(lead) else lead
        edge = np.searchsorted(at, block.offsets)
        text, cut = block.data.tobytes(), [*at.tolist(), len(block.data)]
        pieces = [text[a:b] for a, b in zip(cut, cut[1:])]
        known = self.known
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(set(pieces))
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            for p, x in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                known[p] = x.ids
        ids, size = _flat(list(map(known.__getitem__, pieces)))
        return ids, common.sums_of(size, edge)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, size.sum()), size


class SentencePieces:
    """B: whole texts to ids, long ones in slices."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(names)]
        spans = any(re.search(f"[^{self.MARK}]{self.MARK}", p) for p in names)
        self.sliced = not spans and self.join(self.model.encode("a  b ")) == b" a  b "

    def join(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def slices(self, text: str) -> list[str]:
        """The text cut before spaces that follow a word, each slice but the first without its space, which the model adds."""
        if not self.sliced or len(text) <= SLICE:
            return [text]
        out, at = [], 0
        for m in re.finditer(f"(?<=[^ {self.MARK}]) (?=.)", text, re.DOTALL):
            if m.start() - at >= SLICE:
                out.append(text[at : m.start()])
                at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if max(map(len, texts), default=0) <= SLICE:
            return self.model.encode(texts, num_threads=1)
        cut = [self.slices(t) for t in texts]
        ids = iter(self.model.encode([s for doc in cut for s in doc], num_threads=1))
        return [list(chain.from_iterable(next(ids) for _ in doc)) for doc in cut]


_models: dict[tuple[str, str], tuple[ByteLevel, SentencePieces]] = {}


def models(a: str, b: str) -> tuple[ByteLevel, SentencePieces]:
    if (a, b) not in _models:
        _models[a, b] = ByteLevel(a), SentencePieces(b)
    return _models[a, b]


def links_of(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[int]:
    """The pairs of a group's tokens that overlap, as a << 32 | b: one for each offset at which either ends."""
    out, i, j, end_a, end_b = [], 0, 0, size_a[a[0]], size_b[b[0]]
    while True:
        out.append(a[i] << 32 | b[j])
        on_a, on_b = end_a <= end_b, end_b <= end_a
        i, j = i + on_a, j + on_b
        if i == len(a) or j == len(b):  # both, as their bytes are equal
            return out
        if on_a:
            end_a += size_a[a[i]]
        if on_b:
            end_b += size_b[b[j]]


def key_of(a: list[int], b: list[int]) -> bytes:
    return np.array([len(a), *a, *b], "<i4").tobytes()


def ids_of(key: bytes) -> tuple[list[int], list[int]]:
    x = np.frombuffer(key, "<i4").tolist()
    return x[1 : 1 + x[0]], x[1 + x[0] :]


class Dictionary:
    """The distinct words, groups and pairs of a block's documents, filled part by part."""

    def __init__(self, a: str, b: str):
        self.a, self.b = models(a, b)
        self.sizes = [[len(x) for x in m.bytes] for m in (self.a, self.b)]
        self.size_a, self.size_b = (np.array(x, np.int64) for x in self.sizes)
        self.word_number: dict[int, int] = {}  # by its hash
        self.words: list[str] = []  # the names of each word's groups
        self.facts = np.zeros((4, 0), np.int64)  # of each word: A's ids, B's ids, groups, whether a tokenizer alters it
        self.word_groups = np.zeros(0, np.int64)  # of all words, one after the other
        self.number: dict[int, int] = {}  # of a group, by its hash
        self.keys: list[bytes] = []
        self.names: list[str] = []
        self.pair_number: dict[int, int] = {}
        self.links: list[int] = []  # numbers of the pairs of each group, each once
        self.first = [0]
        self.docs = np.zeros(0, np.int64)  # that hold each pair
        self.rows: list[pa.Table] = []
        self.bytes = 0

    def _take(self, a: list[int], b: list[int]) -> int:
        self.keys.append(key_of(a, b))
        self.names.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        pairs = dict.fromkeys(links_of(a, b, *self.sizes))
        self.links.extend(self.pair_number.setdefault(p, len(self.pair_number)) for p in pairs)
        self.first.append(len(self.links))
        return len(self.keys) - 1

    def _starts(self, spaced: common.Block) -> np.ndarray:
        """Where words of texts that begin with a space start; each begins with one."""
        if not (self.a.by_piece and self.b.sliced):
            return spaced.offsets[:-1]
        points = np.frombuffer(spaced.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        said = (byte_bpe.classes()[points] != byte_bpe.SPACE) & (points != ord(self.b.MARK))
        after = np.zeros(len(points), bool)
        after[1:] = (points[1:] == 0x20) & said[:-1]
        cut = np.zeros(len(spaced.data), bool)
        cut[np.flatnonzero((spaced.data & 0xC0) != 0x80)[after]] = True
        cut[spaced.offsets[1:] - 1] = False  # a text's last space is the word's before it
        cut[spaced.offsets[:-1]] = True
        return np.flatnonzero(cut)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        code, seen = pd.factorize(common.signed(common.hash_slices(data, start, end)))
        where = np.empty(len(seen), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        keys, known = seen.tolist(), self.word_number
        new = [k for k, key in enumerate(keys) if key not in known]
        if new:
            known.update(zip(map(keys.__getitem__, new), range(len(self.words), len(self.words) + len(new))))
            self._learn([data[start[i] : end[i]].tobytes() for i in where[new].tolist()])
        return np.array(list(map(known.__getitem__, keys)), np.int64)[code]

    def _learn(self, words: list[bytes]) -> None:
        block = common.one_block(*words)
        (a, n_a), (b, n_b) = self.a.encode(block), _flat(self.b.encode([x[1:].decode() for x in words]))
        altered = np.diff(block.offsets) == 1
        for model, ids, size, n in ((self.a, a, self.size_a, n_a), (self.b, b, self.size_b, n_b)):
            ends = np.concatenate([[0], np.cumsum(n)])
            same, joined = common.sums_of(size[ids], ends) == np.diff(block.offsets), b"".join(map(model.bytes.__getitem__, ids.tolist()))
            if not same.all() or joined != block.data.tobytes():
                at = np.concatenate([[0], np.cumsum(size[ids])])[ends].tolist()
                same = np.array([joined[x:y] == word for x, y, word in zip(at, at[1:], words)], bool)
            altered |= ~same
        a, b, n_a, n_b = a[np.repeat(~altered, n_a)], b[np.repeat(~altered, n_b)], n_a * ~altered, n_b * ~altered
        local, edge = self._groups(a, b, n_a)
        names, cut = list(map(self.names.__getitem__, local.tolist())), edge.tolist()
        self.words += [";".join(names[x:y]) for x, y in zip(cut, cut[1:])]
        self.facts = np.concatenate([self.facts, [n_a, n_b, np.diff(edge), altered]], axis=1)
        self.word_groups = np.concatenate([self.word_groups, local])

    def _texts(self, spaced: common.Block) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words in turn, and where each text's begin; a text with an altered word is one word."""
        start = self._starts(spaced)
        word = self._numbers(spaced.data, start, np.append(start[1:], len(spaced.data)))
        edge = np.searchsorted(start, spaced.offsets)
        odd = np.flatnonzero(common.sums_of(self.facts[3][word], edge) * (np.diff(edge) > 1))
        if len(odd):
            kept = np.ones(len(word), bool)
            for i in odd.tolist():
                kept[edge[i] + 1 : edge[i + 1]] = False
            word[edge[odd]] = self._numbers(spaced.data, spaced.offsets[odd], spaced.offsets[odd + 1])
            edge = np.concatenate([[0], np.cumsum(common.sums_of(kept.astype(np.int64), edge))])
            word = word[kept]
        return word, edge

    def add(self, block: common.Block) -> None:
        n = len(block.ids)
        self.bytes += len(block.data)
        word, cut = self._texts(common.Block(block.ids, np.insert(block.data, block.offsets[:-1], 32), block.offsets + np.arange(n + 1)))
        n_a, n_b, n_groups = (common.sums_of(x[word], cut) for x in self.facts[:3])
        size = self.facts[2]
        local = self.word_groups[common.ragged((np.cumsum(size) - size)[word], size[word])]
        names, said = list(map(self.words.__getitem__, word.tolist())), cut.tolist()
        sha = [hashlib.sha256(";".join(names[x:y]).encode()).hexdigest() if some else "" for x, y, some in zip(said, said[1:], n_groups.tolist())]
        held, times = np.unique(np.repeat(np.arange(n), n_groups) * len(self.keys) + local, return_counts=True)
        doc, at = held // max(1, len(self.keys)), held % max(1, len(self.keys))
        self._count(doc, at)
        spread = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(spread, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (times, pa.int64()))]
        self.rows.append(pa.table([pa.array(block.ids, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(sha, pa.string()), *lists], schema=PAYLOAD))

    def _groups(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each group in turn, and where each document's begin."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(len(n_a) + 1, np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(end_b, end_a)
        both = end_b[at] == end_a  # documents end here too, as their bytes are equal
        last_a, last_b = np.flatnonzero(both), at[both]
        first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (last_a, last_b))
        with np.errstate(over="ignore"):
            h = [np.add.reduceat(common.mix(ids | np.arange(len(ids)) - np.repeat(first, last - first + 1) << 32 | side), first) for ids, first, last, side in ((a, first_a, last_a, 1 << 31), (b, first_b, last_b, 0))]
            code, seen = pd.factorize(common.signed(common.mix(h[0] * common.U64(0xD6E8FEB86659FD93) + h[1])))
        where = np.empty(len(seen), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        numbers = np.empty(len(seen), np.int64)
        for k, (key, i) in enumerate(zip(seen.tolist(), where.tolist(), strict=True)):
            if key not in self.number:
                self.number[key] = self._take(a[first_a[i] : last_a[i] + 1].tolist(), b[first_b[i] : last_b[i] + 1].tolist())
            numbers[k] = self.number[key]
        return numbers[code], np.searchsorted(first_a, np.concatenate([[0], np.cumsum(n_a)]))

    def _count(self, doc: np.ndarray, at: np.ndarray) -> None:
        """Adds, for each pair, the documents that hold it in any of their groups."""
        first, size = np.array(self.first)[at], np.diff(self.first)[at]
        pair = np.array(self.links, np.int64)[common.ragged(first, size)]
        held = np.unique(np.repeat(doc, size) * max(1, len(self.pair_number)) + pair)
        more = np.bincount(held % max(1, len(self.pair_number)), minlength=len(self.pair_number))
        more[: len(self.docs)] += self.docs
        self.docs = more

    def row(self, block: int) -> pa.RecordBatch:
        lists = ((self.keys, pa.binary()), (list(self.pair_number), pa.int64()), (self.docs, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([common.sealed(pa.concat_tables(self.rows))], pa.binary()), *(pa.array([x], pa.list_(kind)) for x, kind in lists)], ["block", "payload", "groups", "pairs", "docs"])


def interned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each block of documents: its documents by numbers of groups, its distinct groups, and its distinct pairs with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = TaskContext.get().partitionId() << 32, Dictionary(a, b)
        for block in common.blocks(batches):
            own.add(block)
            if own.bytes >= common.SHARED_BYTES:
                yield own.row(at)
                at, own = at + 1, Dictionary(a, b)
        if own.rows:
            yield own.row(at)

    common.bind(docs.sparkSession)
    return common.written(common.texts_of(docs).mapInArrow(run, BLOCK))


def expanded(groups: DataFrame, a: str, b: str) -> DataFrame:
    """group, pair and how often the group links it, for distinct groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = ([len(x) for x in m.bytes] for m in models(a, b))
        for batch in batches:
            rows = [(key, pair, n) for key in batch.column(0).to_pylist() for pair, n in Counter(links_of(*ids_of(key), size_a, size_b)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["group", "pair", "times"])

    return groups.mapInArrow(run, "group binary, pair long, times long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), docs (how many documents hold it linked) and best (whether no B id is linked in more with its A id)."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))  # at most A's vocabulary
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; a is a byte-level vocabulary's file, b a sentence-piece model's."""
    blocks = interned(docs, a, b)
    entries = blocks.select("block", F.posexplode("groups").alias("at", "group"))
    sums = (
        expanded(entries.select("group").distinct(), a, b)
        .join(pair_counts(blocks), "pair")
        .groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    )
    back = entries.join(sums, "group").groupBy("block").agg(F.collect_list(F.struct("at", "n_best", "count_sum")).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, sums in zip(batch.column(0), batch.column(1), strict=True):
                rows = common.opened(payload).combine_chunks()
                lists = rows.column("at").combine_chunks()
                at, times = lists.flatten().to_numpy(), rows.column("times").combine_chunks().flatten().to_numpy()
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                own, some = [], sums.values.field("at").to_numpy() if sums.is_valid else at[:0]  # groups of words of altered texts are no text's
                for name in ("n_best", "count_sum"):
                    of = np.zeros(1 + max(at.max(initial=0), some.max(initial=0)), np.int64)
                    if sums.is_valid:
                        of[some] = sums.values.field(name).to_numpy()
                    own.append(common.sums_of(of[at] * times, edge))
                n_a, n_b, n_groups = (rows.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
                cols = {"doc_id": rows.column("doc_id").to_numpy(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "n_best": own[0], "count_sum": own[1], "groups_sha256": rows.column("groups_sha256").to_pylist()}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], list(cols))

    return blocks.select("block", "payload").join(back, "block", "left").select("payload", "sums").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
