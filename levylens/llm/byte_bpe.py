"""Operator 10: byte-level BPE with vectorised pre-tokenisation.

A block of texts becomes one array of code points and one of their classes (white space, letter,
number, other). Class changes give most piece boundaries. English contractions need memory, so each
place holds the transition function of a four-state automaton, packed in a byte, and an associative
scan composes them until no result depends on the state before. The slices between boundaries feed a
merge loop with a cache. No regular expression reads the texts.

What is kept of a text is its ids, the byte offset of each slice and the place of each slice's first id.
Decoding puts each slice's bytes where its offset says, so any range of bytes can be decoded on its own.

Defined cases: null and empty texts give no ids; texts of any length are encoded whole; rows without
doc_id take no part; repeated rows give a result each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The code points with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a piece of its own.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(what, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[WHITE] = SPACE
        _classes = table
    return _classes


def _pack(f: tuple[int, int, int, int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4 | f[3] << 6


#: States: 0 plain, 1 and 2 so many letters of a contraction to come, 3 a contraction has just ended.
STEP, ONE, TWO = _pack((0, 3, 1, 0)), _pack((1, 1, 1, 1)), _pack((2, 2, 2, 2))
_after = np.array([[(f >> 2 * s) & 3 for s in range(4)] for f in range(256)], np.uint8)
#: COMPOSE[f, g] first does f and then g.
COMPOSE = sum(_after[np.arange(256)[None, :], _after[:, s][:, None]].astype(np.uint16) << 2 * s for s in range(4)).astype(np.uint8)
_fixed = (_after == _after[:, :1]).all(1)


def scan(f: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The state after each place, from 0 at each fresh place: an inclusive scan by doubling."""
    f = f.copy()
    f[fresh] = COMPOSE[_pack((0, 0, 0, 0)), f[fresh]]
    reach = 1
    while reach < len(f) and not _fixed[f].all():
        f[reach:] = COMPOSE[f[:-reach].copy(), f[reach:]]
        reach *= 2
    return f & 3


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; first marks the texts' first ones."""
    n = len(points)
    kind = classes()[points]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    ahead = ~last  # white space before something else: its last character stands alone or joins what follows
    ahead[:-1] &= kind[1:] != SPACE
    start |= (kind == SPACE) & ahead
    joined = ~first & (kind != SPACE)
    joined[1:] &= points[:-1] == 0x20
    start &= ~joined
    apostrophe = np.flatnonzero((points == 0x27) & start & ahead)
    if not len(apostrophe):
        return start
    f = np.full(n, STEP, np.uint8)
    one, two = points[apostrophe + 1], points[np.minimum(apostrophe + 2, n - 1)]
    f[apostrophe[np.isin(one, [ord(x) for x in SHORT])]] = ONE
    inside = ~last[apostrophe + 1]
    f[apostrophe[inside & np.any([(one == ord(x)) & (two == ord(y)) for x, y in LONG], axis=0)]] = TWO
    before = np.zeros(n, np.uint8)
    before[1:] = scan(f, first)[:-1]
    before[first] = 0
    return np.where((before == 1) | (before == 2), False, start | (before == 3))


class Bpe:
    """Ranks and their merges; pieces once merged are kept."""

    most = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v) for v in self.bytes}
        spelled = [self.bytes.get(i, b"") for i in range(max(self.bytes, default=-1) + 1)]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)  # the bytes of all ids, one after the other
        self.known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the neighbours of lowest rank, the leftmost first, until none can be joined."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while costs and (low := min(costs)) < 1 << 60:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """As merge, by a heap over linked neighbours: long pieces cost n log n."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, back = [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, to = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != to:
                continue
            end[i], end[mid] = to, -1
            if to < n:
                back[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, to, end[to]))
            if (b := back[i]) >= 0 and (r := ranks.get(piece[b:to])) is not None:
                heapq.heappush(heap, (r, b, i, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            new = {p for p in pieces if p not in known}
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = self.merge(p)
            return list(map(known.__getitem__, pieces))

    def decode(self, ids: np.ndarray, offsets: np.ndarray, firsts: np.ndarray) -> bytes:
        """The bytes of pieces, each put at its offset less the first's; firsts are the places of their first ids, and the last entry of both is the end."""
        if len(offsets) < 2:
            return b""
        size = self.size[ids]
        before = np.cumsum(size) - size
        ahead = np.repeat(before[np.minimum(firsts[:-1], len(ids) - 1)], np.diff(firsts))
        at = np.repeat(offsets[:-1] - offsets[0], np.diff(firsts)) + before - ahead
        out = np.zeros(offsets[-1] - offsets[0], np.uint8)
        out[common.ragged(at, size)] = self.letters[common.ragged(self.start[ids], size)]
        return out.tobytes()

    def decode_range(self, ids: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, start: int, end: int) -> bytes:
        """The bytes from start to end; only the pieces that have some of them are decoded."""
        start, end = max(0, start), min(end, int(offsets[-1])) if len(offsets) else 0
        if start >= end:
            return b""
        a, b = int(np.searchsorted(offsets, start, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        some = self.decode(ids[firsts[a] : firsts[b]], offsets[a : b + 1], firsts[a : b + 1] - firsts[a])
        return some[start - offsets[a] : end - offsets[a]]


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def pieces(block: common.Block) -> Iterator[tuple[int, np.ndarray]]:
    """For each document of the block: its place, and the byte offsets of its pieces, its end last."""
    n = len(block.data)
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    full = np.flatnonzero(np.diff(block.offsets))
    first[np.searchsorted(lead, block.offsets[full])] = True
    at = lead[boundaries(points, first)] if n else lead
    edge = np.searchsorted(at, block.offsets)
    for i in range(len(block.ids)):
        yield i, np.append(at[edge[i] : edge[i + 1]], block.offsets[i + 1]) - block.offsets[i]


def encode_block(block: common.Block, path: str) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """For each document: its place, its ids, the byte offset of each piece, and the place of each piece's first id, ends last."""
    bpe = model(path)
    for i, offs in pieces(block):
        text, cut = block.bytes_of(i), offs.tolist()
        merged = bpe.encode([text[a:b] for a, b in zip(cut, cut[1:])])
        yield i, list(chain.from_iterable(merged)), offs, np.cumsum([0, *map(len, merged)])


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, the ids, and for each piece the byte offset and the place of its first id, the ends last, by which decode() puts the bytes."""
    common.bind(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            rows = list(encode_block(block, ranks))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array([x[1] for x in rows], pa.list_(pa.int32())), *(pa.array([x[k] for x in rows], pa.list_(pa.int64())) for k in (2, 3))], ["doc_id", "ids", "offsets", "firsts"])

    return common.texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>, firsts array<long>")


def decode(encoded: DataFrame, ranks: str, start: int = 0, end: int | None = None) -> DataFrame:
    """doc_id and the bytes from start to end, by default all, of what encode() gave, by its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                ids, offsets, firsts = (x.values.to_numpy() for x in row)
                out.append(model(ranks).decode_range(ids, offsets, firsts, start, int(offsets[-1]) if end is None else end))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids", "offsets", "firsts").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids, and that of the bytes decoded from them by the offsets, in one pass."""
    common.bind(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks)
        for block in common.blocks(batches):
            count, ids_sha, text_sha = [], [], []
            for _, ids, offsets, firsts in encode_block(block, ranks):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.array(ids, np.int64), offsets, firsts)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
