"""Shared pieces of the corpus operators: the shared folder, Arrow text batches, word hashing.

Texts are treated as UTF-8 bytes read straight from Arrow buffers, so no Python string is made
unless an operator needs one. A null text counts as an empty one everywhere in this package.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text handled at once; a longer document is handled alone.
BLOCK_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one named in spark.checkpoint.dir (in local mode an own one if unset)."""
    return f"{_checkpoint_root(spark)}/levylens-{uuid.uuid4().hex}"


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_levylens_root", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="levylens-")
        sc._levylens_root = root
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: What Python workers are started with: allocations of over 4 MB go back to the system when freed, so an idle worker holds little.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2"}
#: Bytes and rows of an Arrow batch, as texts of any length are sent in them.
BATCH_BYTES, BATCH_ROWS = "4m", "2000"


def bind(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started, and bounds what they hold; settings that the session has stay."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, paths)])
    for name, value in WORKER.items():
        env.setdefault(name, value)
    for name, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)
    return spark


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; further columns of docs do not matter.

    A row without an id cannot be named in a result and takes no part.
    """
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [f"own{k}_" for k in range(len(taken) + n) if f"own{k}_" not in taken][:n]


# ---------------------------------------------------------------- Arrow text


@dataclass
class Block:
    """Some documents of a batch: ids, their bytes in one array, and len(ids) + 1 offsets."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts (doc_id, text) batches into blocks of about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        col = batch.column(1).cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield Block(ids[at:to], data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


def packed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text as compressed bytes, for an exchange; unpack() undoes one value. A null stays null."""
    place = df.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                cols = list(some.columns)
                cols[place] = pa.array([None if t is None else press.compress(t.encode()) for t in some.column(place).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return df.mapInArrow(run, schema)


def unpack(value: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def keep_rows(docs: DataFrame, keeps: Callable[[Block], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, for whose (doc_id, text) keeps() says so."""
    at = [docs.columns.index(c) for c in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()).fill_null(0), batch.column(at[1])], ["doc_id", "text"])
                yield batch.filter(pa.array(np.concatenate([keeps(b) for b in blocks(iter([two]))])))

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of the longest word that is hashed with others at once.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i < at least n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            steps = [np.full(size, x, U64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            _powers[:] = [np.multiply.accumulate(x) for x in steps]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def folding(same: dict[int, int] | None = None) -> np.ndarray:
    """The byte that each byte counts as: A-Z as a-z, and further ones as same says."""
    out = _LOWER.copy()
    for a, b in (same or {}).items():
        out[a] = b
    return out


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice of data, eight bytes at a time, each time spread over all bits; long ones by xxHash."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size <= LONG_WORD)
    with np.errstate(over="ignore"):
        for k in range(0, LONG_WORD, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            left = np.minimum(size[at] - k, 8).astype(U64)
            lane = lanes[start[at] + k] & (~U64(0) >> (U64(64) - left * U64(8)))
            out[at] = mix((out[at] ^ lane) * U64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return out


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Sums whose differences, brought to position 0, hash any slice of data; for slices of under 1,000 bytes, as longer ones can be built to collide."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


@dataclass
class Words:
    """Hashes of a block's words; words of document i are those from first[i] to first[i + 1]; folded has the bytes that were hashed."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray


def words(block: Block, gap: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> Words:
    """Words are runs of bytes outside gap, by default 0x20 and 0x09-0x0D; by default A-Z count as a-z."""
    n = len(block.data)
    inside = ~gap[block.data]
    fresh = np.ones(n + 1, bool)  # whether a word cannot go on from the byte before
    fresh[1:n] = ~inside[: max(0, n - 1)]
    fresh[block.offsets[:-1]] = True
    start = np.flatnonzero(inside & fresh[:n])
    stop = np.ones(n + 1, bool)
    stop[:n] = ~inside
    stop[block.offsets] = True
    end = np.flatnonzero(inside & stop[1:]) + 1
    folded = fold[block.data]
    return Words(hash_slices(folded, start, end), start, end, np.searchsorted(start, block.offsets), folded)


def word_hash(word: str) -> int:
    """The hash that words() gives to this word."""
    return int(words(one_block(word)).hash[0])


def one_block(*texts: str | bytes) -> Block:
    parts = [t.encode() if isinstance(t, str) else t for t in texts]
    return Block(np.arange(len(parts)), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of h, one for each place at which n items are left."""
    if len(h) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            out = mix(out * U64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- blocks of documents that share a dictionary

#: Bytes of text whose documents share a dictionary; a longer document has one of its own.
SHARED_BYTES = 8 << 20


def sealed(table: pa.Table) -> bytes:
    """A table as one compressed value; opened() undoes it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of size[0], then those of the next slice, and so on."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def sums_of(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The sum of each slice from edge[i] to edge[i + 1]."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[edge[1:]] - total[edge[:-1]]


def written(df: DataFrame) -> DataFrame:
    """df, written below the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's place, from 1, under the order: one range exchange, and a count a partition.

    Ties keep some order among themselves, so order must end in what tells rows apart.
    """
    spark = df.sparkSession
    row, part, below = free_names(df, 3)
    dealt = checkpointed(df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND((1 << 33) - 1))
    counts = sorted(dealt.groupBy(part).count().collect())  # a row a partition
    befores, total = [], 0
    for p, n in counts:
        befores.append((p, total))
        total += n
    return dealt.join(F.broadcast(spark.createDataFrame(befores, f"{part} long, {below} long")), part).withColumn(name, F.col(row) + F.col(below) + 1).drop(row, part, below)
