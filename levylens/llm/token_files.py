"""Operator 1: token ids as Arrow stream files of equal-length sequences with masks.

Documents are put in ascending doc_id order by one range exchange, encoded, and packed into
sequences of `length` ids. Every part is an Arrow IPC stream of record batches with the columns
`ids` (fixed-size list of uint16, or uint32 for large vocabularies) and `mask` (fixed-size list of
bool; false where the last sequence of a part is padded), so sequence k is a view into the mapped
file at a computed place. A second stream per part, the index, has each document's id, first token
and token count.

Defined cases: a null or empty text gives just the end id; a row without doc_id takes no part;
repeated doc_ids are written once each, ordered by text; an empty table gives no parts and an empty
result; a text of any length is written whole, across sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MANIFEST = "part int, path string, n_docs long, n_tokens long"
ROWS_PER_BATCH = 256


#: Fixed value: how the vocabulary this encoder knows the rules of cuts a text into pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of Latin-1 letters, digits and ASCII marks, and their pieces by SPLIT; without "'" (contractions) and "<" (special tokens).
PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}


class WordEncoder:
    """Whole texts to ids with the tokenizers library, one call for each new word or piece.

    The vocabulary's normaliser and splitter never join what white space separates, so a text's ids
    are those of its words in turn. Words are lower-cased (A-Z) before the lookup as the vocabulary
    lower-cases anyway, unless the text may hold a special token, which is matched before that.
    A new word whose normal form and pieces are plain goes to the library's merges piece by piece;
    any other word, and any word under a vocabulary with other rules, takes the library's whole way.
    """

    most = 800_000  # words and pieces kept, some 200 bytes each

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.merges, self.letters, self.plain = self.tokenizer.model, byte_letters(), self._cuts_as_known()
        self.packed = [k.to_bytes(self.dtype.itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _cuts_as_known(self) -> bool:
        rules = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = (cuts[0].get("pattern") or {}).get("Regex") if cuts else None
        return normal == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and first == SPLIT and not cuts[1]["add_prefix_space"]

    def _learn(self, new: set[bytes]) -> None:
        known, packed, merge, other = self.known, self.packed, self.merges.tokenize, []
        for w in new:
            word = w.decode().lower()
            if not (self.plain and PLAIN.fullmatch(word)):
                other.append(w)
                continue
            ids = []
            for piece in PIECE.findall(word):
                raw = piece.encode()
                if (own := known.get(raw)) is None:
                    spelt = piece if piece.isascii() else raw.decode("latin-1").translate(self.letters)
                    own = known[raw] = b"".join([packed[t.id] for t in merge(spelt)])
                ids.append(own)
            known[w] = b"".join(ids)
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                known[w] = b"".join([packed[k] for k in e.ids])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as self.dtype; the new words of all texts are learned first."""
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        seen = set().union(*words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = seen
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each vocabulary and worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class PartWriter:
    """Writes one part under a name of its own and renames it when whole."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int):
        self.fs, top = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(top, recursive=True)
        self.path, self.dtype, self.length = f"{top}/{name}", np.dtype(dtype), length
        self.schema = sequence_schema(self.dtype, length)
        self.sink, self.side = (self.fs.open_output_stream(f"{self.path}{x}.writing") for x in (".arrow", ".index.arrow"))
        self.out, self.index = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_stream(self.side, INDEX_SCHEMA)
        self.rest: list[bytes] = []
        self.pending, self.n_docs, self.n_tokens = 0, 0, 0

    def add(self, doc_ids: list[int], texts: list[bytes]) -> None:
        counts = np.array([len(x) // self.dtype.itemsize for x in texts], np.int64)
        first = self.n_tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(first), pa.array(counts)], schema=INDEX_SCHEMA))
        self.rest += texts
        self.pending += int(counts.sum())
        self.n_docs += len(texts)
        self.n_tokens += int(counts.sum())
        if self.pending >= ROWS_PER_BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.dtype)
        whole = len(ids) // self.length
        if last and len(ids) % self.length:
            ids, real, whole = np.concatenate([ids, np.zeros(self.length - len(ids) % self.length, self.dtype)]), len(ids), whole + 1
        else:
            whole -= 0 if last else whole % ROWS_PER_BATCH
            real = whole * self.length
        for at in range(0, whole, ROWS_PER_BATCH):
            to = min(whole, at + ROWS_PER_BATCH)
            span = slice(at * self.length, to * self.length)
            mask = np.arange(span.start, span.stop) < real
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids[span], mask)], schema=self.schema))
        self.rest = [] if last else [ids[whole * self.length :].tobytes()]
        self.pending = 0 if last else len(ids) - whole * self.length

    def close(self) -> None:
        self.flush(True)
        for x in (self.out, self.sink, self.index, self.side):
            x.close()
        for x in (".arrow", ".index.arrow"):
            self.fs.move(f"{self.path}{x}.writing", f"{self.path}{x}")


class PartReader:
    """Random access to a part; ids and masks are views into the file's buffer."""

    def __init__(self, folder: str, name: str):
        self.fs, top = pafs.FileSystem.from_uri(folder)
        self.batches = self._open(f"{top}/{name}.arrow").read_all().to_batches()
        self.index = self._open(f"{top}/{name}.index.arrow").read_all()
        self.ids = [b.column(0).values.to_numpy(zero_copy_only=True) for b in self.batches]
        self.length = self.batches[0].schema.field(0).type.list_size if self.batches else 0
        self.ends = np.cumsum([len(x) for x in self.ids])

    def _open(self, path: str):
        source = pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else pa.BufferReader(self.fs.open_input_file(path).read_buffer())
        return pa.ipc.open_stream(source)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of sequence k, without a copy, and its mask."""
        b = int(np.searchsorted(self.ends, k * self.length, "right"))
        row = k - (int(self.ends[b - 1]) // self.length if b else 0)
        return self.ids[b][row * self.length : (row + 1) * self.length], self.batches[b].column(1)[row].values

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n ids from place first of the part; a copy only where they lie across batches."""
        out, b = [], int(np.searchsorted(self.ends, first, "right"))
        while n > 0:
            at = first - (int(self.ends[b - 1]) if b else 0)
            out.append(self.ids[b][at : at + n])
            n, first, b = n - len(out[-1]), first + len(out[-1]), b + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048) -> list:
    """Encodes docs into part files below folder, in ascending doc_id order; returns the manifest's rows in that order."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, out = TaskContext.get(), encoder(vocabulary), None
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for block in common.blocks(batches):
            out = out or PartWriter(folder, name, enc.dtype, length)
            out.add(block.ids.tolist(), [ids + end for ids in enc.encode([block.bytes_of(i) for i in range(len(block.ids))])])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([out.n_docs]), pa.array([out.n_tokens])], ["part", "path", "n_docs", "n_tokens"])

    ordered = common.texts_of(docs).repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.part)  # a row for each part


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    schema, start, rows = "doc_id long, start long, n_tokens long, ids_crc32 long", 0, []
    for r in manifest:
        rows.append((r.path, start))
        start += r.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = PartReader(folder, path)
                first, n = (part.index.column(k).to_numpy() for k in (1, 2))
                crc = [zlib.crc32(part.tokens(a, k).astype("<u4").tobytes()) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.index.column(0).combine_chunks(), pa.array(first + before), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = pa.table({"path": pa.array([p for p, _ in rows], pa.string()), "before": pa.array([n for _, n in rows], pa.int64())})
    parts = spark.createDataFrame(listed).repartition(max(1, len(rows)), "path")  # through Arrow: no worker starts for it
    return parts.mapInArrow(read, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    spark = common.bind(docs.sparkSession)
    folder = common.shared_folder(spark)
    return read_token_files(spark, folder, write_token_files(docs, folder, vocabulary, end_id, length))
