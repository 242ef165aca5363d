"""terms by a user's table of word forms, which workers map instead of holding it."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import russian

#: Forms of the largest table; a dictionary of a language has some millions.
MOST = 20_000_000
_mapped: dict[str, tuple[np.ndarray, pa.Array, pa.DictionaryArray]] = {}


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


class Lemmas:
    """The lemma of each known form, the stem of any other word; goes where terms take a stemmer.

    The table is one Arrow file, sorted by the forms' hashes, that Spark brings to each executor's host
    once. Its workers map it, so it is in memory once a host and page by page, and look words up by
    bisection of the hashes.
    """

    def __init__(self, name: str):
        self.name = name

    @classmethod
    def of(cls, forms: DataFrame, most: int = MOST) -> Lemmas:
        """forms: form and lemma; case and ё do not matter, of several lemmas of a form the least counts. A table of over `most` forms is an error."""
        plain = lambda c: F.replace(F.lower(F.trim(c)), F.lit("ё"), F.lit("е"))
        rows = forms.select(plain(F.col("form")).alias("form"), plain(F.col("lemma")).alias("lemma")).where("form <> '' AND lemma <> ''").groupBy("form").agg(F.min("lemma").alias("lemma"))
        table = rows.limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ValueError(f"a table of over {most} forms")
        keys = np.array([_hash(w) for w in table.column("form").to_pylist()], np.uint64)
        order = pa.array(np.argsort(keys, kind="stable"))
        lemma = table.column("lemma").combine_chunks().take(order).dictionary_encode()
        out = pa.table({"key": pa.array(keys).take(order), "form": table.column("form").combine_chunks().take(order), "lemma": lemma})
        name = f"lemmas-{uuid.uuid4().hex}.arrow"
        path = os.path.join(tempfile.mkdtemp(prefix="levylens-"), name)
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, out.schema) as writer:
            writer.write_table(out, max_chunksize=max(1, out.num_rows))
        forms.sparkSession.sparkContext.addFile(path)  # from the driver to every executor
        return cls(name)

    def _table(self) -> tuple[np.ndarray, pa.Array, pa.DictionaryArray]:
        if self.name not in _mapped:
            table = pa.ipc.open_file(pa.memory_map(SparkFiles.get(self.name))).read_all().combine_chunks()
            key, form, lemma = (table.column(k).chunk(0) if table.num_rows else table.column(k).combine_chunks() for k in range(3))
            _mapped[self.name] = key.to_numpy(), form, lemma
        return _mapped[self.name]

    def __call__(self, words: list[str]) -> list[str]:
        keys, forms, lemmas = self._table()
        wanted = np.array([_hash(w) for w in words], np.uint64)
        at = np.searchsorted(keys, wanted)
        out = []
        for word, key, i in zip(words, wanted.tolist(), at.tolist(), strict=True):
            found = None
            while i < len(keys) and keys[i] == key and found is None:  # two forms of a hash lie side by side
                found = lemmas[i].as_py() if forms[i].as_py() == word else None
                i += 1
            out.append(found if found is not None else russian.stem(word))
        return out
