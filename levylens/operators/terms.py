"""Term counts by tax, year, region and payer, and the clouds drawn from them.

texts: tax_code, region_code, payer, text and the period (year_from, year_to). Texts are cut into words in
Arrow batches: a batch's words become codes of its distinct ones, of which each is stemmed and looked up
among the stop words once, and pairs of neighbours, first places and counts are arithmetic on codes. So
words are counted before any exchange. Years are spread over the counts, not over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levylens import session
from levylens.functions import russian, text

from . import norms

BUCKET = ["tax_code", "year", "region_code", "payer"]
PERIOD = ["tax_code", "region_code", "payer", "year_from", "year_to"]
RF = "00"
CELL = "tax_code string, region_code string, payer string, year_from int, year_to int, term string, surface string, is_bigram int, n long, docs long"
#: Characters of text that are cut into words at once.
SLICE = 1 << 21
#: Rows of frequent words, a word for each bucket, up to which pairs are held against them.
FREQUENT = 500_000
_word = re.compile("[а-яa-z0-9][а-яa-z0-9-]+")
_number = re.compile("[0-9-]+")

#: Distinct words to their terms.
Stemmer = Callable[[list[str]], list[str]]


def snowball(words: list[str]) -> list[str]:
    return [russian.stem(w) for w in words]


def _counted(terms: np.ndarray, surfaces: np.ndarray, row: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Period, term, surface, occurrences and texts of each distinct triple; surfaces are numbered in order, and a text counts for its first surface of a term."""
    order = np.lexsort((surfaces, terms, row))
    row, terms, surfaces = row[order], terms[order], surfaces[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
    p = period[row]
    order = np.lexsort((surfaces, terms, p))
    p, terms, surfaces, fresh = p[order], terms[order], surfaces[order], fresh[order]
    edge = np.ones(len(p), bool)
    edge[1:] = (p[1:] != p[:-1]) | (terms[1:] != terms[:-1]) | (surfaces[1:] != surfaces[:-1])
    at = np.flatnonzero(edge)
    return p[at], terms[at], surfaces[at], np.diff(np.append(at, len(p))), np.add.reduceat(fresh, at, dtype=np.int64) if len(at) else at


def count_slice(texts: list[str], period: np.ndarray, stops: frozenset[str], stemmer: Stemmer | None, unigrams: bool, bigrams: bool) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, int, np.ndarray, np.ndarray]]:
    """For words and pairs of some texts: period, terms, surfaces, whether pairs, occurrences and texts.

    Words of one character are none; numbers, words under three characters and stop words (as written or
    stemmed) are left out but keep their places, so they part the words beside them.
    """
    said = [_word.findall(t.lower().replace("ё", "е")) for t in texts]
    row = np.repeat(np.arange(len(said)), [len(x) for x in said])
    coded = pa.array(chain.from_iterable(said), pa.string()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code, listed = place[coded.indices.to_numpy()], coded.dictionary.take(order)
    words = listed.to_pylist()
    terms = stemmer(words) if stemmer else words
    kept = np.array([len(w) >= 3 and not _number.fullmatch(w) and w not in stops and t not in stops for w, t in zip(words, terms)], bool)
    named = pa.array(terms, pa.string()).dictionary_encode()
    number, named, n = named.indices.to_numpy().astype(np.int64), named.dictionary, max(1, len(words))
    at = np.flatnonzero(kept[code]) if words else np.zeros(0, np.int64)
    if unigrams and len(at):
        p, t, s, times, docs = _counted(number[code[at]], code[at], row[at], period)
        yield p, named.take(pa.array(t)), listed.take(pa.array(s)), 0, times, docs
    if bigrams and len(at):
        two = at[:-1][(np.diff(at) == 1) & (row[at[1:]] == row[at[:-1]])]
        a, b = code[two], code[two + 1]
        p, t, s, times, docs = _counted(number[a] * n + number[b], a * n + b, row[two], period)
        both = lambda x, k: pc.binary_join_element_wise(x.take(pa.array(k // n)), x.take(pa.array(k % n)), " ")
        yield p, both(named, t), both(listed, s), 1, times, docs


def cells(texts: DataFrame, stops: list[str], unigrams: bool = True, bigrams: bool = True, stem: bool | Stemmer = True) -> DataFrame:
    """A8 before the years: occurrences and texts of each term and surface by tax, region, payer and period."""
    return partial_cells(texts, stops, unigrams, bigrams, stem).groupBy(*PERIOD, "term", "surface", "is_bigram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def partial_cells(texts: DataFrame, stops: list[str], unigrams: bool = True, bigrams: bool = True, stem: bool | Stemmer = True) -> DataFrame:
    """cells() as sums of some texts each, without an exchange. stem: Snowball's stems, the words themselves, or terms of one's own."""
    stemmer, left_out = (stem if callable(stem) else snowball if stem else None), frozenset(stops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(PERIOD).to_pandas()
            said = [t or "" for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) for t in said])
            a = 0
            while a < len(said):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
                some = frame.iloc[a:b]
                group = some.groupby(PERIOD, dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1] + a
                for p, terms, surfaces, two, times, docs in count_slice(said[a:b], group, left_out, stemmer, unigrams, bigrams):
                    own = batch.select(PERIOD).take(pa.array(first[p]))
                    yield pa.RecordBatch.from_arrays([*own.columns, terms, surfaces, pa.array(np.full(len(p), two, np.int32)), pa.array(times, pa.int64()), pa.array(docs, pa.int64())], [*PERIOD, "term", "surface", "is_bigram", "n", "docs"])
                a = b

    session.bind(texts.sparkSession)
    kinds = dict(c.split() for c in CELL.split(", "))
    return session.spread(texts.select(*(F.col(c).cast(kinds[c]).alias(c) for c in PERIOD), F.col("text").cast("string").alias("text"))).mapInArrow(run, CELL)


def count_terms(counted: DataFrame, last: int) -> DataFrame:
    """Occurrences and texts of each term in each bucket, from cells() or partial_cells(); one exchange."""
    return _sums(_yearly(counted, last))


def _yearly(counted: DataFrame, last: int) -> DataFrame:
    return norms.explode_years(counted.select(*PERIOD, "term", "is_bigram", "n", "docs"), last)


def _sums(yearly: DataFrame) -> DataFrame:
    return yearly.groupBy(*BUCKET, "term", "is_bigram").agg(F.sum("n").alias("term_freq"), F.sum("docs").alias("doc_freq"))


def with_all_regions(cube: DataFrame) -> DataFrame:
    """A10: the cube and its sum over regions, in the place of an earlier one."""
    own = cube.where(F.col("region_code") != RF)
    total = own.groupBy("tax_code", "year", "payer", "term", "is_bigram").agg(F.sum("term_freq").alias("term_freq"), F.sum("doc_freq").alias("doc_freq"))
    return own.unionByName(total.withColumn("region_code", F.lit(RF)))


def top_terms(cube: DataFrame, n: int = 400) -> DataFrame:
    """The n most frequent terms of each bucket."""
    w = Window.partitionBy(*BUCKET).orderBy(F.desc("term_freq"), F.desc("doc_freq"), "term")
    return cube.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def _with_ties(cube: DataFrame, n: int) -> DataFrame:
    """The terms of each bucket that are as frequent as its n-th."""
    w = Window.partitionBy(*BUCKET).orderBy(F.desc("term_freq"))
    return cube.withColumn("rn", F.rank().over(w)).where(F.col("rn") <= n).drop("rn")


def _hopeful(pairs: DataFrame, words: DataFrame, last: int) -> DataFrame:
    """The pairs by years, without those of which neither their own bucket nor the sum over regions has both words among `words`; all of them if these are too many to be sent to every task.

    What is left out of a bucket is less frequent there than each of its `words`, and so are what sums are left of it.
    """
    slot = ["tax_code", "year", "payer"]
    own = words.where(F.col("region_code") != RF).select(*slot, "region_code", "term")
    everywhere = words.where(F.col("region_code") == RF).select(*slot, "term").alias("o")
    regions = own.select(*slot, "region_code").distinct().alias("r")
    spread = regions.join(everywhere, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in slot]).select(*(f"r.{c}" for c in slot), "r.region_code", "o.term")
    known = session.kept(own.unionByName(spread).distinct())
    rows = _yearly(pairs, last)
    if known.limit(FREQUENT + 1).count() > FREQUENT:
        return rows
    parts = F.split("term", " ")
    rows = rows.withColumn("first_", F.get(parts, F.lit(0))).withColumn("second_", F.when(F.size(parts) == 2, F.get(parts, F.lit(1))))
    other = rows.where("second_ IS NULL")  # terms of one's own may hold spaces
    rows = rows.where("second_ IS NOT NULL")
    for word in ("first_", "second_"):
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in BUCKET] + [F.col(f"p.{word}") == F.col("k.term")]
        rows = rows.alias("p").join(F.broadcast(known.alias("k")), same, "left_semi")
    return rows.unionByName(other).drop("first_", "second_") if _spaced(pairs) else rows.drop("first_", "second_")


def _spaced(pairs: DataFrame) -> bool:
    """Whether some pair is of terms that hold spaces themselves."""
    return pairs.where("size(split(term, ' ')) <> 2").limit(1).count() > 0


def display_forms(words: DataFrame, n: Column | None = None) -> DataFrame:
    """The surface that a term has most often, of equals the least; a row is one occurrence, or n."""
    counted = words.groupBy("term", "surface").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))
    return counted.groupBy("term").agg(F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("display"))


def build_cube(texts: DataFrame, stops: list[str], last: int, top: int = 400, with_bigrams: bool = True, stem: bool | Stemmer = True) -> DataFrame:
    """Q11's cube: unigrams and bigrams, with the sum over regions, pruned after it.

    The partial cells are written once, by columns, so texts are cut into words once; a surface that is its
    term is null there. A pair is at most as frequent as either of its words, so one of a word that is less
    frequent than a bucket's top-th word is none of its top, and is left out before the exchange. The pruned
    cube is written too, and surfaces are counted only of the terms that it has.
    """
    cells_ = partial_cells(texts, stops, bigrams=with_bigrams, stem=stem)
    counted = session.kept(cells_.withColumn("surface", F.nullif("surface", "term")))
    words = session.kept(_with_ties(with_all_regions(count_terms(counted.where("is_bigram = 0"), last)), top))
    pairs = with_all_regions(_sums(_hopeful(counted.where("is_bigram = 1"), words, last)))
    cube = session.kept(top_terms(words.unionByName(pairs) if with_bigrams else words, top))
    mine = counted.join(cube.select("term").distinct(), "term", "left_semi").withColumn("surface", F.coalesce("surface", "term"))
    return cube.join(display_forms(spread_surfaces(mine, last), F.col("n")), "term", "left")


class Cube:
    """A cube kept below a path, to which texts are added run by run.

    Each run's counts and surfaces are sums of its own texts, before any pruning, in a partition of its
    own, so a run that is repeated replaces itself. After a run only the buckets that it touched (and
    their sums over regions) are ranked again, from the sums of all runs.
    """

    COUNTS = "tax_code string, year int, region_code string, payer string, term string, is_bigram int, term_freq long, doc_freq long"
    SURFACES = "term string, surface string, n long"

    def __init__(self, spark: SparkSession, path: str, last: int, top: int = 400):
        self.spark, self.path, self.last, self.top = spark, path.rstrip("/"), last, top

    def _all(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, run long").parquet(f"{self.path}/{what}")

    def add(self, texts: DataFrame, stops: list[str], run: int, bigrams: bool = True, stem: bool | Stemmer = True) -> None:
        """Adds texts as the run of that number; a run that was added before is replaced, with the buckets that it had touched."""
        counted = session.kept(partial_cells(texts, stops, bigrams=bigrams, stem=stem))
        place = lambda what: f"{self.path}/{what}/run={run}"
        slot = ["tax_code", "year", "payer"]
        before = self._touched(run)
        count_terms(counted, self.last).select(*(c.split()[0] for c in self.COUNTS.split(", "))).write.mode("overwrite").partitionBy("tax_code", "year").parquet(place("counts"))
        spread_surfaces(counted, self.last).write.mode("overwrite").parquet(place("surfaces"))
        rows = self._all("counts", self.COUNTS)
        touched = rows.where(F.col("run") == run).select(*slot).distinct()
        touched = session.kept(touched.unionByName(before).distinct() if before is not None else touched)
        mine = _only(rows, touched, slot)
        summed = mine.groupBy(*BUCKET, "term", "is_bigram").agg(F.sum("term_freq").alias("term_freq"), F.sum("doc_freq").alias("doc_freq"))
        ranked = session.kept(top_terms(with_all_regions(summed), self.top))
        gone = _only(touched, ranked, slot, "left_anti") if before is not None else None
        ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slot).parquet(f"{self.path}/cube")
        if gone is not None and gone.limit(1).count():  # slots that only the replaced run had
            left = _only(self._cube(), session.kept(gone), slot, "left_anti")
            session.kept(left).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*slot).parquet(f"{self.path}/cube")

    def _touched(self, run: int) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self._all("counts", self.COUNTS).where(F.col("run") == run)
            return session.kept(rows.select("tax_code", "year", "payer").distinct())
        except AnalysisException:
            return None

    def _cube(self) -> DataFrame:
        return self.spark.read.schema(self.COUNTS).parquet(f"{self.path}/cube")

    def read(self) -> DataFrame:
        """The cube as build_cube() over all runs' texts gives it."""
        shown = display_forms(self._all("surfaces", self.SURFACES), F.col("n"))
        return self._cube().join(shown, "term", "left")


def _only(rows: DataFrame, others: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose columns, null like null, are (left_semi) or are not (left_anti) among the others'."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns]
    return rows.alias("r").join(others.select(*columns).distinct().alias("o"), same, how)


def spread_surfaces(counted: DataFrame, last: int) -> DataFrame:
    """term, surface and n: how often, once for each bucket that a text is in."""
    years = F.size(norms.years_of(last)).cast("long")
    return counted.groupBy("term", "surface").agg(F.sum(F.col("n") * years).alias("n"))


def stop_forms(lists: DataFrame, extra: list[str] = ()) -> DataFrame:
    """words of the stop lists (column word) and extra ones as they are, as tokens and as stems."""
    more = lists.select("word").unionByName(lists.sparkSession.createDataFrame([(w,) for w in extra], "word string"))
    tokens = text.tokenize(F.col("word"))
    forms = F.concat(F.array(F.lower("word")), tokens, russian.stems_udf(tokens))
    return more.select(F.explode(forms).alias("word")).where("word <> ''").distinct()


def cloud(cube: DataFrame, tax: str, payer: str, years: list[int] | None = None, regions: list[str] | None = None, limit: int = 120, mode: str = "freq", include_bigrams: bool = True) -> DataFrame:
    """Terms of a payer by frequency, or by how far they mark it off from the other payers, beside the number of all its terms."""
    rows = cube.where((F.col("tax_code") == tax) & F.col("region_code").isin(regions or [RF]))
    rows = rows.where(F.col("year").isin(years)) if years else rows
    rows = rows if include_bigrams else rows.where("is_bigram = 0")
    mine: Column = F.col("payer") == payer
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    terms = rows.groupBy("term").agg(F.max("is_bigram").alias("is_bigram"), total("term_freq", mine).alias("freq"), total("doc_freq", mine).alias("docs"), total("term_freq", ~mine).alias("other"))
    sums = terms.agg(F.sum("freq").alias("all_freq"), F.sum("other").alias("all_other"), F.count_if(F.col("freq") > 0).alias("total_terms"))
    odds = F.log((F.col("freq") / F.col("all_freq")) / ((F.col("other") + 1) / (F.col("all_other") + 1)))
    plain = F.col("freq").cast("double")
    score = F.when((F.col("all_freq") > 0) & (F.col("all_other") > 0), F.col("freq") * F.greatest(F.lit(0.0), odds)).otherwise(plain) if mode == "distinctive" else plain
    out = terms.where("freq > 0").crossJoin(F.broadcast(sums)).withColumn("score", F.round(score, 4))  # sums is one row
    return out.select("term", "is_bigram", "freq", "docs", "score", "total_terms").orderBy(F.desc("score"), F.desc("freq"), "term").limit(limit)


def without_words(cloud_: DataFrame, words: list[str]) -> DataFrame:
    """The cloud without terms that hold one of the words."""
    held = F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(F.col("term"), w)) if words else F.lit(False)
    return cloud_.where(~held)
