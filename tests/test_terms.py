"""Term counts by batches against counting by hand; cubes built in runs; lemmas of a form table."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from levylens import session
from levylens.functions import russian
from levylens.functions.lemmas import Lemmas
from levylens.operators import terms

STOPS = ["налог", "для", "the"]
SCHEMA = "tax_code string, region_code string, payer string, year_from int, year_to int, text string"


def case(n=150, seed=7):
    rng = random.Random(seed)
    words = ["Налоги", "налог", "Льготы", "льгота", "льготам", "Инвалиды", "инвалидам", "для", "12-3", "x", "яд", "транспорт-ный", "Ёлка", "елка", "земля", "Земли", "the", "и"]
    rows = []
    for _ in range(n):
        text = rng.choice([" ", ", ", " - "]).join(rng.choices(words, k=rng.randint(0, 25)))
        rows.append((rng.choice(["tn", "zn", None]), rng.choice(["77", "50", "16"]), rng.choice(["fl", "ul"]), rng.choice([None, 2019, 2020, 2021]), rng.choice([None, 2020, 2022]), rng.choice([text, text, None if rng.random() < 0.1 else text])))
    return rows


def brute(rows, stem):
    """Occurrences and texts by tax, region, payer, period, term, surface and kind."""
    found = defaultdict(lambda: [0, 0])
    for *period, text in rows:
        said = [w for w in re.findall("[а-яa-z0-9][а-яa-z0-9-]*", (text or "").lower().replace("ё", "е")) if len(w) > 1]
        kept = [(i, w, stem(w)) for i, w in enumerate(said) if len(w) >= 3 and not re.fullmatch("[0-9-]+", w) and w not in STOPS and stem(w) not in STOPS]
        pairs = [(a[1] + " " + b[1], a[2] + " " + b[2]) for a, b in zip(kept, kept[1:]) if b[0] == a[0] + 1]
        for kind, listed in ((0, [(w, t) for _, w, t in kept]), (1, pairs)):
            for w, t in listed:
                found[(*period, t, w, kind)][0] += 1
            for t in {t for _, t in listed}:
                found[(*period, t, min(w for w, u in listed if u == t), kind)][1] += 1
    return Counter({(*k, *v): 1 for k, v in found.items()})


@pytest.mark.parametrize("stem", [False, True])
def test_cells(spark, monkeypatch, stem):
    rows = case()
    got = terms.cells(spark.createDataFrame(rows, SCHEMA).repartition(3), STOPS, stem=stem).collect()
    assert Counter(map(tuple, got)) == brute(rows, russian.stem if stem else lambda w: w)
    only = terms.cells(spark.createDataFrame(rows, SCHEMA), STOPS, unigrams=False, stem=stem)
    assert {r.is_bigram for r in only.collect()} == {1}
    assert terms.cells(spark.createDataFrame([], SCHEMA), STOPS).count() == 0


def test_slices_of_a_batch_add_up(monkeypatch):
    rows = case(40, 3)
    texts = [r[-1] or "" for r in rows]
    whole = Counter()
    for p, t, s, two, n, d in terms.count_slice(texts, terms.np.zeros(len(texts), int), frozenset(STOPS), None, True, True):
        for x in zip(p, t.to_pylist(), s.to_pylist(), n, d):
            whole[(two, *x[1:3])] += 1000 * x[3] + x[4]
    parts = Counter()
    for text in texts:
        for p, t, s, two, n, d in terms.count_slice([text], terms.np.zeros(1, int), frozenset(STOPS), None, True, True):
            for x in zip(p, t.to_pylist(), s.to_pylist(), n, d):
                parts[(two, *x[1:3])] += 1000 * x[3] + x[4]
    assert whole == parts and whole


def plain(cube):
    cols = ["tax_code", "year", "region_code", "payer", "term", "is_bigram", "term_freq", "doc_freq", "display"]
    return sorted(map(repr, map(tuple, cube.select(*cols).collect())))


def test_runs_add_up_to_the_whole_cube(spark, tmp_path):
    rows = [(t or "tn", *rest) for t, *rest in case(120, 11)]
    half, other = spark.createDataFrame(rows[:60], SCHEMA), spark.createDataFrame(rows[60:], SCHEMA)
    whole = plain(terms.build_cube(spark.createDataFrame(rows, SCHEMA), STOPS, 2022, top=15))
    cube = terms.Cube(spark, str(tmp_path / "cube"), 2022, top=15)
    cube.add(half, STOPS, 1)
    assert plain(cube.read()) == plain(terms.build_cube(half, STOPS, 2022, top=15))
    untouched = cube._cube().where("tax_code = 'none'")
    cube.add(other, STOPS, 2)
    assert plain(cube.read()) == whole and untouched.count() == 0
    cube.add(other, STOPS, 2)  # again
    assert plain(cube.read()) == whole
    cube.add(other.where("payer = 'none'"), STOPS, 2)  # replaced by nothing
    assert plain(cube.read()) == plain(terms.build_cube(half, STOPS, 2022, top=15))


def test_only_touched_buckets_are_written(spark, tmp_path):
    cube = terms.Cube(spark, str(tmp_path / "cube"), 2022)
    cube.add(spark.createDataFrame([("tn", "77", "fl", 2020, 2020, "льготы инвалидам")], SCHEMA), STOPS, 1)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "cube" / "cube").rglob("*.parquet")}
    before = files()
    cube.add(spark.createDataFrame([("zn", "77", "fl", 2021, 2021, "льготы ветеранам")], SCHEMA), STOPS, 2)
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)


def test_lemmas_take_the_place_of_stems(spark):
    forms = spark.createDataFrame([("Льготы", "льгота"), ("льготам", "льгота"), ("инвалидам", "инвалид"), ("Инвалиды", "инвалид"), ("инвалиды", "яблоко"), ("ёлка", "ёлка"), ("", "x"), (None, "y")], "form string, lemma string")
    lemmas = Lemmas.of(forms)
    assert lemmas(["льготам", "инвалиды", "елка", "организациями", "земли"]) == ["льгота", "инвалид", "елка", russian.stem("организациями"), russian.stem("земли")]
    rows = case(60, 2)
    known = {"льготы": "льгота", "льготам": "льгота", "инвалидам": "инвалид", "инвалиды": "инвалид", "елка": "елка"}
    got = terms.cells(spark.createDataFrame(rows, SCHEMA).repartition(3), STOPS, stem=lemmas).collect()
    assert Counter(map(tuple, got)) == brute(rows, lambda w: known.get(w) or russian.stem(w))
    cube = terms.build_cube(spark.createDataFrame(rows, SCHEMA), STOPS, 2022, stem=lemmas)
    assert {"льгота", "инвалид"} <= {r.term for r in cube.select("term").distinct().collect()}
    with pytest.raises(ValueError):
        Lemmas.of(forms, most=2)
    empty = Lemmas.of(forms.where(F.lit(False)))
    assert empty(["льготам"]) == [russian.stem("льготам")]


def test_batches_of_long_texts_are_bounded(spark):
    """What a worker holds does not grow with the rows of a partition."""
    own = spark.newSession()
    session.bind(own)
    sizes = own.range(3_000, numPartitions=1).select(F.repeat(F.lit("льготы "), 600).alias("text")).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    most = sizes.agg(F.max("n")).first()[0]
    assert most < 8 << 20, most


@pytest.mark.parametrize("limit", [terms.FREQUENT, 3])
def test_only_pairs_of_frequent_words_are_exchanged(spark, monkeypatch, limit):
    """The cube is that of all pairs, whether or not pairs of rare words are left out before."""
    monkeypatch.setattr(terms, "FREQUENT", limit)
    rng, rows = random.Random(5), []
    for k in range(300):  # few frequent words, many rare ones
        said = [rng.choice(["льготы", "налога", "земли", "транспорт"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(30)]
        rows.append((rng.choice(["tn", None]), rng.choice(["77", "50", None]), rng.choice(["fl", None]), rng.choice([None, 1999, 2020]), rng.choice([None, 2021]), " ".join(said)))
    texts = spark.createDataFrame(rows, SCHEMA)
    counted = terms.cells(texts, STOPS)
    cube = terms.top_terms(terms.with_all_regions(terms.count_terms(counted, 2022)), 12)
    want = cube.join(terms.display_forms(terms.spread_surfaces(counted, 2022), F.col("n")), "term", "left")
    sent, sums = [], terms._sums
    monkeypatch.setattr(terms, "_sums", lambda rows: (sent.append(rows), sums(rows))[1])
    assert plain(terms.build_cube(texts, STOPS, 2022, top=12)) == plain(want)
    every = terms.norms.explode_years(counted.where("is_bigram = 1"), 2022)
    if limit > 3:
        assert sent[-1].count() < every.count() / 2
    spaced = lambda words: [w.replace("w", "w ") for w in words]
    counted = terms.cells(texts, STOPS, stem=spaced)
    want = terms.top_terms(terms.with_all_regions(terms.count_terms(counted, 2022)), 12)
    assert plain(terms.build_cube(texts, STOPS, 2022, top=12, stem=spaced).withColumn("display", F.lit(""))) == plain(want.withColumn("display", F.lit("")))
