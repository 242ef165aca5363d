"""Operator 6 against brute force over all diagonals."""

import itertools
import random
import re

import pytest

from levylens.llm import common
from levylens.llm import decontamination as dc


def brute(doc, item):
    d, b = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower()) for x in (doc, item))
    if len(b) < dc.LEAST:
        return False
    w = min(dc.WINDOW, len(b))
    need = w if len(b) < dc.SPAN else dc.SHARE * w
    return any(sum(d[p + k] == b[q + k] for k in range(w)) >= need - 1e-9 for p in range(len(d) - w + 1) for q in range(len(b) - w + 1))


def case(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    say = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(say(n))) for i, n in enumerate([40, 25, 13, 12, 8, 5, 4, 0, 60, 30])] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        text = say(rng.randint(0, 80))
        if i % 2:
            part = items[rng.randrange(10)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if part:
                    part[rng.randrange(len(part))] = "zzz"
            cut = rng.choice([0, 0, 10])
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in part[cut:]]
        docs.append((i, " ".join(text)))
    return docs + [(200, None), (201, ""), (202, "y " * 30_000 + items[0][1])], items


def test_matches_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_ids")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in dc.overlaps(d, b).collect()}
    assert len(got) == len(docs)
    missed, seen = 0, 0
    for i, text in docs:
        want = {k for k, t in items if brute(text, t)} if i != 202 else {0}
        assert set(got[i].item_ids) <= want and got[i].contaminated == bool(got[i].item_ids)
        seen += len(want)
        missed += len(want - set(got[i].item_ids))
    assert seen > 30 and missed <= 0.02 * seen  # a window with several altered words can miss every mask


@pytest.mark.parametrize("n", [10, 11, 12, 13])
def test_no_placement_of_two_altered_words_hides_a_short_item(n):
    item = [f"w{i}" for i in range(n)]
    table = dc.Table([7], [" ".join(item)])
    for altered in itertools.chain([()], itertools.combinations(range(n), 1), itertools.combinations(range(n), 2)):
        said = " ".join(f"x{i}" if i in altered else w for i, w in enumerate(item))
        assert dc.find(common.one_block(f"before it {said} and after"), table) == [{7: (2, n)}], altered
    three = " ".join("x" if i in (1, 5, 8) else w for i, w in enumerate(item))
    assert dc.find(common.one_block(three), table) == [{}]


def test_several_blocks_give_the_same(spark, monkeypatch):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: sorted(r.item_ids) for r in dc.overlaps(d, b).collect()}
    monkeypatch.setattr(dc, "BLOCK_TOKENS", 50)
    assert {r.doc_id: sorted(r.item_ids) for r in dc.overlaps(d, b).collect()} == whole


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in dc.overlaps(d, b).collect()] == [False]
    assert dc.overlaps(d.where("doc_id = 0"), b).count() == 0


def test_repeated_ids_stay_rows_of_their_own_in_any_number_of_blocks(spark, monkeypatch):
    said = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, said), (1, "clean"), (2, "clean"), (1, said)], "doc_id long, text string")
    b = spark.createDataFrame([(9, said), (9, said + " thirteen"), (4, said), (4, said)], "item_id long, text string")
    want = sorted((r.doc_id, r.contaminated, tuple(r.item_ids), tuple(r.starts), tuple(r.lengths)) for r in dc.overlaps(d, b).collect())
    assert [w[:3] for w in want] == [(1, False, ()), (1, True, (4, 9)), (1, True, (4, 9)), (2, False, ())]
    monkeypatch.setattr(dc, "BLOCK_TOKENS", 10)
    assert sorted((r.doc_id, r.contaminated, tuple(r.item_ids), tuple(r.starts), tuple(r.lengths)) for r in dc.overlaps(d, b).collect()) == want


def test_repetitive_texts_take_memory_of_their_size():
    import resource
    import time

    table = dc.Table([7, 8, 9], ["a " * 2_000, "a b " * 1_000, "a " * 500 + "c " * 500])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert dc.find(common.one_block("x " + "a " * 20_000, "a b " * 9_000, "b " * 5_000), table) == [{7: (0, 2_000), 9: (0, 502)}, {8: (0, 2_000)}, {}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - began < 60


def test_differences_of_many_places(monkeypatch):
    rng = random.Random(3)
    a, b = (dc.np.array(sorted(rng.sample(range(2_000), n))) for n in (300, 170))
    want = sorted({int(x - y) for x in a for y in b})
    assert dc.differences(a, b).tolist() == want
    monkeypatch.setattr(dc, "HITS", 100)
    assert dc.differences(a, b).tolist() == want


def test_few_hits_at_once_give_the_same(spark, monkeypatch):
    docs, items = case(6)
    table = dc.Table(*zip(*[(i, t or "") for i, t in items]))
    block = common.one_block(*[(t or "") + " " + (t or "") for _, t in docs if t is None or len(t) < 10_000])
    whole = dc.find(block, table)
    for few, hits in ((3, 5), (0, 1), (10_000, 2)):
        monkeypatch.setattr(dc, "FEW", few)
        monkeypatch.setattr(dc, "HITS", hits)
        assert dc.find(block, table) == whole


def test_the_first_of_several_longest_overlaps_counts():
    said = "one two three four five six seven eight nine ten eleven twelve"
    table = dc.Table([1], [said])
    assert dc.find(common.one_block(f"x {said} y {said} z {said}"), table) == [{1: (1, 12)}]
    assert dc.find(common.one_block(f"{said[8:]} . {said} and {said}"), table) == [{1: (10, 12)}]


@pytest.mark.parametrize("least,altered", [(5, 0), (3, 0), (3, 1), (2, 1), (1, 0), (6, 2)])
def test_limits_of_short_items_are_parameters(least, altered):
    rules = dc.Rules(least, dc.SHARE, altered)
    rng = random.Random(least)
    items = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in range(1, 10)]
    table = dc.Table(list(range(1, 10)), [" ".join(x) for x in items], rules)
    for n, item in enumerate(items, 1):
        for away in range(n + 1):
            for at in itertools.islice(itertools.combinations(range(n), away), 40):
                got = dc.find(common.one_block("before " + " ".join("zz" if k in at else w for k, w in enumerate(item)) + " after"), table)[0]
                assert (n in got) == (n >= least and n > altered >= away), (n, at)
