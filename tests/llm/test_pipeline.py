"""The pipeline's stages against brute force, and whole on planted documents."""

import base64
import random

import public_tokenizers as P
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(3000)]
    say = lambda n: rng.choices(vocab, k=n)
    texts, labels = [], []
    for i in range(400):
        t = say(80)
        if i % 5 == 0:
            for w in ("zorgle", "wexxim", "qualdor", "zorgle"):
                t.insert(rng.randrange(60), w)
        texts.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    copy, item, passage = texts[1][1], " ".join(say(30)), " ".join(say(60))
    near = copy.split()
    near[40] = "altered"
    texts += [(1000, copy), (1001, " ".join(near)), (1002, " ".join(say(40)) + " " + item + " " + " ".join(say(20)))]
    texts += [(1003, " ".join(say(40)) + " " + passage), (1004, passage + " " + " ".join(say(40))), (1005, None), (1006, "")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_run(spark, planted):
    import tiktoken

    folder, texts, passage = planted
    got = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    clean = {i for i, _ in texts if i < 400 and i % 5}
    assert clean | {1003, 1004, 1005, 1006} == set(got) & (clean | set(range(1000, 1010)))
    assert len(set(got) & {i for i in range(0, 400, 5)}) <= 4
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(texts)
    cut = enc.decode(got[1003].ids)  # less the passage, and up to a window's bytes around it that the copies share
    assert passage not in cut and passage[:150] not in cut and passage[-150:] not in cut
    assert len(text[1003]) - len(passage) - 40 <= len(cut) <= len(text[1003]) - len(passage) + 1
    assert enc.decode(got[7].ids) == text[7] and got[1005].n_tokens == 0


def test_stages_keep_columns_and_clean_rows(spark, planted):
    folder, _, _ = planted
    odd = spark.createDataFrame([(None, "text without a name", None, None, None), (5, None, None, "s", 0), (6, "", "en", None, None), (7, "a few words", "en", "s", None), (7, "a few words", "en", "s", None)], SCHEMA).withColumn("row", odd_lit())
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns
        assert {r.doc_id for r in out.collect()} == {None, 5, 6, 7}
        assert stage(spark, odd.where("doc_id = 99"), folder).count() == 0


def odd_lit():
    from pyspark.sql import functions as F

    return F.lit("clashing name")
