"""Operator 11 against the tokenizers themselves, pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from levylens.llm import alignment, common

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "it's we'll", "<|endoftext|> <s> </s> <0x0A> <unk>", "a▁b", "▁", "日本語 テキスト ½", "😀 tab\tline\n\n  x ", "the the the the", "ﬁ é é", " x y", "x" * 300]


def brute(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    from tokenizers.pre_tokenizers import ByteLevel

    letters = sorted(ByteLevel.alphabet())
    shown = [c for c in letters if ord(c) < 256]
    byte = {c: ord(c) for c in shown} | dict(zip(sorted(set(letters) - set(shown)), [b for b in range(256) if chr(b) not in shown]))
    found, docs = [], defaultdict(set)
    for k, text in enumerate(rows):
        said = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = s.encode(text or "")
        ta = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        tb = [bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ta) != said or b"".join(tb) != said:
            found.append(([], [], [], []))
            continue
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(a[i], b[j]) for i, (p, q) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if p < y and x < q]
        cuts = sorted({q for _, q in spans[0]} & {y for _, y in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (p, q) in zip(a, spans[0]) if low <= p and q <= c) + "|" + ",".join(str(j) for j, (x, y) in zip(b, spans[1]) if low <= x and y <= c))
            low = c
        for pair in links:
            docs[pair].add(k)
        found.append((a, b, groups, links))
    best = Counter()
    for (i, _), held in docs.items():
        best[i] = max(best[i], len(held))
    return [
        (k, len(a), len(b), len(g), len(x), sum(len(docs[p]) == best[p[0]] for p in x), sum(len(docs[p]) for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for k, (a, b, g, x) in enumerate(found)
    ]


def texts(n=120, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "Tokenizer", "naïve", "déjà", "x1y2", "don't", "  ", "\n", "Überraschung", "слово", "字", "<s>", "running", "qzxv", "...", "3.14159"]
    return ODD + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("most", [common.SHARED_BYTES, 300])
def test_align_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SHARED_BYTES", most)
    rows = texts()
    rows.append(rows[20])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "'x' AS groups", "1 AS block", "2 AS pair").repartition(3)
    assert sorted(map(tuple, alignment.align(df, A, B).collect())) == brute(rows)


def test_rows_without_id_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, "one two"), (4, "one two"), (4, "one two"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, alignment.align(df, A, B).collect()))
    assert got == sorted((4, *x[1:]) for x in brute(["one two", "one two", None]))
    assert alignment.align(df.where("doc_id > 9"), A, B).count() == 0
    assert [r.n_a for r in alignment.align(df.where("text IS NULL"), A, B).collect()] == [0]


def test_long_texts_are_sliced_without_a_trace():
    b = alignment.SentencePieces(B)
    rng = random.Random(1)
    text = "".join(rng.choices(["word", " ", "  ", "▁", "é", "\n", "longer", "日"], k=40_000))
    assert b.sliced and len(b.slices(text)) > 1
    assert b.encode([text, "a b"]) == [b.model.encode(text), b.model.encode("a b")]


def test_vocabulary_bytes():
    a = alignment.ByteLevel(A)
    assert a.by_piece and a.bytes[:2] == [b"!", b'"'] and len(a.bytes) == 50_257
    assert {bytes([b]) for b in range(256)} <= set(a.bytes)


def test_words_are_encoded_once_a_block(spark, monkeypatch):
    """A block gives each distinct word to the tokenizers once; the result is that of whole texts, whatever parts the words."""
    given, encode = [], alignment.SentencePieces.encode
    monkeypatch.setattr(alignment.SentencePieces, "encode", lambda self, texts: (given.extend(map(len, texts)), encode(self, texts))[1])
    own = alignment.Dictionary(A, B)
    for _ in range(2):
        own.add(common.one_block(*["some words, again and again; " * 50] * 20))
    assert sum(given) < 100, sum(given)
    rng = random.Random(9)
    parts = ["a", "x's", "'ll", "né", "ﬁ", "日", "12", "...", "▁", " ", " ", " ", "  ", "\n", "\t ", "\r\n", " ", "　", "​", " ", "\x00", "\x1c", "́"]
    rows = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    rows += [x.replace("▁", "") for x in rows] + ["kept words ▁ kept words"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    want = brute(rows)
    assert sorted(map(tuple, alignment.align(df, A, B).collect())) == want

    def facts() -> list:
        own = alignment.Dictionary(A, B)
        own.add(common.one_block(*rows))
        return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "groups_sha256")) for r in own.rows[0].to_pylist()]

    assert facts() == [(x[1], x[2], x[3], x[7]) for x in want]
    a, b = alignment.models(A, B)
    monkeypatch.setattr(b, "sliced", False)  # whole texts
    assert facts() == [(x[1], x[2], x[3], x[7]) for x in want]
    monkeypatch.setattr(a, "by_piece", False)
    assert facts() == [(x[1], x[2], x[3], x[7]) for x in want]
