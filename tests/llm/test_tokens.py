"""Operators 1 and 10 against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from levylens.llm import byte_bpe, token_files

ODD = ["", None, " ", "it's we're I'LL 'tis ''s x'd'm!'s 'sx 'rex 'llama 'v", "a  b\t c\n\n d  e f ", "  lead", "trail  ", "\n\nx", "x'", "'", "don't", " 's", "ab12'34 ½ x²", "😀😀 ok’s", "<|endoftext|> <|EndOfText|> The<|endoftext|>THE", "ÀÉ İstanbul ΣΑΣ ﬁ é", "!!!???   ...\r\n", "1234567890", "x" * 700, "日本語 テキスト", "a\x1cb\x85c"]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "A", "é", "7", "٣", "!", "-", " ", "日", "R"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS start")


@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(spark, reference_bpe):
    rows = texts()
    got = {r.doc_id: r for r in byte_bpe.digests(frame(spark, rows), P.path("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(rows):
        ids = reference_bpe.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_round_trip_and_offsets(spark):
    rows, ranks = texts(50), P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encode(frame(spark, rows), ranks)
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(enc, ranks).collect()} == {i: (t or "").encode() for i, t in enumerate(rows)}
    got = {r.doc_id: r for r in enc.collect()}
    assert got[rows.index("don't")].offsets == [0, 3, 5] and got[rows.index("")].offsets == [0]
    for a, b in ((0, 1), (3, 17), (1, 10_000), (9, 9), (700, 701)):
        some = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(enc, ranks, a, b).collect()}
        assert some == {i: (t or "").encode()[a:b] for i, t in enumerate(rows)}


def test_bpe_decodes_by_offsets():
    bpe = byte_bpe.model(P.path("byte_bpe_50k.tiktoken"))
    pieces = [b" one", b"two", b" three"]
    ids = [bpe.merge(p) for p in pieces]
    firsts, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
    assert bpe.decode(flat, np.array([0, 4, 7, 13]), firsts) == b" onetwo three"
    assert bpe.decode(flat, np.array([0, 6, 9, 15]), firsts) == b" one\0\0two three"  # put where the offsets say


def test_bpe_long_piece_merges_alike(reference_bpe):
    bpe = byte_bpe.Bpe(P.path("byte_bpe_50k.tiktoken"))
    for piece in ("ab" * 200, "hello" * 60, "x" * 333):
        assert list(bpe.merge(piece.encode())) == reference_bpe.encode_ordinary(piece)


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows, path = texts(), P.path("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_files.token_files(frame(spark, rows).repartition(3), path, length=64).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)


def test_word_encoder_matches_library_on_plain_and_other_words():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(9)
    tok, enc = Tokenizer.from_file(path), token_files.WordEncoder(path)
    assert enc.plain
    letters = [*"aZé'<|>sß٣7²-.÷×ªµ", "É", "endoftext", "\u212b", "\u212a", "e\u0301", "İ", "ẞ", "Σ", "\xad", "'re", "\n", "\x0b", "\x1c", "\x85", "\xa0", " "]
    words = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(5000)]
    enc.most = 3000  # so that it forgets in between
    got = [x for k in range(0, len(words), 100) for x in enc.encode([w.encode() for w in words[k : k + 100]])]
    assert got == [np.array(tok.encode(w, add_special_tokens=False).ids, enc.dtype).tobytes() for w in words]


def test_token_files_random_access(spark, tmp_path):
    path, folder = P.path("word_bpe_49k.json"), f"file://{tmp_path}"
    rows = ["one two three " * 50, "", "four"]
    manifest = token_files.write_token_files(frame(spark, rows).coalesce(1), folder, path, length=16)
    part = token_files.PartReader(folder, manifest[-1].path)
    ids, mask = part.sequence(0)
    assert len(ids) == 16 == len(mask) and not ids.flags.owndata
    total = sum(r.n_tokens for r in manifest)
    assert total == 150 + 1 + 1 + 2


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).where("doc_id < 0")
    assert token_files.token_files(empty, P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.digests(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_word_hashes_tell_constructed_words_apart():
    from levylens.llm import common

    word = "a"
    for _ in range(10):  # the two Thue-Morse words collide under every polynomial modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert common.word_hash(word) != common.word_hash(other)
    w = common.words(common.one_block("Ab aB " + "x" * 64 + " " + "X" * 64 + " " + "x" * 65, "ab " + "Y" * 300, "y" * 300))
    assert w.hash[0] == w.hash[1] == w.hash[5] and w.hash[2] == w.hash[3] != w.hash[4] and w.hash[6] == w.hash[7]
    assert len({common.word_hash("q" * n) for n in range(1, 200)}) == 199


def test_token_files_of_a_repeated_id_with_a_very_long_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(5, "b " * 60_000), (5, None), (5, "a few words"), (5, "a few words"), (2, "first"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, start = [], 0
    for i, text in sorted((i, x or "") for i, x in rows if i is not None):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_files(df, P.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
