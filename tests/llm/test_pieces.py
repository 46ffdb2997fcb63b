"""Pieces: exact agreement with the public library, brute-force Viterbi, round trips."""

import itertools
import random
from array import array

import pytest

from murmuration.llm import pieces

from .conftest import prose

ODD = ["", " ", "  ", "a", "a  b   c    ", "   lead", "Hello  wörld\n☃x 𓀀 <s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\t\n\n  x",
       "llllllllllllllllll    llll", " " * 40 + "x", "ababababab" * 30, "日本語のテキスト", "1234567890 3.14", "x" * 3000, "\r\n", "�"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def numbers(row):
    got = array("i")
    got.frombytes(row)
    return got.tolist()


def test_equals_the_library(model):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    letters = "etaoin shrdlu  ETA,.;'éüß☃\n01"
    texts = ODD + [prose(i, 60) for i in range(20)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    encoder = pieces.Encoder(model)
    got = [numbers(r) for lo in range(0, len(texts), 50) for r in encoder.encode(texts[lo:lo + 50])]
    assert got == processor.encode(texts)
    for text, ids in zip(texts, got):
        assert encoder.decode(ids) == text


def test_unigram_against_all_segmentations():
    rng = random.Random(5)
    names = ["<unk>", "a", "b", "c", "▁", "ab", "bc", "▁a", "abc", "▁ab", "ca"]
    scores = [0.0] + [-rng.random() * 9 - 1 for _ in names[1:]]
    model = pieces.Pieces(pieces.UNIGRAM, names, scores, [2] + [1] * (len(names) - 1))
    encoder = pieces.Encoder(model)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            if all(x in model.ids for x in parts):
                total = sum(scores[model.ids[x]] for x in parts)
                best = max(best, total) if best is not None else total
        got = numbers(encoder.encode([word[1:]])[0]) if len(word) > 1 else []
        if got:
            assert sum(scores[i] for i in got) == pytest.approx(best) and "".join(names[i] for i in got) == word


def test_memory_bounds_do_not_change_results(model, monkeypatch):
    texts = [prose(i, 50) for i in range(40)]
    want = pieces.Encoder(model).encode(texts)
    monkeypatch.setattr(pieces, "MEMORY", 40)
    small = pieces.Encoder(model)
    assert [small.encode([t])[0] for t in texts] == want


def test_documents(spark, docs, clashing, odd_rows, model):
    got = pieces.encode_documents(clashing, model, keep=("doc_id", "ids", "key"))
    assert got.columns == ["doc_id", "key", "ids", "n_pieces", "round_trip"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(len(r["ids"]) == r["n_pieces"] for r in rows) and all(r["round_trip"] for r in rows)
    back = pieces.decode_documents(got, model).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r[0]), r[1] or "") for r in odd_rows)
    assert pieces.digest(docs([])).count() == 0
    assert not pieces.encode_documents(docs([(1, "a▁b", "en", "a", 1)]), model).first()["round_trip"]
    odd = spark.createDataFrame([(1, None), (2, [None, 9_999_999, 100])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: type(r["text"]) for r in pieces.decode_documents(odd, model).collect()} == {1: str, 2: str}
