"""Every stage of the pipeline on its own input against a plain version."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P

from .conftest import prose
from .test_pairs import components, varied
from .test_rules import measured


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, at = [], 0
    for k in range(60):
        text = "the of and " + prose(k, 60 + k)
        rows.append((text, "en", "a" if k % 3 else "b"))
        if k % 5 == 0:
            rows += [(varied(text, k, 1), "en", "c"), (text, "en", "a")]
    rows += [("too short", "en", "a"), (None, None, None), ("", "en", "b"), ("### " * 80, "en", "b")]
    rows += [("the of and " + prose(99, 70) + " password=abcdefgh123456789", "en", None)]
    frame = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, (t, lang, s) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    folder = tmp_path_factory.mktemp("corpus")
    frame.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    held = {}
    for number, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(P.STAGES) - 1:
            assert tuple(docs.columns) == P.COLUMNS
        held[name] = (before, docs.collect())
    before, after = held["quality rules"]
    kept = {r["doc_id"] for r in after}
    for r in before:
        n, _, _, _, repeats = measured(r["text"])
        assert not (r["doc_id"] in kept and (n < 50 or 100 * repeats > 50 * n))
        if r["text"] and n >= 50 and "###" not in r["text"]:
            assert r["doc_id"] in kept
    before, after = held["n-gram Jaccard join"]
    first = {name for _, _, name in components([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(str(r["doc_id"]) for r in after) == sorted(first)
    before, after = held["secret scans"]
    assert len(before) == len(after) and not any(re.search("password=abcdef", r["text"]) for r in after)
    assert Counter(r["text"] for r in before if "password=" not in r["text"]) <= Counter(r["text"] for r in after)
    before, after = held["mixing sources to target weights"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    before, after = held["SentencePiece encoding and decoding"]
    assert len(before) == len(after) and all(r["round_trip"] for r in after)


def test_run(spark, corpus):
    rows = P.run(spark, corpus).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "source", "ids", "n_pieces", "round_trip"}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_input(spark, odd_rows, tmp_path):
    """Nulls in every column, repeated rows, shared and missing ids, a very long text, other columns."""
    rows = odd_rows + [(i % 7 or None, f"the of and {prose(300 + i % 9, 90)}", None if i % 2 else "en", None if i % 3 else "a", None) for i in range(40)]
    rows += [(50, "the of and " + prose(77, 60_000), "en", "a", 1), (51, "the of and token=ABCDEFGHIJKL0123 " + prose(78, 70), "fr", "b", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.selectExpr("*", "1 AS kept", "'x' AS spans", "2 AS taken", "3 AS `_mm_key`").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen.append(docs.collect())
    good, single, safe, mixed, ids = seen
    counts = {t: measured(t) for _, t, *_ in rows}
    assert Counter(r["text"] for r in good) == Counter(
        t for _, t, *_ in rows if counts[t][0] >= 50 and 100 * counts[t][4] <= 50 * counts[t][0])
    assert len({r["text"] for r in good}) == len(single) == len({r["text"] for r in single}) == len(safe)
    assert not any("ABCDEFGHIJKL0123" in r["text"] for r in safe)
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in safe}
    assert len(ids) == len(mixed) and all(r["round_trip"] for r in ids)
