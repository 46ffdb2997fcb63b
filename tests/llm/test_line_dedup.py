"""Line dedup against a plain version over all lines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from murmuration.llm import line_dedup as L

from .conftest import prose

SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plain_version(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) of every row; rows are (doc_id, text, ...)."""
    last = float("inf")
    order = lambda i: last if i is None else i
    first = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= least:
                first[k] = min(first.get(k, last), order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key_of(x), order(doc_id)) == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shared_lines(n, seed=5):
    """Documents over a small stock of lines, in changing case and blanks, with one line in all of them."""
    rng = random.Random(seed)
    stock = [prose(i, 6) for i in range(60)] + ["short", "1234567890", "123456789", "ÄÖÜäöüßéèà", "äöüÄÖÜSSÉÈÀ", "", " \t"]
    rows = []
    for i in range(n):
        lines = [rng.choice(stock) for _ in range(rng.choice([1, 3, 20, 200]))]
        lines = [rng.choice([x, x.upper(), f"  {x}\t", x + "\r"]) for x in lines] + ["Seen in every document"]
        rows.append((i * 3 % n, "\n".join(lines), "en", "hot" if i % 3 else "b", 1))
    return rows


@pytest.mark.parametrize("heavy", [1000, 1])
def test_same_as_going_over_all_lines(docs, odd_rows, heavy):
    rows = odd_rows + shared_lines(200) + [(None, "Seen in every document\nonly here it stands\r", None, None, None)]
    got = L.line_dedup(docs(rows), heavy=heavy)
    got = got.withColumn("left", L.kept_text(F.coalesce("text", F.lit("")), F.col("keep")))
    found = sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["left"])) for r in got.collect())
    assert found == sorted(map(repr, plain_version(rows)))


def test_query_columns_and_hashes(docs, odd_rows):
    rows = odd_rows + shared_lines(40)
    got = L.digest(docs(rows))
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_version(rows)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_bitmaps_list_only_words_that_lose_lines(docs):
    long = "\n".join(f"line number {i} of the first text" for i in range(1000))
    other = "\n".join(f"line number {i} of the second text" if i != 700 else "line number 64 of the first text" for i in range(1000))
    got = {r["doc_id"]: r["keep"] for r in L.line_dedup(docs([(1, long, "en", "a", 1), (2, other, "en", "a", 1)])).collect()}
    assert got[1] is None
    assert [(w["word"], ~w["bits"]) for w in got[2]] == [(700 // 64, 1 << 700 % 64)]


def test_many_lines_and_rows_without_ids(docs):
    line = "the same sentence again"
    rows = [(1, "\n".join([line] * 20_000), "en", "a", 1), (2, "\n".join([line, "a line of its own"] * 20_000), "en", "a", 1)]
    rows += [(None, f"{line}\nleft by documents without ids", None, None, None)] * 300
    got = sorted(repr(tuple(r)) for r in L.digest(docs(rows)).collect())
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_version(rows)]
    assert got == sorted(map(repr, want))


def test_runs_are_streamed_from_range_partitions(spark, docs):
    plan = L.dropped_lines(L.line_hashes(docs(shared_lines(20))))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "Window" in plan
    assert "hashpartitioning(h1" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_clashing_columns(docs, clashing):
    assert L.digest(docs([])).collect() == []
    wide = clashing.selectExpr("*", "1 AS first", "2 AS pos", "3 AS h1", "'x' AS line", "4 AS n_lines", "5 AS keep")
    got = L.line_dedup(wide)
    assert len(got.columns) == len(set(got.columns)) and got.count() == wide.count()
