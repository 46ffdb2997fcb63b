"""Apportionment, targets and what is taken."""

import random

import duckdb
import pytest

from murmuration.llm import mixing

from .conftest import prose


def highest_quotients(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        got[max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(2)
    cases = [([rng.randrange(1, 400) for _ in range(rng.randrange(1, 12))], rng.randrange(0, 90)) for _ in range(40)]
    cases += [([5, 5, 5, 5], 6), ([1, 1, 1], 2), ([0, 0], 3), ([7, 0], 4)]
    rows = [(c, f"{i:02d}", float(w), seats) for c, (ws, seats) in enumerate(cases) for i, w in enumerate(ws)]
    frame = spark.createDataFrame(rows, "house int, name string, w double, seats long")
    got = {(r["house"], r["name"]): r["out"] for r in mixing.apportion(frame, ["house"], ["house", "name"], "w", "seats", "out").collect()}
    for c, (ws, seats) in enumerate(cases):
        want = highest_quotients(ws, seats) if sum(ws) else [0] * len(ws)
        assert [got[(c, f"{i:02d}")] for i in range(len(ws))] == want, (ws, seats)


def test_targets_and_takes(docs):
    rng = random.Random(1)
    sizes = {"a": 120, "b": 40, "c": 4, "d": 300, None: 20}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at, prose(at, rng.randrange(1, 200)), "en", source, 1))
            at += 1
    got = mixing.mix_sources(docs(rows)).collect()
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        total = per.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        total[0] += r["size"]
        total[1] += r["taken"]
    assert all(v[0] == v[2] for v in per.values())
    words = sum(v[0] for v in per.values())
    left, free, target = float(words), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), {}
    while True:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * per[s][2]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * per[s][2]
            del free[s]
        left = words - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    for s, v in per.items():
        assert v[3] == pytest.approx(target[s])
        assert v[1] == pytest.approx(v[3], rel=0.03, abs=40)
    again = mixing.mix_sources(docs(rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_odd_rows(spark, docs, odd_rows, clashing):
    got = mixing.digest(clashing).collect()
    assert len(got) == len(odd_rows) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.digest(docs([])).count() == 0
    empty = mixing.digest(docs([(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    con = duckdb.connect()
    con.register("documents", docs(odd_rows).toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).fetchall()
    order = lambda rows: sorted((str(r[0]), *map(float, r[1:])) for r in rows)
    have = order([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got])
    assert [x[:3] + (round(x[3], 6), x[4]) for x in have] == [x[:3] + (round(x[3], 6), x[4]) for x in order(want)]


def test_mixture_repeats_and_leaves_out(docs):
    rows = [(i, prose(i, 100), "en", "a" if i < 10 else "b", 1) for i in range(60)]
    mixed = mixing.mixture(docs(rows))
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert mixed.columns == docs(rows).columns
    assert counts["a"] == 30 and 28 <= counts["b"] <= 32
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3


@pytest.mark.parametrize("equal", [40, 400])
def test_equal_rows_share_their_copies(docs, equal):
    rows = [(None, prose(1, 100), "en", "a", 1)] * equal + [(i, prose(i, 100), "en", "b", 1) for i in range(20)]
    taken = mixing.mix_sources(docs(rows)).collect()
    want = {s: sum(int(r["taken"] / r["size"] + 0.5) for r in taken if r["source"] == s) for s in "ab"}
    got = {r["source"]: r["count"] for r in mixing.mixture(docs(rows)).groupBy("source").count().collect()}
    assert got == want and want["a"] % equal
