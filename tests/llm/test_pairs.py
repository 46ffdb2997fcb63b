"""Similarity join and top-k search against brute force."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from murmuration.llm import cover_tree, trie_join

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(d, names.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(names.get(root(i))) if sets[i] else str(d)) for i, (d, _) in enumerate(rows))


def varied(text, seed, changes):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
    return " ".join(w)


def test_components_match_brute_force(docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    chain = prose(50, 120)
    for i in range(25):
        chain = varied(chain, i, 2)
        rows.append((1000 + i, chain))
    base = prose(60, 200)
    rows += [(2000 + i, varied(base, i, i % 9)) for i in range(60)]
    passage = prose(70, 60)
    rows += [(3000 + i, prose(100 + i, 30) + " " + passage + " " + prose(200 + i, 40)) for i in range(50)]
    rows += [(4000 + i, t) for i, t in enumerate(["one two", "ONE  two", "one two three four", "one", "one two three four five", "é É"])]
    got = trie_join.digest(docs([(d, t, "en", "a", 1) for d, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows)


def test_thresholds_at_the_edge():
    for n in range(1, 60):
        for m in range(1, 60):
            for o in (trie_join.needed_overlap(n, m), trie_join.needed_overlap(n, m) - 1):
                assert (100 * o >= 75 * (n + m - o)) == (o >= trie_join.needed_overlap(n, m))


def test_trie_finds_what_brute_force_finds():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(14), rng.randrange(1, 12))), i) for i in range(120)]
    trie = trie_join.Trie.build(rows)
    for _ in range(60):
        probe = frozenset(rng.sample(range(14), rng.randrange(1, 13)))
        want = {(i, len(probe & set(s))) for s, i in rows if 100 * len(probe & set(s)) >= 75 * len(probe | set(s))}
        assert set(trie.similar(probe)) == want


def test_join_odd_input(docs, clashing):
    assert trie_join.digest(clashing).count() == 10 and trie_join.digest(docs([])).count() == 0
    kept = trie_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "None", "None", "3", "4", "5", "6", "7"])


def test_one_of_each_without_or_with_shared_ids(docs):
    one, two, three = prose(91, 150), prose(92, 150), prose(93, 150)
    rows = [(None, one), (None, one), (None, varied(one, 1, 2)), (5, varied(one, 2, 2)), (None, two), (None, two), (7, three), (8, varied(three, 3, 2)), (8, prose(94, 150))]
    kept = trie_join.one_of_each(docs([(d, t, "en", "a", 1) for d, t in rows])).collect()
    want = [rows[3], rows[4], rows[6], rows[8]]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, want))


def test_a_large_group_of_near_copies(docs):
    base = prose(80, 150)
    rows = [(i, varied(base, i, 2 + i % 3)) for i in range(250)]
    got = trie_join.digest(docs([(d, t, "en", "a", 1) for d, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows)


def test_what_travels_is_packed_and_compared_once(docs, monkeypatch):
    """Pairs found unlike in the first pass stay away from the second; a class travels in fewer bytes than its set."""
    travelled, verify = [], trie_join._verify

    def seen(routes, sets, *rest):
        travelled.append(sets.select("cls", F.length(sets.columns[1]).alias("n")).collect())
        return verify(routes, sets, *rest)

    monkeypatch.setattr(trie_join, "_verify", seen)
    rows = []
    for i in range(20):
        base = prose(400 + i, 300)
        # About one word in sixty changed: most shingles are shared, too few for a link.
        rows += [(2 * i, base), (2 * i + 1, varied(base, i, 16))]
    got = trie_join.digest(docs([(d, t, "en", "a", 1) for d, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows)
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert travelled[0] and sum(r["n"] for r in travelled[0]) < 4 * sum(sizes.values())
    assert len(travelled) == 1


def test_packed_texts_give_their_sets_again(monkeypatch):
    texts = [prose(i, 40 + i).encode() for i in range(30)] + [b"one two", "É é\u3000x y z w".encode(), b"\xff\xfe a b c d e f"]
    want = trie_join.shingle_sets(trie_join.pa.array(texts, trie_join.pa.binary()))
    order = trie_join.Order(np.sort(want[0][:5]), np.arange(5)[::-1])
    for chunk in (1 << 20, 100):
        monkeypatch.setattr(trie_join, "CHUNK", chunk)
        got = list(trie_join._unpacked([trie_join.zlib.compress(t) for t in texts], order))
        assert got == [order.sort(x)[::-1].tolist() for x in want]


def test_texts_of_one_of_each_are_shuffled_once(docs):
    kept = trie_join.one_of_each(docs([(i, prose(i, 30), "en", "a", 1) for i in range(20)]).repartition(2))
    assert "hashpartitioning(doc_id" not in kept._jdf.queryExecution().executedPlan().toString()


def test_a_passage_shared_by_many_short_texts(docs):
    passage = prose(71, 60)
    rows = [(i, f"{prose(500 + i, 1 + i % 28)} {passage} {prose(900 + i, i % 5)}") for i in range(300)]
    rows += [(400 + i, passage if i % 2 else f"{passage} {prose(1300 + i, 40)} {passage}") for i in range(6)]
    got = trie_join.digest(docs([(d, t, "en", "a", 1) for d, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == components(rows)


def test_the_first_common_shingle_leaves_room():
    rng = random.Random(9)
    for _ in range(20_000):
        universe = range(rng.randrange(5, 60))
        a = sorted(rng.sample(universe, rng.randrange(1, len(universe))))
        b = sorted(set(a) - {x for x in a if rng.random() < 0.1} | {x for x in universe if rng.random() < 0.05})
        common = set(a) & set(b)
        if b and 100 * len(common) >= 75 * len(set(a) | set(b)):
            i, j = a.index(min(common)), b.index(min(common))
            assert i < trie_join.prefix_length(len(a)) and j < trie_join.prefix_length(len(b))
            assert min(len(a) - i, len(b) - j) >= trie_join.needed_overlap(len(a), len(b))


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.1, 8)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 8) for i in range(200)] + [(950, None), (1000, [float("nan")] * 8), (None, [1.0] * 8), (1050, []), (1100, [1.0, None]),
             (1150, [1.0, 2.0]), (1151, [3.0, 1.0]), (1200, [0.0] * 8), (100, rows[100][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = cover_tree.top_k(frame, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)
    assert cover_tree.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_in_parts_and_pruning():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 200, (10, 16))
    v = np.floor(centres[rng.integers(0, 10, 3000)] + rng.normal(0, 5, (3000, 16)))
    ids = np.arange(3000)
    found = cover_tree.Search(v[::50], ids[::50], v, ids, 5)
    full = v[::50] @ v.T
    full[np.arange(60), ids[::50]] = -np.inf
    for i in range(60):
        want = sorted(zip(-full[i], ids))[:5]
        assert [(-s, j) for s, j in want] == list(zip(found.score[i], found.found[i]))
    assert found.pairs < 0.6 * full.size
