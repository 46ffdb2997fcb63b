import random
from collections import Counter
from itertools import combinations

import pytest

from murmuration.operators import components as C
from murmuration.operators import edges, graph


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reply_edges_match_direct_lookup(activity):
    rng = random.Random(7)
    names = ["ida", "jon", "kit", "lev"]
    rows = [(f"m{i}", rng.choice(names), rng.choice(["post", "comment", "comment"]),
             rng.choice([None, "t3_m1", "t1_gone"] + [f"t1_m{rng.randrange(60)}", f"m{rng.randrange(60)}"] * 3)) for i in range(60)]
    rows += [("m7", "zed", "comment", "t1_m8")]
    owner = {}
    for i, a, _, _ in rows:
        owner[i] = max(a, owner.get(i, a))
    want = Counter()
    for _, a, kind, parent in rows:
        target = owner.get(parent.removeprefix("t1_")) if parent else None
        if kind == "comment" and target is not None and target != a:
            want[(a, target)] += 1
    frame = activity(*[{"id": i, "author": a, "kind": k, "parent_id": p} for i, a, k, p in rows])
    assert {(r["author"], r["parent_author"]): r["weight"] for r in edges.reply_edges(frame).collect()} == want
    nothing = edges.reply_edges(frame.where("kind = 'post'"))
    assert nothing.columns == ["author", "parent_author", "weight"] and nothing.count() == 0


def threads(seed, sizes):
    rng = random.Random(seed)
    members = [(f"w{rng.randrange(500):03d}", f"t3_{k}") for k, n in enumerate(sizes) for _ in range(n)]
    return members + [("[deleted]", "t3_0"), ("w000", None)]


@pytest.mark.parametrize("limit", [80, 5, None])
def test_shared_threads_match_direct_pairs(activity, monkeypatch, limit):
    monkeypatch.setattr(edges, "BLOCK", 7)
    rows = threads(1, [1, 2, 3, 6, 20, 40, 140])
    at_cap = [(f"cap{i:02d}", "t3_cap") for i in range(80)] + [(f"over{i:02d}", "t3_over") for i in range(81)]
    rows += at_cap
    groups = {}
    for a, t in rows:
        if t is not None and a != "[deleted]":
            groups.setdefault(t, set()).add(a)
    want = Counter(p for g in groups.values() if limit is None or len(g) <= limit for p in combinations(sorted(g), 2))
    frame = activity(*[{"author": a, "link_id": t} for a, t in rows])
    assert {(r["source"], r["target"]): r["weight"] for r in edges.shared_thread_edges(frame, limit).collect()} == want
    skipped = {r["link_id"]: r["authors"] for r in edges.skipped_threads(frame, limit).collect()}
    assert skipped == {t: len(g) for t, g in groups.items() if limit is not None and len(g) > limit}


@pytest.mark.parametrize("limit,weight", [(80, 2), (5, 3), (None, 2)])
def test_pruned_threads_keep_every_heavy_edge(activity, monkeypatch, limit, weight):
    monkeypatch.setattr(edges, "BLOCK", 7)
    rng = random.Random(3)
    # Regulars of a few threads among many accounts that are seen once.
    rows = [(f"w{rng.randrange(40):03d}", f"t3_{k}") for k in range(12) for _ in range(1 + k % 7)]
    rows += [(f"once{k}_{i}", f"t3_{k}") for k in range(0, 12, 2) for i in range(20)] + threads(2, [1, 3])
    rows += [(f"pair{i}", f"t3_p{k}") for i in range(2) for k in range(3)]
    frame = activity(*[{"author": a, "link_id": t} for a, t in rows])
    plain = [r for r in edges.shared_thread_edges(frame, limit).collect() if r["weight"] >= weight]
    got = edges.shared_thread_edges(frame, limit, weight).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and plain
    members, left = edges.paired_members(frame, limit), edges.paired_members(frame, limit, weight)
    assert left.count() < members.count() / 2
    assert not left.where("author LIKE 'once%'").count()


def test_temporal_edges_match_direct_comparison(activity, at, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 6)
    chance = random.Random(11)
    # More than 80 authors in one thread, many of them within one window.
    rows = [(f"v{i:03d}", "crowd", chance.choice([0, 300, 899, 900, 1500, 5000])) for i in range(120)]
    rows += [(f"u{chance.randint(0, 6)}", f"t{chance.randint(0, 3)}", chance.randint(0, 9000)) for _ in range(60)]
    rows += [("x", "edge", 0), ("y", "edge", 900), ("x", "far", 0), ("y", "far", 901)]
    frame = activity(*[{"author": a, "link_id": t, "created_dt": at(s)} for a, t, s in rows])
    met = {(min(a, b), max(a, b), t) for a, t, s in rows for b, t2, s2 in rows if a != b and t == t2 and abs(s - s2) <= 900}
    want = {}
    for a, b, _ in met:
        want[(a, b)] = want.get((a, b), 0) + 1
    got = {(r["source"], r["target"]): r["weight"] for r in edges.temporal_edges(frame, 15).collect()}
    assert got == want


def edge_frame(spark, *rows):
    return spark.createDataFrame(rows, "author string, parent_author string, weight long")


def random_edges(seed, n):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(12):02d}", f"k{rng.randrange(12):02d}", rng.randrange(1, 5)) for _ in range(n)]


def test_graph_matches_direct_sums(spark):
    rows = random_edges(4, 80)
    total = Counter()
    for a, b, w in rows:
        if a != b:
            total[(a, b)] += w
    frame = graph.network_edges(edge_frame(spark, *rows))
    assert {(r["source"], r["target"]): r["weight"] for r in frame.collect()} == total
    heavy = {k: w for k, w in total.items() if w >= 4}
    assert {(r["source"], r["target"]): r["weight"] for r in graph.heavy_edges(frame, 4).collect()} == heavy
    ends = Counter(x for pair in heavy for x in pair)
    top = sorted(ends, key=lambda x: (-ends[x], x))[:5]
    chosen = graph.select_graph(edge_frame(spark, *rows), 4, 5)
    assert {(r["source"], r["target"]) for r in chosen.collect()} == {(a, b) for a, b in heavy if a in top and b in top}
    assert graph.select_graph(edge_frame(spark, *rows), 4, 0).count() == 0
    nodes, inside = graph.top_degree_subgraph(graph.heavy_edges(frame, 4), 5)
    assert sorted(r["account"] for r in nodes.collect()) == sorted(top) and inside.count() == chosen.count()


def test_network_edges_refuse_unknown_columns_and_bad_weights(spark):
    frame = spark.createDataFrame([("k1", "k2", "0.5"), ("k1", "k2", "many"), ("k1", "k2", "3"), ("k2", "k2", "1"), (None, "k2", "1")],
                                  "source string, target string, weight string")
    assert pairs(graph.network_edges(frame), "source", "target", "weight") == [("k1", "k2", 3.5)]
    with pytest.raises(ValueError):
        graph.network_edges(frame.drop("weight"))


def test_nodes_links_and_ego_match_direct_view(spark):
    rows = random_edges(9, 30)
    frame = graph.network_edges(edge_frame(spark, *rows))
    links = {(r["source"], r["target"]): r["weight"] for r in frame.collect()}
    degree = Counter(x for pair in links for x in pair)
    feat = {n: (i % 2 == 0, 10 + i, i / 10) for i, n in enumerate(sorted(degree))}
    table = spark.createDataFrame([(n, *f) for n, f in feat.items()][1:], "author string, new_account_7d boolean, activity_count long, coordination_score double")
    nodes = {r["id"]: r for r in graph.network_nodes(frame, table).collect()}
    unknown = sorted(degree)[0]
    for n, d in degree.items():
        young, count, score = feat[n] if n != unknown else (False, None, 0)
        color = "#d85a30" if young else "#e0a106" if score >= 0.5 else "#3d6f8f"
        assert (nodes[n]["degree"], nodes[n]["r"], nodes[n]["color"]) == (d, min(22, 6 + d), color)
        lines = nodes[n]["tip"].split("\n")
        assert lines[0] == n and str(d) in lines[1] and len(lines) == (2 if n == unknown else 5)
    place = {n: i for i, n in enumerate(sorted(degree, key=lambda x: (-degree[x], x)))}
    assert pairs(graph.network_links(frame), "s", "t", "w") == sorted((place[a], place[b], w) for (a, b), w in links.items())
    ends = [(a, b, 0, w) for (a, b), w in links.items()] + [(b, a, 1, w) for (a, b), w in links.items()]
    got = {}
    for r in graph.ego_neighbors(frame, 3).orderBy("account", "rank").collect():
        got.setdefault(r["account"], []).append((r["other"], r["direction"].split()[-1], r["weight"]))
    assert got == {n: [(o, ("to", "from")[back], w) for _, o, back, w in sorted((e for e in ends if e[0] == n), key=lambda e: (-e[3], e[1], e[2]))[:3]] for n in degree}


def test_components_match_direct_search(spark):
    chance = random.Random(2)
    links = {(f"n{chance.randint(0, 60)}", f"n{chance.randint(0, 60)}") for _ in range(40)}
    links |= {(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)} | {("hub", f"s{i}") for i in range(30)}
    links = {(a, b) for a, b in links if a != b}
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    frame = spark.createDataFrame(sorted(links), "source string, target string")
    alone = spark.createDataFrame([("solo",)], "account string")
    got = {r["account"]: r["component"] for r in C.connected_components(frame, alone).collect()}
    assert got == {**{n: find(n) for n in root}, "solo": "solo"}


@pytest.mark.parametrize("rounds", [5, None])
def test_communities_follow_the_heavy_links(spark, rounds):
    groups = [["d1", "d2", "d3", "d4"], ["e1", "e2", "e3"], ["f1", "f2", "f3", "f4", "f5"]]
    rows = [(a, b, 9) for g in groups for a, b in combinations(g, 2)] + [("d4", "e1", 1), ("e3", "f1", 1)]
    frame = spark.createDataFrame(rows, "source string, target string, weight long")
    got = {r["account"]: r["community"] for r in C.communities(frame, rounds).collect()}
    assert [len({got[n] for n in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 3


def test_similar_text_edges(spark):
    frame = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.95), ("a", "c", 0.88)], "author_a string, author_b string, similarity double")
    assert pairs(edges.similar_text_edges(frame), "source", "target", "weight", "max_similarity") == [("a", "b", 2, 0.95), ("a", "c", 1, 0.88)]
