"""Trie of conversations against a plain version that holds all nodes in a dictionary."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from murmuration.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_version(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn, role or "", text or ""))

    def order(t):
        key = hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
        return (t[0] is not None, t[0] or 0, key)

    own = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        home = c - int(c - 20 * int(c / 20))
        path = tuple(own.get(home, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[q] for q in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    return sorted(repr((
        min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p in members)


def found(df):
    assert df.columns == list(T.RESULT)
    return sorted(repr(tuple(r)) for r in df.collect())


def talks(n, seed=1, stock=4, longest=9):
    """Conversations over a small stock of turns, so that paths branch at every depth; a third are copies."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "the very same start"), ("assistant", "and the very same answer to it"), ("user", "bye")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "yes", "one two  three\t four", "é 𓀀"][:stock + 1]))
                     for _ in range(rng.randrange(1, longest))]
        rows += [(c * 7 % n, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "nobody's turn"), (-3, 0, "user", "before zero"), (-41, 2, "user", "b"), (-41, None, "user", "a"),
    (-41, 1, None, None), (-40, 1, "user", "base of the negative ones"), (-40, 2, "", ""), (1005, 0, "user", "single"),
    (5, 100, "user", "same number"), (5, 100, "assistant", "same number"), (5, 100, "assistant", "same number"),
    (2001, 1, "user", "word " * 30_000), (2001, 2, "user", "word " * 30_000), (2**62, 0, "user", "far"),
    (3001, 1, "us", "er"), (3002, 1, "use", "r"), (3003, 1, "", "user"), (3021, 1, "", ""), (3041, None, None, None),
]


@pytest.mark.parametrize("shards, bound", [(1, 1 << 17), (7, 1 << 17), (40, 1 << 17), (40, 12), (40, 0)])
def test_same_as_a_dictionary_of_nodes(spark, shards, bound):
    rows = ODD + talks(240)
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=shards, bound=bound)
    assert found(got) == plain_version(rows)


def test_skeleton_is_bounded_and_holds_what_shards_share(spark):
    frame = T.paths(spark.createDataFrame(talks(300, seed=4), SCHEMA))
    for bound in (0, 5, 40, 1 << 17):
        skeleton = T.splitter_skeleton(frame, 16, bound)
        assert len(skeleton.parent) <= bound + 1
        assert skeleton.splitters == sorted(skeleton.splitters)
    cut = [p for p, _ in skeleton.splitters] + [b"\xff"]
    shards = defaultdict(set)
    for r in frame.collect():
        at = sum((bytes(r["path"]), r["conv_id"]) >= s for s in skeleton.splitters)
        for d in range(len(r["words"]) + 1):
            shards[bytes(r["path"])[:16 * d]].add(at)
    assert all(any(c.startswith(p) for c in cut) for p, at in shards.items() if len(at) > 1)
    assert sum(len(at) > 1 for at in shards.values()) > 3


def test_one_conversation_copied_by_many_and_one_very_long(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 64)
    rows = [(c, t, "user", f"turn number {t}") for c in range(2000) for t in range(2 + (c % 500 == 0))]
    rows += [(77_777, t, "user", f"long talk {t % 5}") for t in range(3000)]
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=12)
    assert found(got) == plain_version(rows)


def test_repeated_rows_and_a_deep_chain_of_prefixes(spark):
    rows = [(20 * d, t, "a", f"step {t}") for d in range(40) for t in range(d)] * 2
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=6)
    assert found(got) == plain_version(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.digest(empty).collect() == []
    assert T.digest(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = ODD + talks(30)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS home", "'x' AS path", "2 AS words", "3 AS shard", "4 AS depth", "'y' AS skeleton", "5 AS own")
    assert found(T.digest(wide)) == plain_version(rows)
