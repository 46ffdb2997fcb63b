"""Prefix trie of conversations by splitter paths and sorted shards.

A conversation is a path: 16 bytes per turn, the digest of role and text. Paths are split into
shards of the order (path, conv_id) at splitters taken from a sample. A node whose members lie in two
shards is a prefix of the splitter between them, so the trie of the splitter paths (the skeleton)
holds every such node. It is broadcast; its size is checked against ``SKELETON`` before.

Each shard is sorted by Spark and read once as a stream: the open nodes are those of the current path,
and a node is finished when a path leaves it. Nodes outside the skeleton are finished there for good.
Nodes of the skeleton give one partial result per shard, which are added up by a grouped reduction;
what depends on the whole node (is it a leaf, what does it save) is added once afterwards.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmuration.llm.common import text_of, words_of
from murmuration.session import shuffle_width, write_stage

FAMILY = 20
HEAD_TURNS = 4
STEP = 16
# Nodes of the broadcast skeleton, turns in a shard, sampled conversations per shard and code points
# of an id list that travel as one piece.
SKELETON = 1 << 17
SHARD_TURNS = 1_000_000
PER_SHARD = 20
PIECE = 1 << 16

ROW = (
    "skeleton int, parent int, shard int, piece int, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string"
)
FIELDS = tuple(part.split()[0] for part in ROW.split(", "))
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_ARROW = pa.schema([
    (part.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[part.split()[1]])
    for part in ROW.split(", ")
])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): one row per rebuilt conversation.

    Turns are put in order by turn (null first); turns of one number by the digest of role and text.
    Missing roles and texts are empty. Rows without a conv_id belong to no conversation. A
    conversation has to fit a row, 16 bytes a turn for the path and 4 for the number of its words; its
    texts stay at home. One shuffle, by the conversation whose head is shared.
    """
    role, text = text_of("role"), text_of("text")
    turn = F.struct(
        F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.size(words_of(text)).alias("words"))
    home = F.col("conv_id") - F.col("conv_id") % FAMILY
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), home.cast("long").alias("home"), turn.alias("t"))
    own = turns.repartition("home").groupBy("home", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("home"), F.slice("own", 1, HEAD_TURNS - 1))).over(Window.partitionBy("home"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    rebuilt = own.select("conv_id", "own", head.alias("head"), shared.alias("h")).select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))
    return rebuilt.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


@dataclass
class Skeleton:
    """Trie of the splitter paths: number of the child behind (node, turn digest), and per node its
    parent, depth and the words of its last turn. The root is node 0."""

    splitters: list[tuple[bytes, int]] = field(default_factory=list)
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes, words: list[int], conv_id: int) -> None:
        self.splitters.append((path, conv_id))
        node = 0
        for i, w in enumerate(words):
            key = (node, path[STEP * i:STEP * i + STEP])
            if key not in self.child:
                self.child[key] = len(self.parent)
                self.parent.append(node)
                self.depth.append(i + 1)
                self.words.append(w)
            node = self.child[key]


def splitter_skeleton(found: DataFrame, shards: int, bound: int = SKELETON) -> Skeleton:
    """At most ``shards - 1`` splitters at even places of a sample, and the trie of their paths.

    Fewer are taken where the paths together would have more than ``bound`` turns, so what reaches the
    driver and the executors is bounded, however long conversations are. The sample (by a hash of
    the id) decides where shards end, nothing else.
    """
    total = found.count()
    part = min(1.0, PER_SHARD * shards / max(total, 1))
    drawn = found.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    order = Window.orderBy("path", "conv_id")
    ranked = write_stage(drawn.withColumn("rank", F.row_number().over(order)).withColumn("turns", F.size("words")), "trie-sample")
    sizes = {r["rank"]: r["turns"] for r in ranked.select("rank", "turns").collect()}
    step = max(len(sizes) / max(shards, 1), 1.0)
    while True:
        ranks = sorted({int(step * i) for i in range(1, int(len(sizes) / step) + 1)} - {0})[:shards - 1]
        if sum(sizes.get(r, 0) for r in ranks) <= bound:
            break
        step *= 2
    skeleton = Skeleton()
    if ranks:
        chosen = ranked.where(F.col("rank").isin(ranks)).orderBy("rank")
        for row in chosen.select("path", "words", "conv_id").collect():
            skeleton.add(bytes(row["path"]), list(row["words"]), row["conv_id"])
    return skeleton


def _shard_of(spark: SparkSession, skeleton: Skeleton) -> Column:
    """Number of splitters at or below (path, conv_id)."""
    if not skeleton.splitters:
        return F.lit(0)
    shared = spark.sparkContext.broadcast(skeleton.splitters)

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, ids in batches:
            yield pd.Series([bisect_right(shared.value, (bytes(p), c)) for p, c in zip(found, ids)], dtype="int32")

    return place("path", "conv_id")


class _Open:
    """A node of the current path, not finished yet."""

    __slots__ = ("number", "depth", "words", "least", "convs", "ends", "children", "leaves", "saved", "digest", "waiting", "pieces", "length")

    def __init__(self, number: int, depth: int, words: int):
        self.number, self.depth, self.words = number, depth, words
        self.least, self.convs, self.ends = None, 0, 0
        self.children, self.leaves, self.saved = 0, 0, 0
        self.digest, self.waiting, self.pieces, self.length = hashlib.sha256(), [], [], 0


class _Shard:
    """Reads one sorted shard and writes rows of ``ROW`` to ``out``."""

    def __init__(self, skeleton: Skeleton, shard: int, out: list[tuple]):
        self.skeleton, self.shard, self.out = skeleton, shard, out
        self.open = [_Open(0, 0, 0)]
        self.path = b""
        self.piece = 0

    def take(self, path: bytes, words: list[int], conv_id: int) -> None:
        depth, old = 0, self.path
        most = min(len(old), len(path)) // STEP
        while depth < most and old[STEP * depth:STEP * depth + STEP] == path[STEP * depth:STEP * depth + STEP]:
            depth += 1
        while len(self.open) > depth + 1:
            self._finish()
        for i in range(depth, len(words)):
            above = self.open[-1].number
            number = self.skeleton.child.get((above, path[STEP * i:STEP * i + STEP]), -1) if above >= 0 else -1
            self.open.append(_Open(number, i + 1, words[i]))
        self.path = path
        self._end(self.open[-1], conv_id)

    def _end(self, node: _Open, conv_id: int) -> None:
        """One more member ends at this node; ids come in ascending order."""
        text = str(conv_id)
        if node.number < 0:
            node.digest.update(f",{text}".encode() if node.ends else text.encode())
        else:
            node.pieces.append(text)
            node.length += len(text) + 1
            if node.length > PIECE:
                self._flush(node)
        node.ends += 1
        node.convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)

    def _flush(self, node: _Open) -> None:
        """Hand on a piece of the id list of a node of the skeleton."""
        if node.pieces:
            self.piece += 1
            self.out.append((node.number, None, self.shard, self.piece, None, None, None, None, None, None, None, ",".join(node.pieces)))
            node.pieces, node.length = [], 0

    def _finish(self) -> None:
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        if node.number >= 0:
            self._flush(node)
            self.out.append((
                node.number, None, self.shard, 0, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, None))
        else:
            if not node.children:
                node.leaves = 1
            node.saved += (node.convs - 1) * node.words
            for depth, least, *counts, ends in node.waiting:
                self.out.append((None, None, self.shard, 0, least, depth, node.least, *counts, ends))
            row = (node.depth, node.least, node.convs, node.children, node.leaves, node.saved, node.digest.hexdigest())
            above.children += 1
            if above.number >= 0:
                self.out.append((None, above.number, self.shard, 0, row[1], row[0], None, *row[2:]))
            else:
                above.waiting.append(row)
        if above is not None:
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = node.least if above.least is None else min(above.least, node.least)

    def close(self) -> None:
        while self.open:
            self._finish()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _walk(shared, rows: int = 4096):
    """Reader of partitions sorted by (shard, path, conv_id)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current = None
        for batch in batches:
            for shard, path, words, conv_id in zip(
                    batch.column("shard").to_pylist(), batch.column("path").to_pylist(),
                    batch.column("words").to_pylist(), batch.column("conv_id").to_pylist()):
                if current is None or current.shard != shard:
                    if current is not None:
                        current.close()
                    current = _Shard(shared.value, shard, out)
                current.take(path, words, conv_id)
                if len(out) >= rows:
                    yield _batch(out)
                    out.clear()
        if current is not None:
            current.close()
        yield _batch(out)

    return walk


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends_sha256) of pieces sorted by (skeleton, shard, piece); holds one piece at a time."""
    node, digest, done = None, None, ([], [])
    for batch in batches:
        for number, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if number != node:
                if node is not None:
                    done[0].append(node)
                    done[1].append(digest.hexdigest())
                node, digest = number, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if node is not None:
        done[0].append(node)
        done[1].append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.string())], ["skeleton", "ends_sha256"])


def _skeleton_rows(partial: list, skeleton: Skeleton) -> list[tuple]:
    """(skeleton, RESULT without the hash) from the reduced partial results, at most ``SKELETON`` of them.

    Shards counted what lies below in nodes of their own. The skeleton's own nodes are added here, from
    the deepest up; a child has a larger number than its parent.
    """
    size = len(skeleton.parent)
    convs, children, leaves, saved, least = (np.zeros(size, np.int64) for _ in range(5))
    for r in partial:
        i = r["skeleton"]
        convs[i], children[i], leaves[i], saved[i], least[i] = r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["conv_id"]
    for i in range(1, size):
        children[skeleton.parent[i]] += 1
    more_leaves = (children == 0).astype(np.int64)
    more_saved = (convs - 1) * np.array(skeleton.words, np.int64)
    for i in range(size - 1, 0, -1):
        more_leaves[skeleton.parent[i]] += more_leaves[i]
        more_saved[skeleton.parent[i]] += more_saved[i]
    return [
        (i, int(least[i]), skeleton.depth[i], int(least[skeleton.parent[i]]) if i else None, int(convs[i]), int(children[i]),
         int(leaves[i] + more_leaves[i]), int(saved[i] + more_saved[i]))
        for i in range(size)
    ]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, shards: int | None = None, bound: int = SKELETON) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, columns ``RESULT``.

    A node is named by its smallest member and its depth. Equal conversations end at one node; groups
    of any size are split over shards by conv_id. ``shards`` defaults to the shuffle width, or more
    where a shard would have over ``shard_turns`` turns. Extra columns are ignored. An empty table
    has no node, not even a root. A task holds the open nodes of one path and the finished children
    of those, at most a shard's nodes; the list of ids that end at a node of the skeleton is hashed
    as a stream of pieces, since SHA-256 has to read it in order.
    """
    spark = conversations.sparkSession
    found = write_stage(paths(conversations.select("conv_id", "turn", "role", "text")), "trie-paths")
    if shards is None:
        turns = found.agg(F.sum(F.size("words"))).first()[0] or 0
        shards = max(shuffle_width(spark), -(-turns // shard_turns))
    skeleton = splitter_skeleton(found, shards, bound)
    shared = spark.sparkContext.broadcast(skeleton)
    placed = found.withColumn("shard", _shard_of(spark, skeleton))
    ordered = placed.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = write_stage(ordered.mapInArrow(_walk(shared), ROW), "trie-nodes")

    own = nodes.where("skeleton IS NOT NULL")
    reduced = own.where("ends IS NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    partial = reduced.collect()
    schema = "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    tops = spark.createDataFrame(_skeleton_rows(partial, skeleton) if partial else [], schema)
    pieces = own.where("ends IS NOT NULL").select("skeleton", "shard", "piece", "ends")
    hashed = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece").mapInArrow(
        _hash_pieces, "skeleton int, ends_sha256 string")
    top = tops.join(hashed, "skeleton", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))

    named = F.broadcast(tops.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("top_conv_id")))
    rest = nodes.where("skeleton IS NULL").join(named, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id")).withColumnRenamed("ends", "ends_sha256")
    return top.select(*RESULT).unionByName(rest.select(*RESULT))


def digest(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


ORACLE = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
), own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, c: xor(a >> 8, crc[(xor(a, c) & 255) + 1])), 4294967295) % {HEAD_TURNS} AS h
  FROM own, tab
), rebuilt AS (
  SELECT d.conv_id, coalesce(o.turns[1:d.h], []) || d.turns[d.h + 1:] AS turns
  FROM drawn d LEFT JOIN own o ON o.conv_id = d.conv_id - d.conv_id % {FAMILY}
), member AS (
  SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), node AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM member GROUP BY depth, turns[1:depth]
), own_part AS (
  SELECT *, (n_convs - 1) * len(list_filter(regexp_split_to_array(path[depth].t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS saved
  FROM node
), above AS (
  SELECT n.depth, n.path, n.saved, NOT EXISTS (SELECT 1 FROM node c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS leaf,
    unnest(range(n.depth + 1)) AS up
  FROM own_part n
), total AS (
  SELECT up AS depth, path[1:up] AS path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(coalesce(saved, 0)) AS saved,
    count(*) FILTER (WHERE depth = up + 1) AS n_children
  FROM (SELECT a.* FROM above a) GROUP BY up, path[1:up]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(t.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN total t ON t.depth = n.depth AND t.path = n.path
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
