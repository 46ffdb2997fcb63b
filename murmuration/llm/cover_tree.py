"""Exact top-k inner products by a dual-tree search over cover trees.

Candidates are dealt into blocks of bounded size, queries likewise; every pair of a query block
and a candidate block is one task group, which indexes both sides in cover trees and searches
them together. A pair of nodes is left when no member of one can beat the worst kth score of the
queries in the other, by the bound on inner products from the centres and covering radii.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.session import write_stage

CANDIDATES = 4096
QUERIES = 1024
LEAF = 48
SCHEMA = "query_id long, vec_id long, score long"


class Node:
    """Points of a ball: centre, covering radius, and children or, in a leaf, the points."""

    __slots__ = ("centre", "radius", "points", "below", "centres", "radii", "norms", "norm")

    def __init__(self, vectors: np.ndarray, points: np.ndarray, centre: int, level: float):
        self.centre, self.points, self.below = vectors[centre], points, []
        self.norm = float(np.linalg.norm(self.centre))
        away = np.linalg.norm(vectors[points] - self.centre, axis=1)
        self.radius = float(away.max(initial=0.0)) * (1 + 1e-9)
        if len(points) <= LEAF or self.radius == 0:
            return
        # Children cover the points at half the radius, each from a centre no other child covers.
        reach = min(level, self.radius) / 2
        left, taken = points, away
        head = centre
        while len(left):
            near = taken <= reach
            self.below.append(Node(vectors, left[near], head, reach))
            left = left[~near]
            if len(left):
                head = int(left[0])
                taken = np.linalg.norm(vectors[left] - vectors[head], axis=1)
        self.centres = np.stack([c.centre for c in self.below])
        self.radii = np.array([c.radius for c in self.below])
        self.norms = np.array([c.norm for c in self.below])


def _tree(vectors: np.ndarray) -> Node:
    return Node(vectors, np.arange(len(vectors)), 0, np.inf)


class Search:
    """k best (score, smallest id first) of every query among the candidates of one block."""

    def __init__(self, queries, query_ids, candidates, ids, k: int):
        self.q, self.qid, self.c, self.ids, self.k = queries, query_ids, candidates, ids, k
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pairs = 0
        self._visit(_tree(queries), _tree(candidates))

    def _compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        s = self.q[rows] @ self.c[columns].T
        self.pairs += s.size
        s[self.qid[rows][:, None] == self.ids[columns][None, :]] = -np.inf
        useful = (s >= self.score[rows, -1][:, None]).any(axis=0) & np.isfinite(s).any(axis=0)
        if not useful.any():
            return
        s, columns = s[:, useful], columns[useful]
        both = np.concatenate([self.score[rows], s], axis=1)
        names = np.concatenate([self.found[rows], np.broadcast_to(self.ids[columns], s.shape)], axis=1)
        names = np.where(np.isfinite(both), names, np.iinfo(np.int64).max)
        best = np.lexsort((names, -both), axis=1)[:, :self.k]
        self.score[rows] = np.take_along_axis(both, best, axis=1)
        self.found[rows] = np.take_along_axis(names, best, axis=1)

    def _visit(self, a: Node, b: Node) -> None:
        if a.below and (not b.below or a.radius > b.radius):
            for child in a.below:
                self._visit(child, b)
            return
        if not b.below:
            self._compare(a.points, b.points)
            return
        most = b.centres @ a.centre + a.radius * b.norms + b.radii * (a.norm + a.radius)
        most += 1e-9 * np.abs(most) + 1e-6
        leaf = np.array([not c.below for c in b.below])
        # Leaves that can still matter are compared at once, then inner nodes, most promising first.
        near = leaf & (most >= self.score[a.points, -1].min())
        if near.any():
            columns = np.concatenate([b.below[i].points for i in np.flatnonzero(near)])
            if a.below:
                for child in a.below:
                    self._compare(child.points, columns)
            else:
                self._compare(a.points, columns)
        for i in np.flatnonzero(~leaf)[np.argsort(-most[~leaf], kind="stable")]:
            if most[i] >= self.score[a.points, -1].min():
                self._visit(a, b.below[i])


def searched(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries, candidates):
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = np.stack(queries["v"].to_list()), np.stack(candidates["v"].to_list())
        qid, ids = queries["vec_id"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64)
        found = Search(q.astype(np.float64), qid, c.astype(np.float64), ids, k)
        rows, places = np.nonzero(np.isfinite(found.score))
        return pd.DataFrame({
            "query_id": qid[rows], "vec_id": found.found[rows, places], "score": found.score[rows, places].astype(np.int64)})

    return run


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(256 x); vectors null or with a null or non-finite component go."""
    x = F.col(column)
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(
        "vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller vec_id.

    A row is its vec_id and its vector: rows repeated in full count once, and rows that share the
    query's vec_id are its own. Vectors without components or with a null vec_id take no part;
    vectors meet those of their own length. Scores are exact while they stay below 2**53.
    """
    rows = write_stage(quantised(vectors, column).distinct().withColumn("dim", F.size("v")), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    spot = lambda seed, size: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = queries.select("vec_id", "v", "dim", spot(1, query_blocks).alias("qb"), every(blocks).alias("cb"))
    right = rows.select("vec_id", "v", "dim", every(query_blocks).alias("qb"), spot(2, blocks).alias("cb"))
    key = ("dim", "qb", "cb")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(searched(k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
