"""Reply-network measures on edge tables. No graph object is ever built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.scores import node_color, node_radius, node_tip


def network_edges(edges: DataFrame) -> DataFrame:
    """(source, target, weight) from either edge naming; blanks and self loops out, repeats summed."""
    have = set(edges.columns)
    if {"author", "parent_author", "weight"} <= have:
        ends = ("author", "parent_author")
    elif {"source", "target", "weight"} <= have:
        ends = ("source", "target")
    else:
        raise ValueError(f"not an edge list: found columns {sorted(have)}")
    number = F.col("weight").cast("string").try_cast("double")
    named = edges.select(
        F.col(ends[0]).cast("string").alias("source"), F.col(ends[1]).cast("string").alias("target"),
        F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)).alias("weight"),
    )
    return (
        named.where("source <> '' and target <> '' and source <> target")
        .groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    )


def heavy_edges(edges: DataFrame, min_weight: float = 2) -> DataFrame:
    return edges.where(F.col("weight") >= min_weight)


def edge_ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends: (account, other, weight, outgoing)."""
    ends = F.explode(F.array(
        F.struct(F.col("source").alias("account"), F.col("target").alias("other"), F.lit(True).alias("outgoing")),
        F.struct(F.col("target").alias("account"), F.col("source").alias("other"), F.lit(False).alias("outgoing")),
    )).alias("e")
    return edges.select(ends, "weight").select("e.account", "e.other", "weight", "e.outgoing")


def node_degree(edges: DataFrame) -> DataFrame:
    """(account, degree, weighted_degree): in and out edges together."""
    return edge_ends(edges).groupBy("account").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree")
    )


def top_degree(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` accounts of highest degree, ties by name."""
    if n <= 0:
        return node_degree(edges).select("account", "degree").where(F.lit(False))
    return node_degree(edges).select("account", "degree").orderBy(F.desc("degree"), "account").limit(n)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select("account")
    return (
        edges.join(names.withColumnRenamed("account", "source"), "source", "left_semi")
        .join(names.withColumnRenamed("account", "target"), "target", "left_semi")
        .select("source", "target", "weight")
    )


def top_degree_subgraph(edges: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among the top accounts; accounts left without edges stay as nodes."""
    nodes = top_degree(edges, n)
    return nodes, induced_edges(edges, nodes)


def select_graph(edges: DataFrame, min_weight: float = 2, max_nodes: int = 80) -> DataFrame:
    """Edges of the page view: weight cut first, then both ends among the top accounts."""
    kept = heavy_edges(network_edges(edges), min_weight)
    return induced_edges(kept, top_degree(kept, max_nodes))


def network_nodes(edges: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(id, degree, r, color, tip) for every account of ``edges``, with or without features."""
    degree = node_degree(edges).select("account", "degree")
    if features is None:
        joined, have = degree, set()
    else:
        have = set(features.columns)
        joined = degree.join(features.withColumnRenamed("author", "account"), "account", "left")
    null = F.lit(None)
    new7 = F.col("new_account_7d") if "new_account_7d" in have else null.cast("boolean")
    score = F.col("coordination_score") if "coordination_score" in have else null.cast("double")
    return joined.select(
        F.col("account").alias("id"), "degree", node_radius(F.col("degree")).cast("int").alias("r"),
        node_color(new7, score).alias("color"),
        node_tip(F.col("account"), F.col("degree"), have).alias("tip"),
    )


def network_links(edges: DataFrame) -> DataFrame:
    """(s, t, w): edges by node position, nodes ordered by degree then name.

    Meant for the output of ``select_graph``: at most ``max_nodes`` accounts, so numbering
    them is one small sorted array.
    """
    ranked = node_degree(edges).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "account"))).alias("nodes")
    ).select(F.posexplode("nodes").alias("at", "node")).select("at", F.col("node.account").alias("account"))
    first = ranked.select(F.col("at").alias("s"), F.col("account").alias("source"))
    second = ranked.select(F.col("at").alias("t"), F.col("account").alias("target"))
    return edges.join(first, "source").join(second, "target").select(
        "s", "t", F.col("weight").cast("double").alias("w")
    )


def ego_neighbors(edges: DataFrame, shown: int = 12) -> DataFrame:
    """The ``shown`` strongest links of every account: (account, rank, other, direction, weight).

    The rank cut-off lets Spark trim a hub's links before the shuffle.
    """
    order = Window.partitionBy("account").orderBy(F.desc("weight"), "other", F.desc("outgoing"))
    direction = F.when(F.col("outgoing"), "replied to").otherwise("replied from")
    return (
        edge_ends(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
        .select("account", "rank", "other", direction.alias("direction"), "weight")
    )
