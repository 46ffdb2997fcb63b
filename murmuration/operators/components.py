"""Iterative graph labels: connected components and communities.

Each round is one or two joins written to the shared folder, which cuts the lineage and lets
the work survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.edges import tasks_for
from murmuration.session import write_stage

MAX_ROUNDS = 100


def _hang_on(links: DataFrame, key: str, child: str) -> DataFrame:
    """Join every link to the smallest neighbour of its ``key`` end (hubs: one row to join)."""
    smallest = links.groupBy(F.col(key).alias("_k")).agg(F.min(child).alias("_least"))
    return links.join(smallest, F.col(key) == F.col("_k")).drop("_k")


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    hung = _hang_on(both.select(F.col("hi").alias("u"), F.col("lo").alias("v")), "u", "v")
    return hung.where("v > u").select(
        F.col("v").alias("hi"), F.least("u", "_least").alias("lo")
    ).where("hi <> lo").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    hung = _hang_on(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")), "u", "v")
    pairs = F.array(
        F.struct(F.col("v").alias("hi"), F.col("_least").alias("lo")),
        F.struct(F.col("u").alias("hi"), F.col("_least").alias("lo")),
    )
    return hung.select(F.explode(pairs).alias("p")).select("p.hi", "p.lo").where("hi <> lo").distinct()


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(account, component): undirected components, named by their smallest account.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): links are replaced by
    links to smaller nodes until every node hangs on its root, in about log(n) rounds. A run
    that does not settle raises instead of returning half-merged labels.
    """
    links = edges.where("source <> target").select(
        F.greatest("source", "target").alias("hi"), F.least("source", "target").alias("lo")
    ).distinct()
    links = write_stage(links, "links")
    everyone = links.select(F.explode(F.array("hi", "lo")).alias("account"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("account"))
    before = _fingerprint(links)
    for _ in range(MAX_ROUNDS):
        links = write_stage(_small_star(_large_star(links)), "links")
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("hi").alias("account"), F.col("lo").alias("component"))
    return everyone.distinct().join(roots, "account", "left").select(
        "account", F.coalesce("component", "account").alias("component")
    )


def communities(edges: DataFrame, rounds: int | None = 5) -> DataFrame:
    """(account, community): weighted label propagation.

    ``rounds`` is the number of rounds; ``None`` goes on until no label changes, or until labels
    only swap back and forth, for ``MAX_ROUNDS`` at most.

    Every account starts as its own label and then takes, at the same time as all others, the
    label of greatest summed edge weight among its neighbours; ties go to the smallest label.
    """
    # Written, so that their number is known: tasks that sum and count them hold a bounded part.
    both = write_stage(edges.where("source <> target").select("source", "target", "weight"), "edges")
    tasks = tasks_for(edges.sparkSession, 2 * both.count())
    links = write_stage(
        both.unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
        .repartition(tasks, "source", "target").groupBy("source", "target").agg(F.sum("weight").alias("weight")),
        "neighbours",
    )
    labels = links.select(F.col("source").alias("account")).distinct().withColumn("community", F.col("account"))
    prints: list[tuple] = []
    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        seen = labels.select(F.col("account").alias("target"), "community")
        votes = links.join(seen, "target").repartition(tasks, "source", "community").groupBy("source", "community").agg(
            F.sum("weight").alias("votes"))
        best = F.min(F.struct((-F.col("votes")).alias("votes"), "community"))["community"]
        labels = write_stage(
            votes.groupBy(F.col("source").alias("account")).agg(best.alias("community")), "labels"
        )
        if rounds is None:
            prints.append(tuple(labels.agg(F.sum(F.xxhash64("account", "community").cast("decimal(38,0)"))).first()))
            # The same labels as one or two rounds ago: nothing new can follow.
            if prints[-1] in prints[-3:-1]:
                break
    return labels
