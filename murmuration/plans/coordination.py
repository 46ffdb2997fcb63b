"""Whole analysis: raw activity in, tables for review out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.config import Settings
from murmuration.operators import accounts as A
from murmuration.operators import components, daily, density, duplicates, edges, embed, graph, ranking
from murmuration.session import prepare, stages_removed, write_stage
from murmuration.sources import raw as R


def candidates(activity: DataFrame, settings: Settings, limit: int = 100) -> DataFrame:
    """Accounts with the strongest signals, from activity to ranking in one lazy plan."""
    return ranking.rank_candidates(A.account_features(R.valid_activity(activity), settings), limit)


def cluster_texts(eligible: DataFrame, settings: Settings, encoder=None) -> DataFrame:
    """Latest eligible rows with their ``semantic_cluster``.

    ``encoder`` adds an ``embedding`` column to a DataFrame of (position, text); without one,
    a space of hashed n-grams is fitted on these texts.
    """
    # Written once: the labels are joined back to the very rows that were embedded.
    latest = write_stage(ranking.latest_rows(eligible, settings.max_embedding_rows), "latest")
    texts = latest.select("position", "text")
    vectors = encoder(texts) if encoder else embed.hashed_vectors(texts, "position")
    labels = density.dbscan_labels(
        vectors.select(F.col("position").cast("long").alias("position"), "embedding"),
        settings.semantic_similarity_threshold, settings.min_cluster_size,
    )
    return latest.join(labels, "position")


def run(spark: SparkSession, raw_dir: str, out_dir: str, settings: Settings, encoder=None) -> dict[str, str]:
    """Write every table of the analysis as Parquet under ``out_dir``; returns name to path.

    Activity is written first and read back, so the later steps share one normalised copy. The
    order is features, edges, texts, report tables; the first failure stops the run.
    Intermediate tables are removed at the end.
    """
    prepare(spark)
    with stages_removed(spark):
        return _run(spark, raw_dir, out_dir, settings, encoder)


def _run(spark: SparkSession, raw_dir: str, out_dir: str, settings: Settings, encoder) -> dict[str, str]:
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        R.write_table(df, paths[name], partition_by)
        return spark.read.schema(df.schema).parquet(paths[name])

    asked = R.activity_window(R.load_raw(spark, raw_dir), settings.subreddits, settings.after, settings.before)
    activity = save("activity", R.add_day(asked), "day")
    valid = R.valid_activity(activity)
    features = save("account_features", A.account_features(valid, settings))
    replies = save("interaction_edges", edges.reply_edges(valid))
    shared = save("shared_thread_edges", edges.shared_thread_edges(
        valid, settings.max_thread_authors, settings.shared_thread_weight))
    save("skipped_threads", edges.skipped_threads(valid, settings.max_thread_authors))
    save("components", components.connected_components(graph.heavy_edges(shared, settings.network_weight)))
    save("communities", components.communities(shared, settings.community_rounds))
    save("temporal_edges", edges.temporal_edges(valid, settings.temporal_window_minutes))

    eligible = duplicates.keyed_rows(R.eligible_activity(activity, settings.min_text_chars))
    near = (settings.near_duplicate_threshold, settings.neighbors, settings.max_features)
    pairs = save("near_duplicate_pairs", duplicates.near_duplicate_pairs(eligible, *near))
    save("similar_text_edges", edges.similar_text_edges(pairs))
    clusters = save("semantic_clusters", cluster_texts(eligible, settings, encoder))
    save("semantic_cluster_summary", density.cluster_summary(clusters))

    save("daily_activity", daily.daily_activity(activity))
    save("new_account_daily_share", daily.new_account_daily_share(
        activity, settings.very_new_account_days, settings.new_account_days))
    save("topic_summary", A.topic_summary(features))
    ranked = save("candidate_accounts", ranking.rank_candidates(features, settings.candidates))
    save("candidate_preview", ranking.candidate_preview(ranked))
    save("feature_preview", A.feature_preview(features))
    selected = save("network_edges", graph.select_graph(replies, settings.network_weight, settings.network_nodes))
    save("ego_neighbors", graph.ego_neighbors(graph.heavy_edges(graph.network_edges(replies), settings.network_weight)))
    scored = ranking.S.coordination_score(features)
    save("network_nodes", graph.network_nodes(selected, scored))
    save("network_links", graph.network_links(selected))
    save("dataset_stats", ranking.dataset_stats(activity, pairs, clusters))
    return paths
