"""Every registered query: a callable over (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.config import Settings
from murmuration.functions import scores as S
from murmuration.functions import text as X
from murmuration.operators import accounts as A
from murmuration.operators import components as C
from murmuration.operators import daily, density, duplicates, edges, embed, graph, ranking, tfidf
from murmuration.plans import tables as B
from murmuration.sources import landing, publish
from murmuration.sources import raw as R
from murmuration.session import write_stage

Query = Callable[[SparkSession, str], DataFrame]

# Word lists frequent in the given texts, one per language.
TOPICS = {
    "english": ("the", "and", "of"),
    "french": ("les", "des", "une"),
    "german": ("und", "der", "das"),
    "spanish": ("los", "que", "una"),
}
PLAIN = Settings()
TOPICAL = Settings(topics=TOPICS)

# The given vectors are spread out, so clusters are looked for at a lower similarity.
VECTOR_SIMILARITY = 0.35


def flat(df: DataFrame) -> DataFrame:
    """Plain output types: times as microseconds, days as text, doubles to six places."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def _micros_text(name: str) -> F.Column:
    """Time as text, for columns that hold nulls."""
    return F.unix_micros(name).cast("string").alias(name)


def _valid(spark, d, text=False):
    return R.valid_activity(B.activity(spark, d, text))


def _features(spark, d, settings=PLAIN):
    return A.account_features(_valid(spark, d, bool(settings.topics)), settings)


def _replies(spark, d):
    return edges.reply_edges(_valid(spark, d))


def _network(spark, d):
    return graph.heavy_edges(graph.network_edges(_replies(spark, d)))


def _selected(spark, d):
    # Read by the degree count and both ends of the induced edges: written once.
    return write_stage(graph.select_graph(write_stage(_replies(spark, d), "replies")), "selected")


def _eligible_documents(spark, d):
    return R.eligible_activity(B.document_rows(spark, d), PLAIN.min_text_chars)


def scan_activity(spark, d):
    rows = R.load_raw(spark, B.land_raw(spark, d))
    return flat(rows.select("id", "kind", "author", _micros_text("created_dt"), "subreddit", "link_id", "parent_id", "score",
                            F.md5("text").alias("text_md5"), F.length("text").alias("chars")))


def publish_kind(spark, d):
    rows = R.load_kind(spark, B.land_raw(spark, d), "posts")
    return flat(rows.select("id", "author", "created_utc", "subreddit", "score", "title", F.md5("selftext").alias("selftext_md5")))


def publish_manifest(spark, d):
    return publish.publish_manifest(spark, B.land_raw(spark, d))


def listed_subreddits(spark, d):
    return flat(publish.listed_subreddits(B.activity(spark, d), ("view", "quiet", "click")))


def flatten_pages(spark, d):
    rows = landing.flatten_pages(B.page_payloads(spark, d))
    return flat(rows.select("page", "id", "author", "created_utc", "subreddit", "score", "link_id", "parent_id"))


def dedupe_activity(spark, d):
    rows = landing.keep_first(B.landed_rows(spark, d), ["page", "pos"])
    return flat(rows.select("id", "author", "subreddit", "kind", "created_utc", "page", "pos"))


def resume_cursor(spark, d):
    return landing.resume_cursor(B.landed_rows(spark, d), ["kind", "subreddit"])


def scan_window(spark, d):
    by_day = write_stage(R.add_day(B.activity(spark, d)), "activity", "day")
    return flat(R.activity_window(by_day, "click", "2024-01-05", "2024-01-20").drop("day"))


def normalize_activity(spark, d):
    rows = B.raw_rows(spark, d)
    post = F.col("kind") == "post"
    raw = rows.withColumn("selftext", F.when(post, F.col("text"))).withColumn("body", F.when(~post, F.col("text"))).drop("text")
    out = R.normalize_activity(raw)
    return flat(out.select("id", "kind", "author", _micros_text("created_dt"), F.md5("text").alias("text_md5"), F.length("text").alias("chars")))


def norm_text(spark, d):
    return X.add_norm_text(B.documents(spark, d)).select("doc_id", "norm_text")


def valid_activity(spark, d):
    return flat(_valid(spark, d))


def eligible_activity(spark, d):
    return flat(_eligible_documents(spark, d).select("id", "author", "subreddit", F.md5("norm_text").alias("norm_md5")))


def topic_hits(spark, d):
    rows = B.document_rows(spark, d)
    return rows.select("id", *[X.topic_hit(F.col("text"), w).cast("long").alias(t) for t, w in TOPICS.items()])


def account_features(spark, d):
    return flat(_features(spark, d, TOPICAL))


def coordination_score(spark, d):
    return flat(S.coordination_score(_features(spark, d)).select(
        "author", "new7", "new30", "burst_signal", "concentration_signal", "volume_signal", "coordination_score"))


def rank_candidates(spark, d):
    return flat(ranking.rank_candidates(_features(spark, d)))


def candidate_preview(spark, d):
    return ranking.candidate_preview(ranking.rank_candidates(_features(spark, d)))


def candidate_preview_markdown(spark, d):
    return ranking.candidate_preview(ranking.rank_candidates(_features(spark, d)), 20, markdown=True)


def feature_preview(spark, d):
    return flat(A.feature_preview(_features(spark, d)))


def author_subreddit_crosstab(spark, d):
    return flat(A.subreddit_crosstab(_valid(spark, d)))


def topic_rates(spark, d):
    return flat(A.topic_rates(_valid(spark, d, True), TOPICAL))


def topic_summary(spark, d):
    return flat(A.topic_summary(A.topic_rates(_valid(spark, d, True), TOPICAL)))


def daily_activity(spark, d):
    return flat(daily.daily_activity(B.activity(spark, d)))


def new_account_daily_share(spark, d):
    return flat(daily.new_account_daily_share(B.activity(spark, d), 1, 2))


def reply_edges(spark, d):
    return flat(_replies(spark, d))


def shared_thread_edges(spark, d):
    return flat(edges.shared_thread_edges(_valid(spark, d)))


def temporal_pairs(spark, d):
    return flat(edges.temporal_edges(_valid(spark, d), PLAIN.temporal_window_minutes))


def network_edges(spark, d):
    return flat(graph.network_edges(_replies(spark, d)))


def reply_graph(spark, d):
    return flat(_network(spark, d))


def node_degree(spark, d):
    return flat(graph.node_degree(_network(spark, d)))


def top_degree_subgraph(spark, d):
    return flat(graph.top_degree_subgraph(write_stage(_network(spark, d), "network"), 50)[1])


def top_degree_nodes(spark, d):
    return flat(graph.top_degree_subgraph(_network(spark, d), 50)[0])


def network_nodes(spark, d):
    return flat(graph.network_nodes(_selected(spark, d), S.coordination_score(_features(spark, d))))


def network_links(spark, d):
    return flat(graph.network_links(_selected(spark, d)))


def ego_neighbors(spark, d):
    return flat(graph.ego_neighbors(_network(spark, d)))


def components(spark, d):
    return C.connected_components(edges.shared_thread_edges(_valid(spark, d), min_weight=2))


def communities(spark, d):
    return C.communities(edges.shared_thread_edges(_valid(spark, d)), 3)


def tfidf_vocabulary(spark, d):
    texts = tfidf.distinct_texts(_eligible_documents(spark, d))
    rows = texts.agg(F.sum("copies")).first()[0] or 0
    return flat(tfidf.vocabulary(texts, rows))


def tfidf_weights(spark, d):
    """Sums over each text's weights; the weights themselves number millions."""
    weights = tfidf.tfidf_weights(_eligible_documents(spark, d))
    return flat(weights.groupBy("key").agg(
        F.first("copies").alias("copies"), F.count(F.lit(1)).alias("grams"), F.sum("weight").alias("weight_sum"),
        F.max("weight").alias("weight_max"), F.sum(F.col("weight") * F.length("gram")).alias("weighted_length"),
    ))


def topk_cosine(spark, d):
    """The nearest rows of every row, however far they are."""
    near = duplicates.nearest_rows(_eligible_documents(spark, d), None)
    return flat(near.where("rank > 1 or row_b <> row_a").select("id_a", "rank", "id_b", "similarity"))


def near_duplicate_pairs(spark, d):
    pairs = duplicates.near_duplicate_pairs(_eligible_documents(spark, d), PLAIN.near_duplicate_threshold)
    return flat(pairs.withColumns({"text_a": F.md5("text_a"), "text_b": F.md5("text_b")}))


def near_duplicate_pairs_sparse_ids(spark, d):
    """Every seventh document without an id, and two documents sharing each of the others' ids."""
    number = F.col("id").cast("long")
    rows = B.document_rows(spark, d).withColumn("id", F.when(number % 7 != 0, F.floor(number / 2).cast("string")))
    pairs = duplicates.near_duplicate_pairs(R.eligible_activity(rows, PLAIN.min_text_chars), PLAIN.near_duplicate_threshold, 1000)
    return flat(pairs.select(
        F.least("created_a", "created_b").alias("first"), F.greatest("created_a", "created_b").alias("second"),
        "similarity", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b")))


def similar_text_edges(spark, d):
    pairs = duplicates.near_duplicate_pairs(_eligible_documents(spark, d), PLAIN.near_duplicate_threshold)
    return flat(edges.similar_text_edges(pairs))


def latest_rows(spark, d):
    return flat(ranking.latest_rows(B.activity(spark, d), 3000))


def embed_texts(spark, d):
    vectors = embed.hashed_vectors(B.document_rows(spark, d), "id")
    return flat(vectors.select("id", F.posexplode("embedding").alias("dimension", "value")).where("value <> 0"))


def cosine_neighbors(spark, d):
    return flat(density.cosine_neighbors(density.distinct_vectors(B.vector_rows(spark, d)), VECTOR_SIMILARITY))


def dbscan_labels(spark, d):
    return flat(density.dbscan_labels(B.vector_rows(spark, d).select("position", "embedding"), VECTOR_SIMILARITY, 3))


def dbscan_zero_vectors(spark, d):
    zero = F.col("position") % 10 == 0
    rows = B.vector_rows(spark, d).select("position", F.when(zero, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))).otherwise(
        F.col("embedding")).alias("embedding"))
    return flat(density.dbscan_labels(rows, VECTOR_SIMILARITY, 3))


def cluster_summary(spark, d):
    return flat(density.cluster_summary(B.vector_rows(spark, d)))


def dataset_stats(spark, d):
    pairs = duplicates.near_duplicate_pairs(_eligible_documents(spark, d), PLAIN.near_duplicate_threshold)
    return flat(ranking.dataset_stats(B.activity(spark, d), pairs, B.vector_rows(spark, d)))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        scan_activity, publish_kind, publish_manifest, listed_subreddits, flatten_pages, dedupe_activity,
        resume_cursor, scan_window, normalize_activity, norm_text, valid_activity, eligible_activity, topic_hits,
        account_features, coordination_score, rank_candidates, candidate_preview, candidate_preview_markdown,
        feature_preview, author_subreddit_crosstab, topic_rates, topic_summary, daily_activity,
        new_account_daily_share, reply_edges, shared_thread_edges, temporal_pairs, network_edges, reply_graph,
        node_degree, top_degree_subgraph, top_degree_nodes, network_nodes, network_links, ego_neighbors,
        components, communities, tfidf_vocabulary, tfidf_weights, topk_cosine, near_duplicate_pairs,
        near_duplicate_pairs_sparse_ids, similar_text_edges, latest_rows, embed_texts, cosine_neighbors, dbscan_labels, dbscan_zero_vectors, cluster_summary,
        dataset_stats,
    )
}
