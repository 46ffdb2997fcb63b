"""Fixed row types of the tables that cross stage boundaries."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

# The columns the archive delivers, in publication order.
POST_COLUMNS = (
    "id", "author", "author_fullname", "created_utc", "retrieved_on", "subreddit",
    "subreddit_id", "score", "title", "selftext", "url", "link_flair_text",
    "num_comments", "crosspost_parent",
)
COMMENT_COLUMNS = (
    "id", "author", "author_fullname", "created_utc", "retrieved_on", "subreddit",
    "subreddit_id", "score", "body", "link_id", "parent_id", "distinguished",
)
PREFERRED_COLUMNS = {"posts": POST_COLUMNS, "comments": COMMENT_COLUMNS}

_NUMBERS = {"retrieved_on": _L, "score": _L, "num_comments": _L}

# ``created_utc`` is text so that an unreadable value becomes null instead of an error.
RAW_POSTS = _struct(*[(name, _NUMBERS.get(name, _S)) for name in POST_COLUMNS])
RAW_COMMENTS = _struct(*[(name, _NUMBERS.get(name, _S)) for name in COMMENT_COLUMNS])

# One landed row of either kind, as read from JSON pages.
LANDED_ROW = _struct(
    *[(name, _NUMBERS.get(name, _S)) for name in POST_COLUMNS],
    *[(name, _NUMBERS.get(name, _S)) for name in COMMENT_COLUMNS if name not in POST_COLUMNS],
)

ACCOUNT_FEATURES = _struct(
    ("author", _S), ("activity_count", _L), ("post_count", _L), ("comment_count", _L),
    ("subreddit_count", _L), ("thread_count", _L), ("mean_score", _D),
    ("author_first_seen", _TS), ("author_last_seen", _TS), ("observed_span_days", _D),
    ("activity_per_observed_day", _D), ("new_account_7d", T.BooleanType()),
    ("new_account_30d", T.BooleanType()), ("max_subreddit_share", _D),
    ("median_interarrival_min", _D),
)
INTERACTION_EDGES = _struct(("author", _S), ("parent_author", _S), ("weight", _L))
SHARED_THREAD_EDGES = _struct(("source", _S), ("target", _S), ("weight", _L))
CLUSTER_SUMMARY = _struct(
    ("semantic_cluster", T.IntegerType()), ("cluster_size", _L), ("unique_accounts", _L),
    ("first_time", _TS), ("last_time", _TS), ("subreddits", _S),
)


def account_features_schema(topics) -> T.StructType:
    """Account feature type with one rate column per configured topic."""
    return T.StructType(
        ACCOUNT_FEATURES.fields + [T.StructField(f"topic_{t}_rate", _D, True) for t in topics]
    )
