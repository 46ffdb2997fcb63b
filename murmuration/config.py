"""Settings, passed as one plain object instead of a configuration file."""

from __future__ import annotations

from dataclasses import dataclass, field

DELETED = "[deleted]"


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds. The defaults are fixed values of the analysis.

    ``None`` lifts ``max_embedding_rows`` and ``max_thread_authors``.
    """

    subreddits: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None
    limit_per_request: int = 100
    max_pages_per_subreddit: int = 500
    very_new_account_days: int = 7
    new_account_days: int = 30
    min_text_chars: int = 30
    near_duplicate_threshold: float = 0.88
    semantic_similarity_threshold: float = 0.86
    temporal_window_minutes: int = 15
    min_cluster_size: int = 3
    max_embedding_rows: int | None = None
    max_thread_authors: int | None = 80
    shared_thread_weight: int = 1
    max_features: int = 100_000
    neighbors: int = 10
    candidates: int = 100
    network_nodes: int = 80
    network_weight: float = 2
    community_rounds: int | None = None
    topics: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for topic, words in self.topics.items():
            if not words or any(not str(word) for word in words):
                raise ValueError(f"topic {topic!r} needs at least one non-empty keyword")
