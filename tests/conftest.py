from datetime import datetime, timedelta, timezone

import pytest

from murmuration import build_session

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=8, partitions=4)


@pytest.fixture
def at():
    """Timestamp so many seconds after the common start."""
    return lambda seconds: START + timedelta(seconds=seconds)


ACTIVITY = (
    "id string, author string, created_dt timestamp, kind string, subreddit string, link_id string, "
    "parent_id string, score long, text string"
)


@pytest.fixture
def activity(spark, at):
    """Builds activity rows from partial dicts."""

    def build(*rows):
        base = {"id": "1", "author": "alice", "created_dt": at(0), "kind": "comment", "subreddit": "town",
                "link_id": "t3_thread", "parent_id": None, "score": 1, "text": "hello"}
        order = [part.split()[0] for part in ACTIVITY.split(", ")]
        return spark.createDataFrame([tuple({**base, **row}[c] for c in order) for row in rows], ACTIVITY)

    return build
