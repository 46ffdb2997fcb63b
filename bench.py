"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from murmuration import build_session
from murmuration.plans.catalog import QUERIES

HEADLINE = (
    "account_features", "rank_candidates", "topic_rates", "daily_activity", "new_account_daily_share", "reply_edges",
    "shared_thread_edges", "temporal_pairs", "network_nodes", "ego_neighbors", "components", "communities",
    "dedupe_activity", "flatten_pages", "norm_text", "tfidf_vocabulary", "near_duplicate_pairs", "embed_texts",
    "cosine_neighbors", "dbscan_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # Start the JVM paths and Python workers on something small before timing.
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        for name in ("rank_candidates", "near_duplicate_pairs"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
