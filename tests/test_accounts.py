import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmuration.config import Settings
from murmuration.functions.scores import coordination_score
from murmuration.operators import accounts as A
from murmuration.operators import daily, ranking

DAY = 86400


def by_author(df):
    return {r["author"]: r for r in df.collect()}


def direct_features(rows, settings, words):
    """Every account's features from plain Python; times in seconds."""
    timed = [r["t"] for r in rows if r["t"] is not None]
    out = {}
    for author in {r["author"] for r in rows}:
        own = [r for r in rows if r["author"] == author]
        times = sorted(r["t"] for r in own if r["t"] is not None)
        places = Counter(r["subreddit"] for r in own if r["subreddit"] is not None)
        scores = [r["score"] for r in own if r["score"] is not None]
        span = (times[-1] - times[0]) / DAY if times else None
        gaps = [y - x for x, y in zip(times, times[1:])]
        age = (max(timed) - times[0]) / DAY if times else None
        out[author] = {
            "activity_count": sum(r["id"] is not None for r in own), "post_count": sum(r["kind"] == "post" for r in own),
            "comment_count": sum(r["kind"] == "comment" for r in own), "subreddit_count": len(places),
            "thread_count": len({r["link_id"] for r in own} - {None}), "mean_score": statistics.mean(scores) if scores else None,
            "observed_span_days": span,
            "activity_per_observed_day": None if span is None else sum(r["id"] is not None for r in own) / max(span, 1 / 24),
            "median_interarrival_min": statistics.median(gaps) / 60 if gaps else None,
            "max_subreddit_share": max(places.values()) / sum(places.values()) if places else 0.0,
            "new_account_7d": age is not None and age <= settings.very_new_account_days,
            "new_account_30d": age is not None and age <= settings.new_account_days,
            "topic_water_rate": statistics.mean(any(w in r["text"].split() for w in words) for r in own),
        }
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    names = ["ida", "jon", "kit", "lev", "mae", "nia"]
    return [{
        "id": rng.choice([None] + [f"r{i}"] * 9), "author": rng.choice(names[:1] * 6 + names), "kind": rng.choice(["post", "comment"]),
        "t": rng.choice([None] + [rng.randrange(60 * DAY)] * 8), "subreddit": rng.choice([None, "mills", "locks", "weirs"]),
        "link_id": rng.choice([None, "t3_a", "t3_b", "t3_c"]), "score": rng.choice([None, -2, 0, 5, 11]),
        "text": " ".join(rng.choice(["weir", "sluice", "gate", "barge", "rope"]) for _ in range(3)),
    } for i in range(n)]


@pytest.mark.parametrize("seed, n", [(1, 200), (2, 12), (3, 1)])
def test_account_features_match_direct_computation(activity, at, seed, n):
    words = ("weir", "sluice")
    settings = Settings(topics={"water": words}, very_new_account_days=20, new_account_days=45)
    rows = random_rows(seed, n)
    frame = activity(*[{**{k: v for k, v in r.items() if k != "t"}, "created_dt": None if r["t"] is None else at(r["t"])} for r in rows])
    got, want = by_author(A.account_features(frame, settings)), direct_features(rows, settings, words)
    assert set(got) == set(want)
    for author, features in want.items():
        for name, value in features.items():
            assert got[author][name] == (pytest.approx(value) if isinstance(value, float) else value), (author, name)


def test_windows_include_their_last_moment(activity, at):
    settings = Settings(very_new_account_days=3, new_account_days=11)
    ages = {f"{days}{sign:+d}": days * DAY + sign for days in (3, 11) for sign in (-1, 0, 1)} | {"0": 0}
    frame = activity(*[{"author": name, "created_dt": at(40 * DAY - age)} for name, age in ages.items()])
    got = by_author(A.account_features(frame, settings))
    assert {k: (r["new_account_7d"], r["new_account_30d"]) for k, r in got.items()} == {
        k: (age <= 3 * DAY, age <= 11 * DAY) for k, age in ages.items()}


def test_median_gaps_match_direct_medians(activity, at):
    chance = random.Random(5)
    times = {f"a{n}": [chance.choice([0, 1, 50, 3600, 90_000]) * chance.randint(0, 9) + chance.random() for _ in range(n)]
             for n in range(1, 25)}
    times["same"] = [7.0] * 6
    times["hot"] = [chance.randint(0, 4000) for _ in range(800)]
    rows = activity(*[{"author": a, "created_dt": at(s)} for a, all_s in times.items() for s in all_s])
    exact = {r["author"]: r["us"] for r in rows.groupBy("author").agg(
        F.sort_array(F.collect_list(F.unix_micros("created_dt"))).alias("us")).collect()}
    want = {a: statistics.median(y - x for x, y in zip(us, us[1:])) / 60e6 for a, us in exact.items() if len(us) > 1}
    got = {r["author"]: r["median_interarrival_min"] for r in A.median_gaps(rows).collect()}
    assert got == pytest.approx(want)


FEATURES = ("author string, new_account_7d boolean, new_account_30d boolean, median_interarrival_min double, "
            "max_subreddit_share double, activity_count long, post_count long, comment_count long")


def random_features(seed, n):
    rng = random.Random(seed)
    return [(f"n{i:03d}", rng.random() < 0.3, rng.random() < 0.5, rng.choice([None, rng.uniform(0, 400)]), rng.choice([None, rng.random()]),
             c := rng.randrange(1, 900), c // 3, c - c // 3) for i in range(n)]


def direct_score(row, largest):
    _, new7, new30, gap, share, count, _, _ = row
    burst = 1 / (1 + (999 if gap is None else gap) / 10)
    return 0.30 * new7 + 0.20 * new30 + 0.20 * burst + 0.15 * (share or 0) + 0.15 * math.log(1 + count) / math.log(1 + max(largest, 2))


@pytest.mark.parametrize("n", [1, 160])
def test_scores_and_ranks_match_direct_computation(spark, n):
    rows = random_features(n, n)
    want = {r[0]: direct_score(r, max(x[5] for x in rows)) for r in rows}
    frame = spark.createDataFrame(rows, FEATURES)
    assert {k: r["coordination_score"] for k, r in by_author(coordination_score(frame)).items()} == pytest.approx(want)
    order = sorted(want, key=lambda a: (-round(want[a], 12), a))
    assert [r["author"] for r in ranking.rank_candidates(frame).collect()] == order[:100]
    assert [r["author"] for r in ranking.rank_candidates(frame, 7).collect()] == order[:7]


def test_preview_escapes_its_cells(spark):
    names = ['<i>"q"', "a|b", "x & y"]
    frame = spark.createDataFrame([(n, False, True, 12.5, 0.25, 40, 10, 30) for n in names], FEATURES)
    page = {r["account"]: r for r in ranking.candidate_preview(frame.transform(coordination_score)).collect()}
    assert set(page) == {n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") for n in names}
    assert {(r["median_gap_min"], r["max_subreddit_share"], r["activity"]) for r in page.values()} == {("12.50", "0.25", "40")}
    cells = ranking.candidate_preview(frame.transform(coordination_score), markdown=True).collect()
    assert {r["account"] for r in cells} == {n.replace("|", "\\|") for n in names}


def test_topic_summary(spark):
    rng = random.Random(1)
    rows = [(f"a{i}", rng.random(), rng.random(), 0.5) for i in range(20)]
    frame = spark.createDataFrame(rows, "author string, topic_x_rate double, topic_y_rate double, topic_z_rate double")
    means = sorted((statistics.mean(r[k] for r in rows), n) for k, n in ((1, "x"), (2, "y"), (3, "z")))
    assert [(r["topic"], r["mean_rate"]) for r in A.topic_summary(frame).collect()] == [(n, pytest.approx(m)) for m, n in means]


def test_crosstab(activity):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, "mills", "locks", "weirs"])) for _ in range(60)] + [("lone", "elsewhere"), ("none", None)]
    frame = activity(*[{"author": a, "subreddit": s} for a, s in rows])
    counts = Counter(r for r in rows if r[1] is not None)
    names = sorted({s for _, s in rows if s})
    got = A.subreddit_crosstab(frame)
    assert got.columns == ["author", *names]
    assert {r["author"]: [r[n] for n in names] for r in got.collect()} == {a: [counts[(a, n)] for n in names] for a, _ in counts}
    assert {(r["author"], r["subreddit"]): r["rows"] for r in A.subreddit_counts(frame).collect()} == counts
    assert A.subreddit_crosstab(frame, ["locks", "dry"]).columns == ["author", "locks", "dry"]


def test_daily_counts_fill_gaps(activity, at):
    rng = random.Random(9)
    days = [rng.choice([0, 1, 4, 9]) for _ in range(40)] + [0, 9]
    frame = activity(*[{"created_dt": at(d * DAY + rng.randrange(DAY))} for d in days], {"created_dt": None})
    assert [r["rows"] for r in daily.daily_activity(frame).orderBy("day").collect()] == [Counter(days)[d] for d in range(10)]


def test_new_account_share_matches_direct_count(activity, at):
    chance = random.Random(3)
    rows = activity(*[{"author": chance.choice("abc"), "created_dt": at(chance.randint(0, 12) * DAY + chance.choice([0, 1, 500, 80_000]))}
                      for _ in range(300)])
    pdf = rows.select("author", F.unix_micros("created_dt").alias("us")).toPandas()
    age = (pdf["us"] - pdf.groupby("author")["us"].transform("min")) / 86400e6
    want = {k: (int(v.sum()), len(v)) for k, v in (age <= 3).groupby(pdf["us"] // 86_400_000_000)}
    got = daily.new_account_daily_share(rows, 3, 30).where("total > 0").orderBy("day").collect()
    assert [(r["new_7d"], r["total"]) for r in got] == [want[k] for k in sorted(want)]


@pytest.mark.parametrize("limit", [1, 7, 500, None])
def test_latest_rows_match_a_sort(activity, at, limit):
    rng = random.Random(5)
    rows = [(rng.choice([None, f"i{rng.randrange(20):02d}"]), rng.choice([None, rng.randrange(30)]), f"t{n}") for n in range(60)]
    frame = activity(*[{"id": i, "created_dt": None if t is None else at(t), "text": x} for i, t, x in rows])
    got = ranking.latest_rows(frame, limit).orderBy("position").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0] is not None, r[0] or "", r[2]))
    want = order if limit is None else order[-limit:]
    assert [(r["id"], r["text"]) for r in got] == [(i, x) for i, _, x in want]
    assert [r["position"] for r in got] == list(range(len(want)))
