"""Pages on a stream against the batch load of the same pages."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from murmuration.operators.daily import daily_activity
from murmuration.sources import landing as L
from murmuration.sources import raw as R
from murmuration.streaming import ingest as I

START, DAY = 1_704_067_200, 86_400
PAGES = "kind string, subreddit string, page long, payload string"


def page(kind, forum, number, rows):
    return {"kind": kind, "subreddit": forum, "page": number, "payload": json.dumps({"data": rows})}


def row(ident, seconds, body="text"):
    return {"id": ident, "author": "kim", "created_utc": seconds, "body": body}


@pytest.fixture
def forum_pages():
    """Three keys; copies of ids weeks apart and in other pages; rows without id; one load that ends early."""
    rng = random.Random(8)
    pages = []
    for n in range(1, 13):
        at = START + n * 5 * DAY
        rows = [row(f"a{n}-{i}", at + i * 3600 * rng.randrange(1, 20)) for i in range(3)]
        rows.append(row(f"a{max(n - 7, 1)}-0", at + 9, "a copy weeks later"))
        rows.append({"author": "lee", "created_utc": at + 50_000, "body": "no id"})
        pages.append(page("comment", "locks", n, rows))
        if n <= 6:
            # Latest second repeated at page 4: the load of this key ends there.
            last = START + (3 if n in (3, 4) else n) * DAY + 60_000
            pages.append(page("comment", "mills", n, [row(f"m{n}-{i}", last - i) for i in range(5)]))
        if n <= 5:
            rows = [{"id": f"p{n}", "author": "ann", "created_utc": START + n * DAY * 0.4, "title": "t", "selftext": "s"}] * 5
            pages.append(page("post", "locks", n, rows if n < 5 else rows[:2]))
    return pages


def land(spark, pages, splits, tmp_path, name, **keep):
    """Pages through the stream, one file per split and one query start each."""
    folder = tmp_path / f"in-{name}"
    folder.mkdir()
    at = 0
    for n, size in enumerate(splits):
        (folder / f"{n:03}.json").write_text("\n".join(json.dumps(p) for p in pages[at:at + size]))
        at += size
        stream = spark.readStream.schema(PAGES).json(str(folder))
        I.land_stream(stream, str(tmp_path / name), str(tmp_path / f"state-{name}"), 5, 500, **keep).awaitTermination(240)
    assert at >= len(pages)
    return str(tmp_path / name)


def contents(df):
    return sorted(repr((r["id"], r["kind"], r["subreddit"], r["author"], r["created_dt"], r["text"])) for r in df.collect())


def batch_load(spark, pages):
    frame = spark.createDataFrame([tuple(p[c] for c in ("kind", "subreddit", "page", "payload")) for p in pages], PAGES)
    return R.normalize_activity(L.new_rows(frame, 5, 500).drop("page", "pos"))


@pytest.mark.parametrize("splits", [[40], [1, 4, 2, 9, 1, 30]])
def test_any_split_equals_the_batch_load(spark, forum_pages, tmp_path, splits):
    out = land(spark, forum_pages, splits, tmp_path, "out")
    whole = batch_load(spark, forum_pages)
    got = spark.read.parquet(f"{out}/activity")
    assert contents(got) == contents(whole)
    assert not got.where("id LIKE 'm5%'").count() and got.where("id LIKE 'm4%'").count() == 5
    want = [tuple(r) for r in daily_activity(whole).collect()]
    assert sorted(tuple(r) for r in I.read_daily(spark, out).collect()) == sorted(want)


def test_a_batch_that_runs_again_changes_nothing(spark, forum_pages, tmp_path):
    frame = spark.createDataFrame([tuple(p[c] for c in ("kind", "subreddit", "page", "payload")) for p in forum_pages], PAGES)
    used = L.usable_pages(L.flatten_keyed(frame), 5, 500, ["kind", "subreddit"])
    pages = frame.join(used, ["kind", "subreddit", "page"], "left_semi")
    out = str(tmp_path / "again")
    first, second = pages.where("page <= 6"), pages.where("page > 6")
    I.land_batch(first, 0, out)
    I.land_batch(second, 1, out)
    before = contents(spark.read.parquet(f"{out}/activity"))
    counts = sorted(map(tuple, I.read_daily(spark, out).collect()))
    I.land_batch(second, 1, out)
    I.land_batch(first, 0, out)
    assert contents(spark.read.parquet(f"{out}/activity")) == before == contents(batch_load(spark, forum_pages))
    assert sorted(map(tuple, I.read_daily(spark, out).collect())) == counts
    assert spark.read.parquet(f"{out}/ids").groupBy("id").count().where("count > 1").count() == 0


def test_state_takes_the_pages_of_the_batch_rule(spark, tmp_path):
    """Gaps, empty pages, pages out of numbers, short pages and the page limit, over restarts."""
    rng = random.Random(3)
    pages = []
    for k in range(25):
        numbers = [n for n in range(rng.choice([1, 1, 4]), 9) if rng.random() > 0.08]
        for n in numbers:
            size = rng.choice([0] + [2] * 9 + [1])
            at = None if rng.random() < 0.05 else START + n * 10 + (-10 if rng.random() < 0.06 else 0)
            pages.append(page("comment", f"f{k}", n, [row(f"{k}-{n}-{i}", at) for i in range(size)]))
    pages.sort(key=lambda p: p["page"])
    frame = spark.createDataFrame([tuple(p[c] for c in ("kind", "subreddit", "page", "payload")) for p in pages], PAGES)
    want = L.usable_pages(L.flatten_keyed(frame), 2, 5, ["kind", "subreddit"])
    folder, seen = tmp_path / "pages", str(tmp_path / "seen")
    folder.mkdir()
    for n, cut in enumerate(range(0, len(pages), 60)):
        again = pages[max(cut - 5, 0):cut]
        (folder / f"{n}.json").write_text("\n".join(json.dumps(p) for p in again + pages[cut:cut + 60]))
        with I._state_store(spark):
            query = I.taken_pages(spark.readStream.schema(PAGES).json(str(folder)), 2, 5).writeStream.format("parquet").option(
                "path", seen).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    got = [tuple(r) for r in spark.read.parquet(seen).select("kind", "subreddit", "page").collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and 30 < len(got) < len(pages)


def test_one_day_is_rewritten_alone(spark, at, tmp_path):
    path = str(tmp_path / "days")
    rows = [(str(i), at(i * 3600 * 5)) for i in range(30)]
    frame = R.add_day(spark.createDataFrame(rows, "id string, created_dt timestamp"))
    R.write_days(frame, path)
    files = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    one = frame.where("day = DATE'2024-01-03'").withColumn("id", F.concat("id", F.lit("x")))
    R.write_days(one, path)
    after = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    same = {f for f in files if "day=2024-01-03" not in str(f)}
    assert same and all(after.get(f) == files[f] for f in same)
    assert {f for f in after if f not in files} and not {f for f in files if f not in same} & set(after)
    got = spark.read.parquet(path)
    assert got.count() == 30 and got.where("id LIKE '%x'").count() == one.count() > 0


def test_empty_batch(spark, tmp_path):
    I.land_batch(spark.createDataFrame([], PAGES), 0, str(tmp_path / "none"))
    I.land_batch(spark.createDataFrame([("post", "f", 1, "not json")], PAGES), 1, str(tmp_path / "none"))
    assert not list(Path(tmp_path / "none").rglob("part-*.parquet"))
