import random
import re

import pytest
from pyspark.sql import functions as F

from murmuration.config import Settings
from murmuration.functions import text as X
from murmuration.sources import raw as R


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("out")).first()["out"]


def test_clean_author(spark):
    names = [None, "", " ", "0", "mill_owner", "[deleted]"]
    frame = spark.createDataFrame([(n,) for n in names], "v string").select("v", X.clean_author(F.col("v")).alias("out"))
    assert {r["v"]: r["out"] for r in frame.collect()} == {n: n or "[deleted]" for n in names}
    for value, kind, want in ((None, "double", "[deleted]"), (float("nan"), "double", "[deleted]"), (0.0, "double", "[deleted]"),
                              (0, "long", "[deleted]"), (812, "long", "812"), (-3, "long", "-3")):
        assert one(spark, lambda c: X.clean_author(c, numeric=True), value, kind) == want


def plain_norm(text):
    """The rule in words: lower case, links, mentions after a non-word character, single spaces."""
    out = re.sub(r"https?://\S+", " URL ", (str(text)).lower())
    out = re.sub(r"(?<!\w)u/\w+", " USER ", out)
    return re.sub(r"\s+", " ", out).strip()


def test_norm_text_follows_the_rule(spark):
    rng = random.Random(8)
    pieces = ["Mill", "http://weir.test/q=1", "HTTPS://LOCK.test", "u/Ann_9", "xu/no", "u/", "(u/ÄB)", "\t", "  ", "\n", "é", "7%", "http:/", "U/Up"]
    texts = [None, ""] + ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    got = X.add_norm_text(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert got.columns == ["text", "norm_text"]
    assert [(r["text"], r["norm_text"]) for r in got.collect()] == [(t, plain_norm(t)) for t in texts]


def test_collapse_matches_all_unicode_space(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    raw = " a" + "a".join(spaces) + "b \n"
    want = re.sub(r"\s+", " ", raw).strip()
    assert one(spark, X.collapse_spaces, raw) == want


def test_epoch(spark):
    cases = {"1711929601": 1711929601000000, "1711929601.25": 1711929601250000, "1.711929601E9": 1711929601000000, "-60": -60000000,
             "soon": None, "": None, None: None, "9e18": None}
    frame = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r["v"]: r["t"] for r in frame.select("v", F.unix_micros(X.epoch_to_timestamp(F.col("v"))).alias("t")).collect()} == cases


def test_topic_hits_follow_word_boundaries(spark):
    rng = random.Random(6)
    words = ["weir", "q.r", "d++", ".io", "mill race", "ß", "a|b"]
    glue = ["", " ", "_", ".", "é", "x", "9", "-", "+", "("]
    texts = [rng.choice(glue) + rng.choice(words + ["WEIR", "qxr", "Mill  race"]) + rng.choice(glue) + rng.choice(words) + rng.choice(glue) for _ in range(250)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", *[X.topic_hit(F.col("text"), [w]).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    for row in got:
        want = [bool(re.search(r"\b(?:" + re.escape(w) + r")\b", row["text"].lower())) for w in words]
        assert [row[f"w{i}"] for i in range(len(words))] == want, row["text"]


def test_many_keywords_are_looked_up(spark):
    rng = random.Random(8)
    odd = ["q.r", "d++", ".io", "mill race", "ß", "a|b", "+-+", "old mill  yard", "_x", "é9"]
    words = [f"weir{i}" for i in range(60)] + odd
    glue = ["", " ", "_", ".", "é", "x", "9", "-", "+", "("]
    texts = ["", " ", "+-+", *("".join(rng.choice(glue) + rng.choice(words + odd * 6 + ["WEIR7", "qxr", "Mill  race", "yard"]) for _ in range(3)) + rng.choice(glue)
                               for _ in range(400))]
    assert len(words) > X.SCANNED_KEYWORDS
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for chosen in (words, words[:60], odd * 4, ["+-+"] * 40):
        got = frame.select("text", X.topic_hit(F.col("text"), chosen).alias("hit")).collect()
        for row in got:
            want = any(re.search(r"\b(?:" + re.escape(w) + r")\b", (row["text"] or "").lower()) for w in chosen)
            assert row["hit"] == want, row["text"]


def test_topic_null_case_and_escape(spark):
    assert one(spark, lambda c: X.topic_hit(c, ["weir"]), None) is False
    assert one(spark, lambda c: X.topic_hit(c, ["Weir"]), "weir") is False
    for word in ("a.b(c)", "[d]{e}", "*+?^$|\\"):
        assert re.fullmatch(X.escape_keyword(word), word)
    with pytest.raises(ValueError):
        Settings(topics={"empty": ()})


def test_text_by_kind(spark):
    rng = random.Random(3)
    draw = lambda: rng.choice([None, "", "  gate \n\t shut ", "one", "two   three"])
    rows = [(str(i), rng.choice(["post", "comment", "other"]), rng.choice([None, "", "miller"]), rng.choice([None, "1711929601", "soon"]), draw(), draw(), draw())
            for i in range(80)]
    raw = spark.createDataFrame(rows, "id string, kind string, author string, created_utc string, title string, selftext string, body string")
    got = {r["id"]: r for r in R.normalize_activity(raw).collect()}
    for i, kind, author, created, title, selftext, body in rows:
        text = {"post": f"{title or ''} {selftext or ''}", "comment": body or ""}.get(kind, "")
        assert got[i]["text"] == " ".join(text.split()) and got[i]["author"] == (author or "[deleted]")
        assert (got[i]["created_dt"] is None) == (created != "1711929601")


def test_eligible_rows(activity):
    rng = random.Random(2)
    cases = [(str(i), rng.choice(["[deleted]", "kim", "lou"]), "q" * rng.randrange(8, 16)) for i in range(40)]
    got = R.eligible_activity(activity(*[{"id": i, "author": a, "text": t} for i, a, t in cases]), 12).collect()
    assert sorted((r["id"], r["norm_text"]) for r in got) == sorted((i, t) for i, a, t in cases if a != "[deleted]" and len(t) >= 12)


def test_spaces_collapse_as_split_and_join(spark):
    rng = random.Random(5)
    signs = " \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000   ab~!é中\U0001f600\u200b\x00\x7f"
    texts = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(4000)] + ["", " ", "\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.collapse_spaces(F.col("t")).alias("c")).collect()
    assert all(r["c"] == (None if r["t"] is None else " ".join(r["t"].split())) for r in got)


def test_visible_ascii_is_passed_over_before_any_range_is_tried():
    assert "(?![!-~])(?! [!-~])" in str(X.collapse_spaces(F.col("t")))
