"""What a task holds at once, and what is written, stay bounded."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from murmuration.config import Settings
from murmuration.functions import text as X
from murmuration.operators import accounts, components, density, edges, tfidf, tiles


def test_texts_are_counted_in_parts(monkeypatch):
    seen = []
    monkeypatch.setattr(tfidf, "PART_POINTS", 100)
    monkeypatch.setattr(tfidf, "corpus_counts", lambda texts, copies: seen.append(texts) or [])
    texts = ["word " * n for n in (4, 10, 60, 1, 0, 19, 20)]
    list(tfidf._gram_batches([pa.RecordBatch.from_pydict({"text": texts, "copies": [1] * len(texts)})]))
    assert [t for part in seen for t in part] == texts
    assert all(len(part) == 1 or sum(map(len, part)) <= 100 for part in seen)


def test_weights_are_listed_in_parts(spark, monkeypatch):
    rows = [(f"{i}", "river lock and mill " * (i + 1)) for i in range(9)]
    frame = spark.createDataFrame(rows, "id string, norm_text string")
    want = {tuple(r) for r in tfidf.tfidf_weights(frame).collect()}
    monkeypatch.setattr(tfidf, "PART_WEIGHTS", 5)
    monkeypatch.setattr(tfidf, "PART_POINTS", 50)
    assert {tuple(r) for r in tfidf.tfidf_weights(frame).collect()} == want


def test_packed_texts_come_back():
    idx = np.array([0, 3, 70_000, 99_999])
    tf = np.array([1, 300, 70_000, 2])
    got = tfidf.unpack(tfidf.pack(idx, tf), 4)
    assert got[0].tolist() == idx.tolist() and got[1].tolist() == tf.tolist()


def test_texts_are_dealt_once(spark):
    rows = [(f"{i}", f"barges wait below lock number {i % 7} and {i}") for i in range(40)]
    texts = tfidf.distinct_texts(spark.createDataFrame(rows, "id string, norm_text string"))
    weights = tfidf.gather_weights(tfidf.vocabulary(texts, 40))
    vectors = tfidf.write_stage(tfidf.text_vectors(texts, weights, 0.8), "vectors")
    plan = tiles.similar_texts(vectors, weights, 0.8, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_hits_come_in_slabs():
    tile = pa.table({"embedding": pa.array([[1.0, 0.0]] * 1100, pa.list_(pa.float32()))})
    found = list(density._hits(tile, tile, True, 0.9))
    assert sum(len(i) for i, _, _ in found) == 1100 * 1099 // 2
    assert max(len(i) for i, _, _ in found) <= 512 * 1100


def test_pairs_are_counted_in_more_tasks_where_there_are_more(spark, activity, monkeypatch):
    monkeypatch.setattr(edges, "PAIRS_PER_TASK", 3)
    valid = activity(*[{"id": str(i), "author": f"u{i}", "link_id": "t"} for i in range(12)])
    found = edges.shared_thread_edges(valid)
    assert "RepartitionByExpression [link_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert edges.tasks_for(spark, 66) == 22
    assert found.count() == 66
    labels = {r["account"]: r["community"] for r in components.communities(found, 1).collect()}
    assert labels == {f"u{i}": "u0" if i else "u1" for i in range(12)}


def test_features_read_their_rows_twice_at_most(activity):
    valid = activity({"id": "1"}, {"id": "2"}).withColumn("text", F.expr("concat('heavy', rand(3))"))
    plan = accounts.account_features(valid, Settings(topics={"one": ("word",)}))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("LogicalRDD") + plan.toString().count("LocalRelation") <= 1


def test_keywords_between_spaces_skip_the_regular_expression(spark):
    texts = ["to the lock", "theatre", "the", "a the.", "lathe the-", "bathe them", "c++ x", "c++"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.topic_hit(F.col("t"), ("the", "c++")).alias("h"))
    assert [r["h"] for r in got.collect()] == [True, False, True, True, True, False, False, False]
    assert "Contains(lower(t" in got._jdf.queryExecution().optimizedPlan().toString() and "the " in X.topic_hit(F.col("t"), ("the",))._jc.toString()
