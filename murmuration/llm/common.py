"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is computed again for every element; binding it to a lambda
    variable first avoids that.
    """
    return F.transform(F.array(value), body)[0]


def besides(keep: Iterable[str], results: Iterable[str]) -> tuple[str, ...]:
    """The columns to carry along: one named like a result column gives way to it."""
    return tuple(dict.fromkeys(c for c in keep if c not in set(results)))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text has this remainder; a missing key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: str, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that a slice holds about ``chars`` characters, and at least one row."""
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = np.cumsum([len(t) if t is not None else 0 for t in texts.to_pylist()])
        group = ends // max(chars, 1)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def small_batches(df: DataFrame, rows: int = 512) -> None:
    """Texts are long: hand Python few rows at a time, so that a batch stays at a few megabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _least(rows: DataFrame, by: Column, key: str, n: int, buckets: int = 64) -> DataFrame:
    """Per ``key`` the ``n`` rows least in ``by``: first in buckets of the rows, then of what they leave."""
    salted = rows.withColumn("_by", by).withColumn("_b", F.pmod(F.xxhash64("_by"), F.lit(buckets)))
    for part in ((key, "_b"), (key,)):
        order = Window.partitionBy(*part).orderBy("_by")
        salted = salted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return salted.drop("_by", "_b")


def labelled_sample(ids: DataFrame, docs: DataFrame, per_label: int, total: int = 20_000) -> list[tuple[str, object]]:
    """(text, label) of documents of every label, the same ones in every run.

    ``ids`` holds (doc_id, label). A label gives the ``per_label`` documents of the smallest hashes, or
    an equal share of ``total`` where that is less, and at least one. Of the texts that share a doc_id
    the one of the smallest hash is taken, so they use up one place. Only chosen texts travel.
    """
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", "label").distinct()
    labels = ids.agg(F.count_distinct("label")).first()[0]
    share = max(1, min(per_label, total // max(labels, 1)))
    chosen = _least(ids, F.struct(F.xxhash64("doc_id"), "doc_id"), "label", share).select(F.col("doc_id").alias("_d"), "label")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    return [(r["text"], r["label"]) for r in rows.orderBy("doc_id", "label").toLocalIterator()]
