"""Line dedup over range-partitioned hashes, in DataFrame operations only.

Only hashes travel: a line is its 128-bit key hash, its document and its position. Lines are
range-partitioned by hash and sorted there by document and position, so each hash is one run of the
sorted stream and its first row names the document that keeps it; every later row of another
document is dropped. What comes back to a document is a bitmap of kept lines, never text.

A key that holds a large part of all lines would be one run in one task. A sketch over all lines
names at most ``HEAVY`` such candidates; their first documents come from a pre-aggregated minimum and
are broadcast. The sketch decides about the way only, not about the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import bound, text_of
from murmuration.session import write_stage

STRIP = " \t\n\x0b\x0c\r"
LEAST = 10
# Hashes settled by broadcast (24 bytes each), and hashes the sketch follows: any key with more than
# about a thousandth of the lines is surely among them.
HEAVY = 1000
TRACKED = 20_000
# Lines in a word of the bitmap.
WORD_BITS = 64


def _row_key(key: str, text: Column) -> list[Column]:
    """128 bits that name a document row; equal rows share them, and with them their bitmap."""
    return [
        F.xxhash64(F.col(key), text).alias("_ld_a"),
        F.xxhash64(F.lit(1), F.col(key), text).alias("_ld_b"),
    ]


def line_hashes(docs: DataFrame, column: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(_ld_a, _ld_b, doc, pos, h1, h2): one row per line whose key has ``least`` code points or more."""
    folded = F.translate(text_of(column), string.ascii_uppercase, string.ascii_lowercase)
    lines = docs.select(*_row_key(key, text_of(column)), F.col(key).alias("doc"), F.posexplode(F.split(folded, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(STRIP))).where(F.length("line") >= least)
    return keyed.select(
        "_ld_a", "_ld_b", "doc", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def heavy_firsts(lines: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(h1, h2, first): the first document of the most frequent hashes, at most about ``heavy`` rows."""
    found = lines.agg(F.expr(f"approx_top_k(h1, {heavy}, {max(TRACKED, heavy)})").alias("top"))
    top = found.select(F.explode("top").alias("top")).select(F.col("top.item").alias("h1"))
    return lines.join(F.broadcast(top), "h1").groupBy("h1", "h2").agg(F.min("doc").alias("first"))


def dropped_lines(lines: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(_ld_a, _ld_b, pos) of the lines that an earlier document holds too.

    Documents without an id come after all others and count as one.
    """
    named = write_stage(heavy_firsts(lines, heavy), "line-heavy").withColumn("known", F.lit(True))
    placed = lines.join(F.broadcast(named), ["h1", "h2"], "left")
    settled = placed.where("known")
    sorted_runs = placed.where("known IS NULL").drop("first", "known").repartitionByRange("h1", "h2").sortWithinPartitions(
        "h1", "h2", F.asc_nulls_last("doc"), "pos")
    run = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc"), "pos")
    streamed = sorted_runs.withColumn("first", F.first("doc").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    later = ~F.col("doc").eqNullSafe(F.col("first"))
    columns = ("_ld_a", "_ld_b", "pos")
    return settled.where(later).select(*columns).unionByName(streamed.where(later).select(*columns))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(_ld_a, _ld_b, keep): words of 64 lines that lose some line, in order; words not listed stay whole.

    ``keep`` is an array of (word, bits); bit j of word w stands for line 64 w + j. Bits are merged
    before the shuffle, so equal rows cost one word between them.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD_BITS)
    words = dropped.groupBy("_ld_a", "_ld_b", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("_ld_a", "_ld_b").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined by line ends; work is linear in lines and words."""

    def lines_left(lines: Column) -> Column:
        word = lambda i: keep[i]["word"]

        def stretch(i: Column) -> Column:
            after = F.when(i == 0, F.lit(0)).otherwise((word(F.greatest(i - 1, F.lit(0))) + 1) * WORD_BITS)
            here = F.when(i < F.size(keep), word(i) * WORD_BITS).otherwise(F.greatest(F.size(lines), after))
            whole = F.slice(lines, after + 1, here - after)
            cut = F.filter(F.slice(lines, here + 1, F.lit(WORD_BITS)), lambda _, j: F.getbit(keep[i]["bits"], j) == 1)
            return F.when(i < F.size(keep), F.concat(whole, cut)).otherwise(whole)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(keep)), stretch)), "\n")

    return F.when(keep.isNull(), text).otherwise(bound(F.split(text, "\n"), lines_left))


def line_dedup(
    docs: DataFrame, column: str = "text", key: str = "doc_id", least: int = LEAST, heavy: int = HEAVY,
) -> DataFrame:
    """``docs`` with keep (bitmap, see ``keep_bitmaps``; null if all lines stay), n_lines and n_dropped.

    A line loses its copies in all documents but the one of the smallest key; inside that document
    it stays as often as it stands there. Keys of lines shorter than ``least`` code points stay. A null or
    empty text is one empty line. Rows of one ``key`` are one document, rows without one are a single
    document after all others. Repeated rows get the same bitmap. The added columns replace columns
    of the same names. One document's bitmap is one row; nothing else is gathered.
    """
    lines = write_stage(line_hashes(docs, column, key, least), "lines")
    bitmaps = write_stage(keep_bitmaps(dropped_lines(lines, heavy)), "line-bitmaps").select(
        F.col("_ld_a").alias("_ld_c"), F.col("_ld_b").alias("_ld_d"), F.col("keep").alias("_ld_keep"))
    keyed = docs.withColumns(dict(zip(("_ld_a", "_ld_b"), _row_key(key, text_of(column)))))
    joined = keyed.join(bitmaps, (F.col("_ld_a") == F.col("_ld_c")) & (F.col("_ld_b") == F.col("_ld_d")), "left")
    lost = F.aggregate("_ld_keep", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(F.bitwise_not(w["bits"])))
    return joined.withColumns({
        "keep": F.col("_ld_keep"),
        "n_lines": F.size(F.split(text_of(column), "\n")).cast("long"),
        "n_dropped": F.coalesce(lost, F.lit(0).cast("long")),
    }).drop("_ld_a", "_ld_b", "_ld_c", "_ld_d", "_ld_keep")


def digest(docs: DataFrame) -> DataFrame:
    found = line_dedup(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(kept_text(text_of(), F.col("keep")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), e AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM e WHERE length(key) >= {LEAST} GROUP BY key
), j AS (
  SELECT k, e.doc_id, i, line, f.key IS NOT NULL AND e.doc_id IS DISTINCT FROM f.first AS dropped
  FROM e LEFT JOIN f ON e.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY k, doc_id
"""
