"""Quality rules: a threshold table compiled into one projection.

Everything is a built-in expression over the row itself, so the operator adds no shuffle and no
Python worker, and a long text costs its own row only (n log n in its words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import bound, text_of, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of the supported languages; a running text holds some of them.
STOP_WORDS = (
    "the of and to in that is was for it with as be on by at from or an are this which not "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui est pour dans par sur pas au avec "
    "el los las y se por con no su del al lo para una es"
).split()

# (rule, numerator, denominator, least, most): a row passes when least <= numerator / denominator
# <= most; None leaves that side open. A zero denominator passes.
THRESHOLDS = (
    ("word_length", "word_chars", "n_words", 2.0, 12.0),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(words: Column) -> Column:
    """Words standing in a three-word window that the text holds at least twice.

    Windows are sorted as text with their position appended; equal neighbours are the repeated
    ones. A window start covers three words, less what the next start covers again.
    """
    windows = bound(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.concat(w[i], F.lit(" "), w[i + 1], F.lit(" "), w[i + 2], F.lit(" "), F.lpad(i.cast("string"), 10, "0")),
    ))
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 10)
    at = lambda x: F.substring(x, -10, 10).cast("int")

    def starts(s):
        heads = F.transform(s, body)
        return bound(heads, lambda h: F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (
                (i > 0) & (h[F.greatest(i - 1, F.lit(0))] == h[i])
            ) | ((i < F.size(h) - 1) & (h[F.least(i + 1, F.size(h) - 1)] == h[i]))),
            lambda i: at(s[i]),
        )))

    def covered(p):
        gaps = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.least(p[i + 1] - p[i], F.lit(3)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.lit(3) + F.when(F.size(p) == 1, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        bound(F.sort_array(windows), lambda s: bound(starts(s), covered))
    ).cast("long")


def _counts(words: Column, text: Column) -> Column:
    """Struct of the counts the rules compare."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
        )).alias("lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def measures(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``_mm_counts`` of the counts the rules compare.

    A missing text has no words and no lines. Names in ``docs`` are left alone except ``_mm_words`` and ``_mm_counts``.
    """
    text = text_of(column)
    with_words = docs.withColumn("_mm_words", words_of(text))
    return with_words.withColumn("_mm_counts", _counts(F.col("_mm_words"), text)).drop("_mm_words")


def failed_rules(m: Column, thresholds=THRESHOLDS) -> Column:
    """Names of the rules a row breaks, compiled from the threshold table."""
    fields = {"n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"]}
    value = lambda name: fields.get(name, m[name] if name not in fields else None)
    tests = []
    for rule, top, bottom, least, most in thresholds:
        ratio = value(top) / F.nullif(value(bottom), F.lit(0))
        broken = F.lit(False)
        if least is not None:
            broken = broken | (ratio < least)
        if most is not None:
            broken = broken | (ratio > most)
        tests.append(F.when(broken, F.lit(rule)))
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def passes(column: str = "text", thresholds=THRESHOLDS) -> Column:
    """Whether a text passes all rules, for use as a filter.

    A filter on the column ``kept`` would put the counts in place of their name wherever a rule uses
    them; here words and counts are computed once per row.
    """
    text = text_of(column)
    verdict = lambda m: ~_base_failed(m) & (F.size(failed_rules(m, thresholds)) == 0)
    return bound(words_of(text), lambda words: bound(_counts(words, text), verdict))


def quality_rules(docs: DataFrame, column: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed`` (rule names) and ``kept``.

    Null and empty texts have zero counts, fail the base rule and are not kept. Repeated rows are
    judged each on its own. The added columns replace columns of the same names.
    """
    m = F.col("_mm_counts")
    base = _base_failed(m)
    failed = failed_rules(m, thresholds)
    return measures(docs, column).withColumns({
        "n_words": m["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
        "n_dup_lines": m["lines"]["dup"], "n_repeat_words": m["n_repeat_words"],
        "base_failed": base, "failed": failed, "kept": ~base & (F.size(failed) == 0),
    }).drop("_mm_counts")


DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text")).select(*DIGEST)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS k
  FROM documents
), g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
  FROM w LEFT JOIN c USING (k)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.25
  AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""
