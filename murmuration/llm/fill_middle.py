"""Fill-in-the-middle transformation: a text cut at two line ends and put in another order.

One full match of ``(unit)*`` keeps every repetition of the unit, so the ends of its first group
give the number of units and both cut places; nothing runs over the units. Only the text and the two
draws go to Python and three numbers come back; the cutting, the output and the way back are
built-in expressions. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from murmuration.llm.common import bound, text_of

UNIT = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100
SPM_RATE = 50
CUT = StructType().add("n", LongType()).add("prefix", LongType()).add("middle", LongType())

_UNITS = regex.compile(rf"({UNIT})*")


def cuts(text: str, one: int, other: int) -> tuple[int, int, int]:
    """Number of units, and the code points of prefix and middle for two draws."""
    ends = _UNITS.fullmatch(text).ends(1)
    first, last = sorted((one % (len(ends) + 1), other % (len(ends) + 1)))
    prefix = ends[first - 1] if first else 0
    return len(ends), prefix, (ends[last - 1] if last else 0) - prefix


@F.pandas_udf(CUT)
def _cut_points(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, ones, others in batches:
        found = [cuts(t, a, b) for t, a, b in zip(texts, ones, others)]
        yield pd.DataFrame(found, columns=["n", "prefix", "middle"], dtype="int64")


def _draw(digest: Column, number: int) -> Column:
    """The ``number``-th group of eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    heads = [m[:1] for m in markers]
    if len(set(markers)) < 3 or "" in heads or any(h in m[1:] for h in heads for m in markers):
        raise ValueError("markers must differ, and no first character of one may stand further on in any")
    return markers


def fill_in_middle(
    docs: DataFrame, column: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE,
    spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of those suffix first; the draws come
    from ``seed`` and ``key`` alone, so reruns and repeated rows agree. A null text is the empty text,
    which has no unit and stays plain, as does a text that holds a marker; both lengths are null
    there. A null key draws as the empty key. The added columns replace columns of the same names.
    Memory of a task: the ends of one text's units.
    """
    prefix_mark, suffix_mark, middle_mark = _checked(markers)
    text = text_of(column)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    frame = docs.withColumn("_fm_text", text).withColumn("_fm_draw", drawn)
    frame = frame.withColumn("_fm_cut", _cut_points("_fm_text", _draw(F.col("_fm_draw"), 0), _draw(F.col("_fm_draw"), 1)))
    text, draw, cut = F.col("_fm_text"), F.col("_fm_draw"), F.col("_fm_cut")
    marked = F.lit(False)
    for mark in markers:
        marked = marked | F.contains(text, F.lit(mark))
    form = (
        F.when((text == "") | marked | (_draw(draw, 2) % 100 >= rate), F.lit("plain"))
        .when(_draw(draw, 3) % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm")))
    begin, middle = cut["prefix"].cast("int"), cut["middle"].cast("int")
    prefix = F.substring(text, F.lit(1), begin)
    centre = F.substring(text, begin + 1, middle)
    suffix = F.substring(text, begin + middle + 1, F.length(text))
    psm = F.concat(F.lit(prefix_mark), prefix, F.lit(suffix_mark), suffix, F.lit(middle_mark), centre)
    spm = F.concat(F.lit(suffix_mark), suffix, F.lit(prefix_mark), prefix, F.lit(middle_mark), centre)
    kind = F.col("form")
    return frame.withColumn("form", form).withColumns({
        "n": cut["n"],
        "prefix_chars": F.when(kind != "plain", cut["prefix"]),
        "middle_chars": F.when(kind != "plain", cut["middle"]),
        "output": F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(text),
    }).drop("_fm_text", "_fm_draw", "_fm_cut")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before the transformation, from its output and form alone.

    The first character of a marker stands nowhere else in a marker, so the first place a marker is
    found at is its own, whatever the text around it looks like.
    """
    prefix_mark, suffix_mark, middle_mark = _checked(markers)

    def parts(out: Column, first: str, second: str) -> tuple[Column, Column, Column]:
        two, three = F.locate(second, out), F.locate(middle_mark, out)
        begin = len(first) + 1
        behind = two + len(second)
        return (
            F.substring(out, F.lit(begin), two - begin), F.substring(out, behind, three - behind),
            F.substring(out, three + len(middle_mark), F.length(out)))

    def psm(out: Column) -> Column:
        prefix, suffix, middle = parts(out, prefix_mark, suffix_mark)
        return F.concat(prefix, middle, suffix)

    def spm(out: Column) -> Column:
        suffix, prefix, middle = parts(out, suffix_mark, prefix_mark)
        return F.concat(prefix, middle, suffix)

    return F.when(form == "psm", bound(output, psm)).when(form == "spm", bound(output, spm)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(docs.select("doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), u AS (
  SELECT *, string_split(t, chr(10)) AS l,
    len(string_split(t, chr(10))) - CASE WHEN t = '' OR t[-1] = chr(10) THEN 1 ELSE 0 END AS n,
    CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
    CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, least(length(t), CAST(coalesce(list_sum(list_transform(l[1:a], lambda x: length(x) + 1)), 0) AS BIGINT)) AS pre,
    least(length(t), CAST(coalesce(list_sum(list_transform(l[1:b], lambda x: length(x) + 1)), 0) AS BIGINT)) AS fin
  FROM c
), o AS (
  SELECT *, substr(t, 1, pre) AS prefix, substr(t, pre + 1, fin - pre) AS middle, substr(t, fin + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(pre AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(fin - pre AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
