"""Fill-in-the-middle against a plain version that walks over the lines."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuration.llm import fill_middle as M

from .conftest import prose


def units(text):
    out = []
    for part in text.split("\n"):
        out.append(part + "\n")
    out[-1] = out[-1][:-1]
    return out if out[-1] else out[:-1]


def plain_version(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = units(text)
    draw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(lines), "plain", None, None, text)
    if h[3] % 100 < spm_rate:
        return (doc_id, len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ODD = [
    (20, "\n", None, None, None), (21, "\n\n\n", None, None, None), (22, "one line", None, None, None),
    (23, "a\nb", None, None, None), (24, "a\n<P>b\n", None, None, None), (25, "x<\n<\nS>\n<", None, None, None),
    (26, "é𓀀\r\n\x0b\n z\n𓀀𓀀", None, None, None), (27, "line\n" * 50_000, None, None, None),
    (28, "<", None, None, None), (29, "no end " * 20_000, None, None, None),
]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 0), (100, 100)])
def test_same_as_walking_over_the_lines(docs, odd_rows, rate, spm_rate):
    rows = odd_rows + ODD + [(i, prose(i, 60).replace("the", "\n"), "en", "a", 1) for i in range(30, 60)]
    got = M.fill_in_middle(docs(rows), rate=rate, spm_rate=spm_rate)
    got = got.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    want = sorted(map(repr, (plain_version(r[0], r[1], rate=rate, spm_rate=spm_rate) for r in rows)))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == want
    assert all(r["back"] == (r["text"] or "") for r in got)
    if (rate, spm_rate) == (100, 50):
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query_columns_and_hashes(docs, odd_rows):
    rows = odd_rows + ODD
    got = M.digest(docs(rows))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"),
        ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(r[1] or "")) for r in rows for p in [plain_version(r[0], r[1])]]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a<\nSP>M\r é𓀀", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_stand_at_unit_ends(text, one, other):
    lines = units(text)
    a, b = sorted((one % (len(lines) + 1), other % (len(lines) + 1)))
    before = len("".join(lines[:a]))
    assert M.cuts(text, one, other) == (len(lines), before, len("".join(lines[:b])) - before)


def test_empty_table_clashing_columns_and_markers(docs, clashing):
    assert M.digest(docs([])).collect() == []
    wide = clashing.selectExpr("*", "'x' AS form", "1 AS output", "2 AS prefix")
    got = M.fill_in_middle(wide)
    assert len(got.columns) == len(set(got.columns)) and got.count() == wide.count()
    with pytest.raises(ValueError):
        M.fill_in_middle(docs([]), markers=("<P>", "<S><", "<M>"))
    own = ("[p]", "[s]", "[m]")
    texts = docs([(i, "[\n[p\n[s[\nm]\n" + prose(i, 9), "en", "a", 1) for i in range(20)])
    got = M.fill_in_middle(texts, markers=own).withColumn("back", M.restored(F.col("output"), F.col("form"), own))
    assert got.where("back <> text").count() == 0 and got.where("form <> 'plain'").count() == 20
