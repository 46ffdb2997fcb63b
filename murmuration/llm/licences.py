"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and looked up among known licence sentences. A
line end may end a sentence (one-line notices and titles) or wrap it, so a known sentence may run
over any number of lines. The identifiers found, in the order of the text, are matched against
ordered licence rules; a rule matches where its identifiers follow one another. All of it is one
projection: no shuffle, no Python, and a long text costs its own row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import bound, text_of

# Known sentences by identifier (fixed texts of public licences and notices).
SENTENCES = {
    "apache-notice": ("licensed under the apache license, version 2.0", "licensed under the apache license, version 2.0 (the license)"),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "mit license", "the mit license (mit)"),
    "mit-grant": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the software), to deal in the software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and "
        "to permit persons to whom the software is furnished to do so, subject to the following conditions",),
    "mit-keep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is, without warranty of any kind, express or implied, including but not limited to the "
              "warranties of merchantability, fitness for a particular purpose and noninfringement",),
    "gpl3-notice": ("this work is licensed under the gnu general public license, version 3", "licensed under the gnu general public license, version 3"),
    "gpl-free": ("this program is free software",),
    "gpl-any": ("you can redistribute it and/or modify it under the terms of the gnu general public license as published by the "
                "free software foundation, either version 3 of the license, or (at your option) any later version",),
    "bsd-redistribute": ("redistribution and use in source and binary forms, with or without modification, are permitted provided "
                         "that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "cc-by-nc-notice": ("licensed under cc by-nc 4.0", "licensed under cc by-nc 4.0 international"),
    "cc-by-notice": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "reserved": ("all rights reserved",),
}

# (licence, identifiers in the order of the text); the first rules are the more specific ones.
RULES = (
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-any")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("BSD", ("bsd-redistribute", "bsd-source")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("proprietary", ("reserved",)),
)

# The SQL counterpart knows sentences of one line only: it ends one at a line end or after . ; : ! ?
# followed by white space or the end.
BREAK = r"[\n\r]+|[.;:!?]+(?:[\x20\x09-\x0D]+|$)"
JUNK = r"[^a-z0-9]+"

# Line ends with the blanks and comment marks around them, in lower-cased text.
_MARKS = r"\x20\x09\x0B\x0C/*#;%!|<>=~-"
LINE_END = rf"(?:(?<![{_MARKS}])[\x20\x09][{_MARKS}]*)?\n[^a-z0-9\n]*"
# A web address set apart by blank lines goes on with the sentence before it.
SET_APART = r"\n\n+(?=https?://)"
STOP = r"[.;:!?](?=[\x20\x09-\x0D]|$)"


def normalised(sentence: str) -> str:
    """The form sentences are compared in: lower-case a-z and digits, single spaces."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


def known_sentences(sentences=None) -> dict[str, str]:
    """Normalised sentence to identifier."""
    listed = SENTENCES if sentences is None else sentences
    return {normalised(text): name for name, texts in listed.items() for text in texts}


def _marked(text: Column) -> Column:
    """The normalised text between marks: H where a sentence ends, S at a line end that may end or wrap one.

    The text is lower case, so capitals are free. A blank line, or one of marks only, ends a sentence.
    """
    steps = ((r"\r\n?", "\n"), (LINE_END, "\n"), (SET_APART, "\n"), (STOP, " H "), (r"\n\n+", " H "), (r"\n", " S "))
    out = F.lower(text)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(F.concat(F.lit("H "), out, F.lit(" H")), "[^a-z0-9HS]+", " ")


def sentence_ids(text: Column, sentences=None) -> Column:
    """Identifiers of the known sentences of a text, in order; of several from one place the longest."""
    known = known_sentences(sentences)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    wrapped = "|".join(k.replace(" ", "(?: S)? ") for k in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(_marked(text), F.lit(f"(?<=[HS] )(?:{wrapped})(?= [HS])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, " S ", " ")))


def matched_rules(ids: Column, rules=RULES) -> Column:
    """Licences whose identifiers follow one another in ``ids``, each once, in the order of the rules.

    Of several rules of one licence any will do.
    """
    line = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    found = [F.when(F.contains(line, F.lit("|" + "|".join(parts) + "|")), F.lit(name)) for name, parts in rules]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def scan(docs: DataFrame, column: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """``docs`` with sentence_ids (array) and licences (array).

    Null and empty texts have neither. Repeated rows get the same result. Columns of those names
    in ``docs`` are replaced.
    """
    ids = sentence_ids(text_of(column), sentences)
    both = bound(ids, lambda x: F.struct(x.alias("ids"), matched_rules(x, rules).alias("licences")))
    return docs.withColumn("_mm_found", both).withColumns(
        {"sentence_ids": F.col("_mm_found.ids"), "licences": F.col("_mm_found.licences")}).drop("_mm_found")


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in known_sentences().items())
    ruled = ", ".join(f"CASE WHEN contains(line, '|{'|'.join(p)}|') THEN '{n}' END" for n, p in RULES)
    longest = max(len(k) for k in known_sentences()) * 2
    return rf"""
WITH known(sentence, id) AS (VALUES {rows}), d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_split_to_array(coalesce(text, ''), '{BREAK}') AS s FROM documents
), p AS (
  SELECT k, i, trim(regexp_replace(lower(s[i]), '{JUNK}', ' ', 'g')) AS sentence
  FROM (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM d) WHERE length(s[i]) BETWEEN 3 AND {longest}
), f AS (
  SELECT k, list(id ORDER BY i) AS ids FROM p JOIN known USING (sentence) GROUP BY k
), l AS (
  SELECT doc_id, coalesce(ids, []) AS ids, '|' || array_to_string(coalesce(ids, []), '|') || '|' AS line FROM d LEFT JOIN f USING (k)
), r AS (SELECT *, list_filter([{ruled}], lambda x: x IS NOT NULL) AS found FROM l)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentences,
  array_to_string(list_transform(list_filter(found, lambda x, i: list_position(found, x) = i), lambda x: x), ',') AS licences
FROM r
"""


ORACLE = _sql()
