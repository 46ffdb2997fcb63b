"""Text and author expressions. All are built-in column expressions inside codegen."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.config import DELETED

# The characters the text rules count as whitespace and as word characters.
# They are spelled out because the JVM classes \s, \w and \b cover other sets.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"

# Regular-expression characters that are literal inside a keyword.
LITERAL_IN_KEYWORD = ".^$*+?{}[]\\|()"


def clean_author(author: Column, numeric: bool = False) -> Column:
    """Missing authors become ``[deleted]``; for numeric sources NaN and 0 are missing too."""
    if numeric:
        known = author.isNotNull() & ~F.isnan(author.cast("double")) & (author != F.lit(0))
        return F.when(known, author.cast("string")).otherwise(F.lit(DELETED))
    return F.coalesce(F.nullif(author.cast("string"), F.lit("")), F.lit(DELETED))


def collapse_spaces(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed. Lone plain spaces are not matched at all.

    A visible ASCII character, and a space before one, are passed over by one comparison; only what is
    left is looked up among the ranges of whitespace.
    """
    return F.trim(F.regexp_replace(text, f"(?![!-~])(?! [!-~])(?: [{SPACE}]+|(?! )[{SPACE}]+)", " "))


def epoch_to_timestamp(created: Column) -> Column:
    """Seconds since 1970 (fractions allowed) to a UTC timestamp; unreadable values to null."""
    seconds = created.cast("string").try_cast("double")
    # Fixed value: the range a nanosecond clock can hold; anything outside is unreadable.
    readable = seconds.between(-9223372036.0, 9223372036.0)
    return F.when(readable, F.timestamp_seconds(seconds))


def activity_text(kind: Column, title: Column, selftext: Column, body: Column) -> Column:
    """Posts read title and body text, comments their body; whitespace runs become one space."""
    post = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(selftext, F.lit("")))
    chosen = F.when(kind == "post", post).when(kind == "comment", F.coalesce(body, F.lit("")))
    return collapse_spaces(F.coalesce(chosen, F.lit("")))


def _mask(text: Column, marker: str, pattern: str, placeholder: str) -> Column:
    """Replace a pattern; a byte search for ``marker`` spares most texts the regular expression."""
    return F.when(text.contains(marker), F.regexp_replace(text, pattern, placeholder)).otherwise(text)


def add_norm_text(rows: DataFrame, text: str = "text", out: str = "norm_text") -> DataFrame:
    """Lower case, links and user mentions replaced by a placeholder, whitespace collapsed.

    One column per step: a step is used twice by the next one, and Spark computes a column once
    but an inlined expression as often as it is mentioned.
    """
    lowered = rows.withColumn("_lowered", F.lower(F.coalesce(text, F.lit("None"))))
    no_links = lowered.withColumn(
        "_no_links", _mask(F.col("_lowered"), "http", f"https?://[^{SPACE}]+", " URL ")
    )
    no_users = no_links.withColumn(
        "_no_users", _mask(F.col("_no_links"), "u/", f"u(?<![{WORD}]u)/[{WORD}]+", " USER ")
    )
    return no_users.withColumn(out, collapse_spaces(F.col("_no_users"))).drop("_lowered", "_no_links", "_no_users")


def escape_keyword(word: str) -> str:
    return "".join("\\" + c if c in LITERAL_IN_KEYWORD else c for c in str(word))


def topic_pattern(words) -> str:
    """One alternation in which every keyword carries its own word boundaries.

    A boundary next to a word character means "no word character beyond"; next to any other
    character it means "a word character beyond". The check of the left side comes after the
    keyword, so that most positions fail on its first letter, looked up among all first letters.
    """

    def sign(char: str) -> str:
        return "!" if re.match(r"\w", char) else "="

    parts, firsts = [], set()
    for word in map(str, words):
        if not word:
            raise ValueError("keywords must not be empty")
        literal = escape_keyword(word)
        parts.append(f"{literal}(?<{sign(word[0])}[{WORD}]{literal})(?{sign(word[-1])}[{WORD}])")
        firsts.add(word[0] if word[0].isalnum() else "\\" + word[0])
    return f"(?=[{''.join(sorted(firsts))}])(?:{'|'.join(parts)})"


# Up to so many keywords a byte search for each is cheaper than cutting the text into words.
SCANNED_KEYWORDS = 32


def topic_hit(text: Column, words) -> Column:
    """True where the lower-cased text holds one of the keywords as a whole word.

    A few keywords are searched for one by one, which spares most texts the regular expression. Of
    many, a text's words are looked up in one set, so the cost does not grow with their number: a
    keyword without other characters is a hit itself; of every other the longest word must be among
    the text's words before the regular expression is tried.
    """
    lowered, words = F.lower(text), list(map(str, words))
    if len(words) <= SCANNED_KEYWORDS:
        return F.coalesce(_searched(lowered, words), F.lit(False))
    runs = {w: re.findall(r"\w+", w) for w in words}
    plain = [w for w in words if runs[w] == [w]]
    phrases = [w for w in words if runs[w] and runs[w] != [w]]
    bare = [w for w in words if not runs[w]]
    firsts = sorted({max(runs[w], key=len) for w in phrases})

    def among(tokens: Column) -> Column:
        hit = F.exists(tokens, lambda t: t.isin(plain))
        if phrases:
            hit = hit | (F.exists(tokens, lambda t: t.isin(firsts)) & lowered.rlike(topic_pattern(phrases)))
        return hit

    # Bound to a lambda variable, the words are cut once for both look-ups.
    hit = F.transform(F.array(F.split(lowered, f"[^{WORD}]+")), among)[0]
    return F.coalesce(hit | _searched(lowered, bare) if bare else hit, F.lit(False))


def _searched(lowered: Column, words: list[str]) -> Column:
    def some(found: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, found)

    # Between two spaces a keyword that starts and ends with word characters is a whole word.
    plain = [w for w in words if re.match(r"\w", w[:1]) and re.match(r"\w", w[-1:])]
    matched = lowered.rlike(topic_pattern(words))
    between = [lowered.contains(F.lit(f" {w} ")) for w in plain]
    return some([lowered.contains(F.lit(w)) for w in words]) & some([*between, matched])
