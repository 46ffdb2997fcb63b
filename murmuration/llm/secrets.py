"""Secret scans with multipart credential linking, in DataFrame operations only.

Single patterns give the base spans. Weak candidates (short passwords, long key-like strings,
identifiers, endpoints) say little alone; an interval join inside the document reports a weak
secret only where an identifier or an endpoint stands within reach of it. The join never forms
pairs: parts are summed up per (document, bin) as the least start and greatest end of those that
touch the bin, which is enough to know whether a complement lies within one bin's width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import besides, bound, text_of
from murmuration.session import write_stage

# Fixed patterns of the base rule, with the least length of the match or of its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# Weak parts: (kind, role, pattern). A span covers the whole value, however long.
WEAK = (
    ("weak_pass", "secret", r"""(?i:password|passwd|pwd|pass)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,}"""),
    ("weak_key", "secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"),
)
COMPLEMENTS = (
    ("identifier", r"AKIA[A-Z0-9]{12,}|(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"),
    ("endpoint", r"(?i:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis)://[^\x20\x09-\x0D\"'<>]{3,}|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{3,}"),
)
REACH = 200
# Matches of one text that are laid out together.
BLOCK = 128
KINDS = ("assign", "access", "hex", *(w[0] for w in WEAK))

SPAN = "array<struct<start:int,end:int,kind:string>>"


def _blocks(items: Column) -> Column:
    """A non-empty array cut into arrays of ``BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda i: F.slice(items, i + 1, BLOCK))


def _before(blocks: Column, step) -> Column:
    """The value that each block starts with: 0, then ``step(value, element)`` over all elements before."""
    return F.slice(F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), step)))), 1, F.size(blocks))


def _by_blocks(items: Column, step, made, kind: str, then) -> Column:
    """``made(value, element)`` for all elements in order, where ``step`` carries the value on.

    An array that grows inside ``aggregate`` is copied for each element, so it grows by blocks: the
    value at each block's start first, then the blocks on their own. ``then`` reads each block's results.
    """
    none = F.array().cast(f"array<{kind}>")

    def run(blocks):
        pairs = F.arrays_zip(blocks.alias("items"), _before(blocks, step).alias("at"))
        return F.flatten(F.transform(pairs, lambda b: bound(F.aggregate(
            b["items"], F.struct(b["at"].alias("at"), none.alias("all")),
            lambda acc, x: F.struct(
                step(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(made(acc["at"], x))).alias("all")),
            lambda acc: acc["all"]), then)))

    return bound(items, lambda given: bound(_blocks(given), run))


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches: the text between matches gives the places.

    ``keep(match)`` drops matches; offsets count code points, ends are exclusive.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)

    def placed(matches):
        lengths = F.transform(matches, lambda m: F.length(m))
        gaps = F.slice(F.transform(between, lambda b: F.length(b)), 1, F.size(matches))
        return _by_blocks(
            F.arrays_zip(matches.alias("m"), lengths.alias("n"), gaps.alias("g")),
            lambda at, x: at + x["g"] + x["n"],
            lambda at, x: F.struct(
                (at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["m"].alias("m")),
            "struct<start:int,end:int,m:string>",
            lambda found: F.transform(
                found if keep is None else F.filter(found, lambda x: keep(x["m"])),
                lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))))

    none = F.array().cast(SPAN)
    return F.when(~text.rlike(pattern), none).otherwise(bound(found, lambda m: placed(m)))


def _value_long(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LEAST


def base_spans(text: Column) -> Column:
    """Array of (start, end, kind) of the base patterns, by start and then kind as listed."""
    every = F.concat(
        _spans(text, ASSIGN, "assign", _value_long), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    return _ordered(every)


def _ordered(spans: Column) -> Column:
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    # Equal spans are neighbours once sorted.
    first = lambda every: F.filter(every, lambda s, i: (i == 0) | (s != F.get(every, i - 1)))
    return F.transform(
        bound(F.sort_array(keyed), first), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def weak_parts(text: Column) -> tuple[Column, Column]:
    """Weak secrets and the complements (identifiers, endpoints) that could back them."""
    weak = F.concat(*[_spans(text, p, k) for k, _, p in WEAK])
    backing = F.concat(*[_spans(text, p, k) for k, p in COMPLEMENTS])
    return weak, backing


def linked_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, added): weak secrets with a complement at most ``reach`` code points away, from span to span.

    ``parts`` has key, base, weak and backing. A complement that a base span or the candidate
    itself covers whole does not count as a second part; an access identifier among the base spans
    is a part. Complements are summed up in every bin of ``reach`` code points that they touch. One
    that begins before the candidate does and is near enough touches the bin of the candidate's
    start or the bin before; one that ends behind the candidate, that of its end or the bin after.
    """
    both = parts.where((F.size("weak") > 0) & ((F.size("backing") > 0) | (F.size("base") > 0)))
    known = F.filter("base", lambda s: s["kind"] == "access")
    inside = lambda b, s: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
    backing = both.select("key", "base", F.explode(F.concat("backing", known)).alias("s"))
    backing = backing.where(~F.exists("base", lambda b: (b["kind"] != "access") & inside(b, F.col("s"))))
    bin_of = lambda at: F.floor(at / reach)
    bins = backing.select("key", "s", F.explode(F.sequence(bin_of(F.col("s.start")), bin_of(F.col("s.end")))).alias("bin")).groupBy(
        "key", "bin").agg(F.min("s.start").alias("first"), F.max("s.end").alias("last"))
    weak = both.select("key", "base", F.explode("weak").alias("s"))
    weak = weak.where(~F.exists("base", lambda b: inside(b, F.col("s")))).select("key", "s")
    start, end = F.col("s.start"), F.col("s.end")
    sides = ((bin_of(start), -1), (bin_of(start), 0), (bin_of(end), 0), (bin_of(end), 1))
    near = weak.select("key", "s", F.posexplode(F.array(*[own + i for own, i in sides])).alias("side", "bin"))
    hits = near.join(bins, ["key", "bin"]).where(
        ((F.col("side") == 0) & (start - F.col("last") <= reach))
        | ((F.col("side") == 1) & (F.col("first") < start))
        | ((F.col("side") == 2) & (F.col("last") > end))
        | ((F.col("side") == 3) & (F.col("first") - end <= reach))
    )
    return hits.groupBy("key").agg(F.collect_set("s").alias("added"))


def scan(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with base (array of spans) and spans (base and linked weak ones, in order).

    A null text is the empty text and has no spans. Spans of different kinds may overlap; the
    method only adds to the base spans. Repeated rows get the same spans. Kept columns named like
    a result give way to it.
    """
    keep = besides(keep, ("base", "spans"))
    return _scanned(docs, column, keep).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "base", "spans")


def _scanned(docs: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns under numbered names, with base and spans."""
    found = write_stage(_parts(docs, column, keep), "secrets")
    names = [f"_{i}" for i in range(len(keep))]
    added = linked_weak(found.select("key", "base", "weak", "backing").distinct())
    lonely = (F.size("weak") == 0) | ((F.size("backing") == 0) & (F.size("base") == 0))
    plain = found.where(lonely).select(*names, "base", F.col("base").alias("spans"))
    joined = found.where(~lonely).join(added, "key", "left").select(
        *names, "base", _ordered(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))
    return plain.unionByName(joined)


def _parts(docs: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    text = text_of(column)
    weak, backing = weak_parts(text)
    first = F.coalesce(F.col(keep[0]).cast("string"), F.lit("")) if keep else F.lit("")
    return docs.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)],
        F.md5(F.concat(first, F.lit(":"), text).cast("binary")).alias("key"),
        base_spans(text).alias("base"), weak.alias("weak"), backing.alias("backing"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<kind>``; overlapping spans are masked as one.

    ``spans`` is not empty. A block of spans reads its own stretch of the text, since reaching a
    place in a text costs its distance from the start.
    """
    reach = lambda at, s: F.greatest(at, s["end"])

    def piece(part, origin, at, s):
        """What a span adds: the text since the last one and its mark, or nothing inside a masked stretch."""
        return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(
            F.substring(part, at - origin + 1, s["start"] - at), F.lit("<"), s["kind"], F.lit(">")))

    def one(b):
        stretch = F.substring(text, b["at"] + 1, F.greatest(F.lit(0), F.element_at(b["items"], -1)["start"] - b["at"]))
        walk = lambda part: F.aggregate(
            b["items"], F.struct(b["at"].alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                reach(acc["at"], s).alias("at"), F.concat(acc["out"], piece(part, b["at"], acc["at"], s)).alias("out")),
            lambda acc: acc["out"])
        return bound(stretch, walk)

    def run(blocks):
        pairs = F.arrays_zip(blocks.alias("items"), _before(blocks, reach).alias("at"))
        return F.array_join(F.transform(pairs, one), "")

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(bound(spans, lambda given: bound(_blocks(given), run)), F.substring(text, end + 1, F.length(text)))


def mask_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the spans of ``scan`` masked; a null text stays null, columns stay as they are."""
    names = docs.columns
    found = _scanned(docs, column, tuple(names))
    numbered = [(F.col(f"_{i}"), c) for i, c in enumerate(names)]
    return found.select(*[
        (F.when(F.size("spans") > 0, masked(v, F.col("spans"))).otherwise(v) if c == column else v).alias(c) for v, c in numbered])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
