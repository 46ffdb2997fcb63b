"""N-gram Jaccard join over tries of globally ordered shingle sets.

All shingles have one global order: those found in many documents last, by count, the others by
hash. Two sets that are similar enough share a shingle among the first few of both (prefix
filter), so only those travel. Texts with equal sets are one class and travel as one.

Candidates are verified leader by leader: a block of members is stored as a trie of its whole
ordered sets (frequent first, so that near copies share their path), and the leader's set is run
down the trie. The overlap of a path is computed once for all members behind it, and a subtree is
left as soon as the shingles that remain cannot reach the needed overlap.

Pairs are only formed for shingles of a few classes. In the group of a common shingle all members
are compared with leaders first, and so are a class's best pairs of rare shingles; what is found linked
is merged. A second pass takes what is still in different components: the other pairs of rare shingles,
and classes that run down tries of blocks of the larger component and stop at their first hit, as one
link joins both. So every link between different components is found, while a group of thousands of near
copies never meets pair by pair. Before sets travel, a pair of rare shingles must share a number of its
first shingles that follows from both sizes. What travels is the packed text, of which a word takes
fewer bytes than the number of a shingle; a block makes the sets of its texts anew. In the second pass the place of a common shingle must leave
room for the overlap: the first common shingle of a similar pair always does, and a passage that many
different texts share, ordered last, does not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import small_batches, text_of
from murmuration.operators.components import connected_components
from murmuration.session import discard, write_stage

SHINGLE = 5
PERCENT = 75
# Bounds of what is broadcast: frequent shingles (16 bytes each) and the bits of the filter that
# keeps sets without a partner at home. Neither decides about a link.
FREQUENT = 1 << 17
FILTER_BITS = 1 << 25
CHUNK = 1 << 20
BLOCK = 128
# A shingle of at most so many classes makes all their pairs; beyond, leaders come first.
CROWD = 16
# Leaders of a group of many, and partners a class meets among those of rare shingles, in the first pass.
LEADERS, PARTNERS = 8, 2
# The bits of a number of the postings that hold the place.
PLACE = 0xFFFF
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_PLACES = _mixed(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Distinct hashed shingles of every text of an Arrow column, sorted by hash.

    Works on the UTF-8 bytes of all texts at once: a word's hash is the mixed sum of its bytes'
    numbers times a number of their place, a shingle's the mixed sum over its words. A shorter
    text is one shingle, a text without words none.
    """
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return [np.zeros(0, dtype=np.int64)] * len(column)
    folded = _FOLD[raw]
    solid = ~_SPACES[folded]
    first = solid.copy()
    # A word starts after a space or where a text starts.
    inner = solid[:-1].copy()
    heads = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    inner[heads - 1] = False
    first[1:] &= ~inner
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, dtype=np.int64)] * len(column)
    at = np.flatnonzero(solid)
    begin = np.searchsorted(at, starts)
    sizes = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    longest = int(place.max()) + 1
    numbers = _mixed(np.arange(5001, 5001 + longest, dtype=np.uint64) * _STEP) | np.uint64(1)
    words = _mixed(np.add.reduceat(_BYTES[folded[at]] * numbers[place], begin) + sizes.astype(np.uint64))
    bounds = np.searchsorted(starts, ends)
    runs = np.zeros(max(len(words) - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        runs += words[k:k + len(runs)] * _PLACES[k]
    runs = _mixed(runs).view(np.int64)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SHINGLE:
            sets.append(np.unique(runs[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            few = words[lo:hi]
            sets.append(_mixed(((few * _PLACES[:len(few)]).sum(keepdims=True) + np.uint64(len(few)))).view(np.int64))
        else:
            sets.append(np.zeros(0, dtype=np.int64))
    return sets


def class_of(shingles: np.ndarray) -> int:
    """One number for a set: the mixed sum of its members and its size."""
    total = _mixed(shingles.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(_mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def needed_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection with 100 * intersection >= percent * union for sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Trie:
    """Path-compressed trie of sequences added in sorted order, each with its label."""

    __slots__ = ("part", "below", "ends", "short", "long")

    def __init__(self, part: list[int]):
        self.part, self.below, self.ends = part, [], []
        self.short, self.long = math.inf, 0

    @classmethod
    def build(cls, sequences: list[tuple[list[int], object]]) -> Trie:
        root = cls([])
        for sequence, label in sorted(sequences, key=lambda s: s[0]):
            node, at = root, 0
            while True:
                node.short, node.long = min(node.short, len(sequence)), max(node.long, len(sequence))
                # Sorted order: only the child added last can share anything.
                child = node.below[-1] if node.below and at < len(sequence) and node.below[-1].part[0] == sequence[at] else None
                if child is None:
                    break
                same = 0
                for a, b in zip(child.part, sequence[at:at + len(child.part)]):
                    if a != b:
                        break
                    same += 1
                if same < len(child.part):
                    upper = cls(child.part[:same])
                    upper.below, upper.short, upper.long = [child], child.short, child.long
                    child.part = child.part[same:]
                    node.below[-1] = upper
                    child = upper
                node, at = child, at + same
            if at < len(sequence):
                leaf = cls(sequence[at:])
                leaf.short = leaf.long = len(sequence)
                node.below.append(leaf)
                node = leaf
            node.ends.append((label, len(sequence)))
        return root

    def similar(self, probe: frozenset, percent: int = PERCENT) -> Iterator[tuple[object, int]]:
        """(label, overlap) of the sequences similar enough to the probe."""
        n = len(probe)
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            needed = needed_overlap(n, int(node.short), percent) if node.long else 0
            left = node.long - depth
            if overlap + left < needed or 100 * n < percent * node.short or 100 * node.long < percent * n:
                continue
            cut = False
            for token in node.part:
                left -= 1
                if token in probe:
                    overlap += 1
                elif overlap + left < needed:
                    cut = True
                    break
            if cut:
                continue
            for label, length in node.ends:
                if overlap >= needed_overlap(n, length, percent):
                    yield label, overlap
            stack.extend((child, overlap, depth + len(node.part)) for child in node.below)


class Order:
    """The global order of shingles, from the frequent ones and their counts."""

    def __init__(self, frequent: np.ndarray, ranks: np.ndarray):
        self.frequent, self.ranks = frequent, ranks

    def sort(self, hashes: np.ndarray) -> np.ndarray:
        """The shingles of a set, rare first."""
        hashes = np.sort(hashes)
        if not len(self.frequent) or not len(hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        often = self.frequent[at] == hashes
        late = hashes[often]
        return np.concatenate([hashes[~often], late[np.argsort(self.ranks[at[often]], kind="stable")]])


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its class and size; per chunk the shingles of several texts, with their number."""
    held, size = [], 0

    def counted():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        found, n = found[n > 1], n[n > 1]
        void = pa.nulls(len(found))
        return pa.RecordBatch.from_arrays(
            [void.cast(kind), void.cast(pa.int64()), void.cast(pa.int64()), pa.array(found), pa.array(n)], names=names)

    names, kind = ["doc_id", "n_shingles", "cls", "shingle", "n"], pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        sets = shingle_sets(batch.column("text"))
        held += sets
        size += sum(map(len, sets))
        void = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([class_of(x) for x in sets], pa.int64()), void, void],
            names=names)
        if size >= CHUNK:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def global_order(counts: DataFrame) -> Order:
    """Order with the most frequent shingles last.

    Every chunk of about a million shingles, of all documents, reports those it holds more than
    once, so a shingle in more documents than there are chunks cannot be missed. The order only
    decides how much work there is, never what is found.
    """
    summed = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    hashes, n = top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    by = np.lexsort((hashes, n))
    ranks = np.empty(len(by), dtype=np.int64)
    ranks[by] = np.arange(len(by))
    at = np.argsort(hashes)
    return Order(hashes[at], ranks[at])


def _postings(order, percent: int):
    """The first shingles of every class, 48 bits of a shingle and its place in one number, and its size.

    Fewer bits can only add candidates; so can a place beyond 65,535, which counts as that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            spots, owners, sizes = [], [], []
            for own in shingle_sets(batch.column("text")):
                cls = class_of(own)
                if not len(own) or cls in seen:
                    continue
                if len(seen) < CHUNK:
                    seen.add(cls)
                k = prefix_length(len(own), percent)
                place = np.minimum(np.arange(k, dtype=np.int64), PLACE)
                spots.append((order.value.sort(own)[:k] & ~PLACE) | place)
                owners.append(np.full(k, cls))
                sizes.append(np.full(k, len(own)))
            if spots:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (spots, owners, sizes)], names=["spot", "cls", "size"])
    return run


def _spot(cls, doc_id, salt: int) -> np.ndarray:
    turn = _mixed(np.array([salt], dtype=np.uint64) * _STEP)
    mixed = _mixed(cls.astype(np.int64).view(np.uint64) ^ _mixed(doc_id.astype(np.int64).view(np.uint64) + turn))
    return (mixed % np.uint64(FILTER_BITS)).astype(np.int64)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, first = batch.column("cls").to_numpy(), batch.column("first").to_numpy()
        spot = np.unique(np.concatenate([_spot(cls, first, salt) for salt in (1, 2)]))
        word, at = np.unique(spot >> 5, return_index=True)
        bits = np.bitwise_or.reduceat(np.int64(1) << (spot & 31), at) if len(at) else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])


def _filter_words(chosen: DataFrame) -> np.ndarray:
    """Filter of the (class, first document) pairs whose sets are needed: FILTER_BITS / 32 words at most."""
    found = chosen.mapInArrow(_spots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return words


def _packed_texts(words):
    """The packed texts of sets that pass the filter; it may let a few more through, which no pair asks for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            cls = np.array([class_of(x) for x in sets], dtype=np.int64)
            hit = np.array([len(x) > 0 for x in sets], dtype=bool)
            for salt in (1, 2):
                spot = _spot(cls, batch.column("number").to_numpy(), salt)
                hit &= (words.value[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1 == 1
            # Copies with one number pass together; a task writes a class once.
            at = np.array([i for c, i in {cls[i]: i for i in np.flatnonzero(hit)}.items() if c not in seen], dtype=np.int64)
            if len(seen) < CHUNK:
                seen.update(cls[at].tolist())
            if len(at):
                texts = batch.column("text").cast(pa.large_binary())
                packed = [zlib.compress(texts[i].as_py(), 6) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(packed, pa.binary())], names=["cls", "packed"])
    return run


def _unpacked(packed: Iterable[bytes], order: Order) -> Iterator[list[int]]:
    """The set of every packed text, frequent shingles first. About a million bytes are read at once."""
    held, size = [], 0

    def ordered():
        return [order.sort(x)[::-1].tolist() for x in shingle_sets(pa.array(held, pa.binary()))]

    for part in packed:
        held.append(zlib.decompress(part))
        size += len(held[-1])
        if size >= CHUNK:
            yield from ordered()
            held, size = [], 0
    if held:
        yield from ordered()


def _pair_blocks(pairs: DataFrame) -> DataFrame:
    """(label, block, cls, hits) of pairs (leader, member): a leader asks blocks of its members for all hits.

    A leader's members are dealt into blocks of about BLOCK. Numbers of blocks are negative here.
    """
    many = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.lit(-1) - F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    held = pairs.join(many, "leader").select(
        F.col("leader").alias("label"), block.alias("block"), F.col("member").alias("cls"), F.lit(0).alias("hits"))
    asked = many.select(F.col("leader").alias("label"), F.explode(F.sequence(F.lit(-1), -F.col("blocks"), F.lit(-1))).alias("block"))
    return held.unionByName(asked.select("label", "block", F.col("label").alias("cls"), F.lit(1 << 30).alias("hits")))


def _routes(*blocks: DataFrame) -> DataFrame:
    """The rows (label, block, cls, hits) of all blocks with the part of a block they go to, written.

    A row with hits asks, one without is held. A block is copied where more than a few blocks' worth
    of rows ask it. Written, this table of numbers has a known size when the sets join it.
    """
    rows = reduce(DataFrame.unionByName, blocks)
    parts = rows.where("hits > 0").groupBy("label", "block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("parts"))
    own = F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("hits") > 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    return write_stage(rows.join(parts, ["label", "block"]).select("label", "block", "cls", "hits", part.alias("part")), "routes")


def _verify(routes: DataFrame, texts: DataFrame, order, percent: int) -> DataFrame:
    """(source, target): at most ``hits`` links for each row that asks a block holding sets similar to its own.

    One is as good as all where a block has the members of one component. A block is stored as one trie.
    """
    def run(key, group):
        # A class may come with more than one text.
        held, asked = {}, {}
        for cls, hits, sequence in zip(group["cls"].tolist(), group["hits"].tolist(), _unpacked(group["packed"], order.value)):
            if hits:
                asked[cls] = hits, sequence
            else:
                held[cls] = sequence
        trie, found = Trie.build([(sequence, cls) for cls, sequence in held.items()]), []
        for cls, (hits, sequence) in asked.items():
            others = (label for label, _ in trie.similar(frozenset(sequence), percent) if label != cls)
            found += [(cls, label) for label in islice(others, hits)]
        return pd.DataFrame(found, columns=["source", "target"], dtype="int64")

    return routes.join(texts, "cls").groupBy("label", "block", "part").applyInPandas(run, "source long, target long")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _common(a: str, b: str, percent: int) -> Column:
    """Least number of shingles a similar pair of these sizes has in common among both prefixes.

    Common shingles in global order are the same sequence for both sets, so those inside the
    prefix of one are the first of them, and the shorter of the two beginnings is in both.
    """
    overlap = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent))
    return overlap - F.ceil(F.greatest(a, b) * percent / 100) + 1


def _block_allows(percent: int) -> Column:
    """Whether a set and one of a block may overlap enough from this common shingle on, itself included.

    A block is known by its least and its largest size and by the most shingles that follow in one of
    its sets, so it may pass without such a set, but never fail with one.
    """
    needed = F.ceil((F.col("size") + F.col("least")) * percent / (100 + percent))
    sizes = (100 * F.col("size") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("size"))
    return sizes & (F.least(F.col("size") - F.col("place"), F.col("room")) >= needed)


def _stars(crowded: DataFrame) -> DataFrame:
    """(label, block, cls, hits) of the members and of the leaders they meet, named by the first leader.

    A class goes to the first leader it shares most groups with. Pairs left out come in the second pass.
    """
    draw = F.xxhash64("cls")
    drawn = Window.partitionBy("token").orderBy(draw, "cls")
    named = crowded.select("token", "cls", F.first("cls").over(drawn).alias("label"), F.row_number().over(drawn).alias("turn"))
    counted = write_stage(named.groupBy("label", "cls").agg(F.count(F.lit(1)).alias("common"), F.min("turn").alias("turn")), "stars")
    most = Window.partitionBy("cls").orderBy(F.desc("common"), "label")
    probes = counted.withColumn("rank", F.row_number().over(most)).where("rank = 1").select("label", F.lit(0).alias("block"), "cls", F.lit(LEADERS).alias("hits"))
    early = Window.partitionBy("label").orderBy(draw, "cls")
    held = counted.where(F.col("turn") <= LEADERS).withColumn("rank", F.row_number().over(early))
    held = held.where(F.col("rank") <= LEADERS).select("label", F.lit(0).alias("block"), "cls", F.lit(0).alias("hits"))
    blocks = write_stage(probes.unionByName(held), "stars")
    discard(counted)
    return blocks


def _ranked(counted: DataFrame) -> DataFrame:
    """(leader, member, rank): a member's leaders by what it has in common with them.

    The first pass takes the PARTNERS it has most in common with, the second the others.
    """
    best = Window.partitionBy("member").orderBy(F.desc("common"), "leader")
    return counted.select("leader", "member", F.row_number().over(best).alias("rank"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose two classes are not in one component yet."""
    one, two = [labels.select(F.col("account").alias(c), F.col("component").alias(f"_{c}")) for c in ("leader", "member")]
    named = pairs.join(one, "leader", "left").join(two, "member", "left")
    return named.where(F.coalesce("_leader", "leader") != F.coalesce("_member", "member")).select("leader", "member")


def _number(doc_id: Column) -> Column:
    """A number standing for a doc_id in the filter."""
    return F.xxhash64(doc_id)


def similar_classes(docs: DataFrame, column: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets per row, component per class): the rows with their class, and the classes' components."""
    small_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", docs[column].cast("string").alias("text"))
    read = write_stage(texts.mapInArrow(
        _classified, f"doc_id {kind}, n_shingles long, cls long, shingle long, n long"), "classes")
    rows = read.where("shingle IS NULL").select("doc_id", "n_shingles", "cls")
    context = docs.sparkSession.sparkContext
    order = context.broadcast(global_order(read.where("shingle IS NOT NULL").select("shingle", "n")))
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min("n_shingles").alias("size"), F.min(_number(F.col("doc_id"))).alias("first"))

    # One shuffle by token does it all: what is not shared goes, copies of a class become one, groups are counted.
    postings = texts.select("text").mapInArrow(_postings(order, percent), "spot long, cls long, size long")
    token = F.shiftright("spot", 16)
    postings = postings.repartition(token).select(
        token.alias("token"), "cls", "size", F.col("spot").bitwiseAND(PLACE).alias("place"))
    home = Window.partitionBy("token")
    shared = postings.withColumn("_a", F.min("cls").over(home)).withColumn("_b", F.max("cls").over(home)).where("_a < _b")
    grouped = shared.select("token", "cls", "size", "place").distinct().withColumn("crowd", F.count(F.lit(1)).over(home))
    later = F.collect_list(F.struct(F.col("cls").alias("other_cls"), F.col("size").alias("other_size"))).over(
        home.orderBy("cls", "place").rowsBetween(1, CROWD))
    hits = write_stage(grouped.withColumn("others", F.when(F.col("crowd") <= CROWD, later)), "hits")
    crowded = hits.where(F.col("crowd") > CROWD)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """Packed texts of the wanted classes, read once more."""
        chosen = wanted.distinct().join(classes, "cls")
        words = context.broadcast(_filter_words(chosen.select("cls", "first")))
        return write_stage(texts.select("text", _number(F.col("doc_id")).alias("number")).mapInArrow(
            _packed_texts(words), "cls long, packed binary"), "packed")

    # Shingles of few classes: all pairs, counted. Those of many can only add as many as both sets have.
    late = write_stage(crowded.groupBy("cls").agg(F.count(F.lit(1)).alias("late")), "late")
    met = hits.where(F.size("others") > 0).select("cls", "size", F.inline("others"))
    met = met.where((F.col("cls") < F.col("other_cls")) & _sizes_allow("size", "other_size", percent))
    counted = met.groupBy("cls", "other_cls").agg(
        F.count(F.lit(1)).alias("common"), *[F.first(c).alias(c) for c in ("size", "other_size")])
    counted = counted.withColumn("need", _common("size", "other_size", percent))
    counted = counted.join(late, "cls", "left").join(
        late.select(F.col("cls").alias("other_cls"), F.col("late").alias("other_late")), "other_cls", "left")
    added = F.least(F.coalesce("late", F.lit(0)), F.coalesce("other_late", F.lit(0)))
    few = write_stage(_ranked(counted.where(F.col("common") + added >= F.col("need")).select(
        F.col("cls").alias("leader"), F.col("other_cls").alias("member"), "common")), "few")
    discard(late)
    stars = _stars(crowded)
    routes = _routes(stars, _pair_blocks(few.where(F.col("rank") <= PARTNERS)))
    packed = texts_of(routes.select("cls"))
    links = write_stage(_verify(routes, packed, order, percent), "links")
    discard(stars, packed, routes)
    labels = write_stage(connected_components(links), "labels")

    # The second pass: what is still apart and was not compared, in the shingles of few classes and in those of many.
    pairs = write_stage(_apart(few.where(F.col("rank") > PARTNERS), labels), "pairs")
    discard(few)
    named = crowded.join(labels, F.col("cls") == F.col("account"), "left").select(
        "token", "cls", "size", "place", F.coalesce("component", "cls").alias("label"))
    mixed = named.withColumn("_a", F.min("label").over(home)).withColumn("_b", F.max("label").over(home)).where("_a < _b").drop("_a", "_b")
    members = mixed.select("label", "cls").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK)
    mixed = write_stage(mixed.join(members, "label").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")), "mixed")
    discard(hits)
    other = mixed.groupBy("token", *[F.col(c).alias(f"other_{c}") for c in ("label", "members", "block")]).agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("size") - F.col("place")).alias("room"))
    smaller = F.struct("members", "label") < F.struct("other_members", "other_label")
    apart = mixed.join(other, "token").where(smaller & _block_allows(percent))
    probes = write_stage(apart.select(F.col("other_label").alias("label"), F.col("other_block").alias("block"), "cls", F.lit(1).alias("hits")).distinct(), "probes")
    if pairs.isEmpty() and probes.isEmpty():
        return rows, connected_components(links)
    held = mixed.select("label", "block", "cls", F.lit(0).alias("hits")).distinct()
    held = held.join(probes.select("label", "block").distinct(), ["label", "block"], "left_semi")
    routes = _routes(probes, held, _pair_blocks(pairs))
    discard(mixed, probes, pairs)
    packed = texts_of(routes.select("cls"))
    more = write_stage(_verify(routes, packed, order, percent), "links")
    discard(packed, routes)
    return rows, connected_components(links.unionByName(more))


def jaccard_join(docs: DataFrame, column: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): links as components, copies as classes.

    Two documents link when their shingle sets overlap enough; a component is named by its
    smallest doc_id. Null and empty texts have an empty set, link with nothing and name
    themselves. Repeated rows and equal texts are one class. A null doc_id takes part, but does
    not name a component that holds another. Columns beyond ``doc_id`` and the text are not read.
    """
    rows, components = similar_classes(docs, column, percent)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("_first"))
    classes = classes.join(components, F.col("cls") == F.col("account"), "left").select(
        "cls", "_first", F.coalesce("component", "cls").alias("_label"))
    named = classes.groupBy("_label").agg(F.min("_first").alias("_name"))
    classes = classes.join(named, "_label").select(F.col("cls").alias("_cls"), "_name")
    full = rows.where("n_shingles > 0").join(classes, F.col("cls") == F.col("_cls")).select(
        "doc_id", "n_shingles", F.col("_name").alias("component_id"), F.col("cls").alias("class_id"))
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of its smallest doc_id, a missing one last.

    Documents are told apart by doc_id and text, so a doc_id may be missing or shared. Empty texts
    stay; rows alike in doc_id and text are one row.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.md5(text_of(column).cast("binary")).alias("text"))
    keyed = docs.withColumn("_mm_key", key)
    joined = jaccard_join(keyed.select(F.col("_mm_key").alias("doc_id"), column), column, percent)
    ids = joined.where("doc_id = component_id").select(F.col("doc_id").alias("_mm_id")).distinct()
    chosen = keyed.join(ids, F.col("_mm_key") == F.col("_mm_id"), "left_semi")
    # The key stands for doc_id and text: rows alike are already in one task, so texts are shuffled once.
    return chosen.dropDuplicates(["_mm_key", column]).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs.select("doc_id", "text")).drop("class_id")


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{LOWER[0]}', '{LOWER[1]}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT k, doc_id, s FROM (
    SELECT k, doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
    FROM (SELECT k, doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0))
), n AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY k),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.k <> b.k
  JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k
  GROUP BY a.k, b.k, a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))
), r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (k)
"""
