"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash and the mean embedding of its hashed character
n-grams. Both directions read windows of words, attention pools their states, and one output
scores the window; a text's score is that of its worst window. All overlapping windows of the
whole text are scored: one starts at every word.

Training sees only texts with a label for the whole text, so it goes in rounds: score all windows,
learn from each text's highest window (and one more at random for clean texts), repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import besides, held_out, labelled_sample, slices, small_batches

SLICE_CHARS = 600_000
# Words whose n-grams are laid out at a time.
PART = 20_000
# Windows in work at a time: their states stay in the processor's cache.
WINDOWS = 2_048
THRESHOLD = 0.3


@dataclass(frozen=True)
class Training:
    """``per_label`` bounds the labelled texts per class; the rest is the network and its fitting."""

    per_label: int = 1200
    window: int = 6
    buckets: int = 1 << 14
    dim: int = 6
    hidden: int = 8
    attention: int = 6
    orders: tuple[int, ...] = (3, 4, 5)
    rounds: int = 4
    passes: int = 3
    rate: float = 0.02
    seed: int = 5


@dataclass
class Network:
    how: Training
    words: np.ndarray
    grams: np.ndarray
    p: dict = field(default_factory=dict)
    shift: float = 0.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _hashed_words(words: list[str], buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.int64) % buckets


def _hashed_grams(words: list[str], how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of ``<word>``, word after word, and where each word's begin.

    The whole word counts as an n-gram too, so every word has at least one.
    """
    parts, sizes = [], []
    for lo in range(0, len(words), PART):
        some = words[lo:lo + PART]
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(some), dtype=np.int32), [len(w) + 2 for w in some])
        found, owners = [_hashed_words(some, how.buckets).astype(np.int32)], [np.arange(len(some), dtype=np.int32)]
        for n in how.orders:
            size = len(codes) - n + 1
            if size <= 0:
                continue
            inside = owner[:size] == owner[n - 1:]
            mixed = np.full(size, n, dtype=np.uint64)
            for i in range(n):
                mixed = (mixed ^ codes[i:i + size]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            found.append((mixed[inside] % np.uint64(how.buckets)).astype(np.int32))
            owners.append(owner[:size][inside])
        every = np.concatenate(owners)
        parts.append(np.concatenate(found)[np.argsort(every, kind="stable")])
        sizes.append(np.bincount(every, minlength=len(some)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Words:
    """Numbers the distinct words of some texts and lays all their windows out.

    A window starts at every word that has ``window`` words from itself on; a shorter text is one
    window of its own. Windows are places in the row of all words, not copies of them.
    """

    def __init__(self, texts: list[str], how: Training):
        index: dict[str, int] = {}
        rows = [np.array([index.setdefault(w, len(index)) for w in t.lower().split()], dtype=np.int64) for t in texts]
        self.words = list(index)
        t = self.window = how.window
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.concatenate([*rows, np.zeros(t, dtype=np.int64)])
        counts = np.where(lengths > 0, np.maximum(lengths - t, 0) + 1, 0)
        self.owner = np.repeat(np.arange(len(rows)), counts)
        first = np.cumsum(lengths) - lengths
        self.starts = np.arange(len(self.owner)) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        self.sizes = np.minimum(lengths, t)[self.owner]

    def at(self, chosen) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and mask of the chosen windows."""
        steps = np.arange(self.window)
        return self.flat[self.starts[chosen][:, None] + steps], steps < self.sizes[chosen][:, None]


class Gru:
    """Forward and backward pass of the network over word features."""

    def __init__(self, how: Training):
        self.how = how

    def start(self, rng) -> dict:
        d, h, k = 2 * self.how.dim, self.how.hidden, self.how.attention
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        p = {}
        for side in ("f", "b"):
            p |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        return p | {"A": draw(2 * h, k), "a": np.zeros(k, np.float32), "v": draw(k), "o": draw(2 * h), "b": np.zeros(1, np.float32)}

    def run(self, p: dict, projected: dict, windows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``projected`` holds each word's input to the gates per direction."""
        n, t = windows.shape
        h = self.how.hidden
        states = np.zeros((t, n, 2 * h), np.float32)
        saved = {"f": [], "b": []}
        for side, lo in (("f", 0), ("b", h)):
            u, now = p[f"U{side}"], np.zeros((n, h), np.float32)
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                x, m = projected[side][windows[:, i]], mask[:, i:i + 1]
                g = now @ u
                zr = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
                new = np.where(m, c + z * (now - c), now)
                if keep:
                    saved[side].append((i, now, z, r, c, g[:, 2 * h:]))
                now = new
                states[i, :, lo:lo + h] = now
        e = np.tanh(states @ p["A"] + p["a"])
        s = np.where(mask.T, e @ p["v"], -1e9)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ p["o"] + p["b"][0]
        return (logit, (states, e, w, pooled, saved)) if keep else logit

    def slide(self, p: dict, projected: dict, words: np.ndarray, t: int) -> np.ndarray:
        """Logits of the windows of ``t`` words that start at each of the first len(words) - t + 1 words.

        The windows of one step read neighbouring words, so a step is one slice, without a mask.
        """
        n, h = len(words) - t + 1, self.how.hidden
        states = np.empty((t, n, 2 * h), np.float32)
        for side, lo in (("f", 0), ("b", h)):
            x, u, now = projected[side][words], p[f"U{side}"], np.zeros((n, h), np.float32)
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                g = now @ u
                zr = np.tanh(0.5 * (x[i:i + n, :2 * h] + g[:, :2 * h]))
                zr = 0.5 * zr + 0.5
                c = np.tanh(x[i:i + n, 2 * h:] + zr[:, h:] * g[:, 2 * h:])
                now = c + zr[:, :h] * (now - c)
                states[i, :, lo:lo + h] = now
        s = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
        w = np.exp(s - s.max(axis=0))
        # The output is linear, so each state is read before pooling instead of after.
        return (w * (states @ p["o"])).sum(axis=0) / w.sum(axis=0) + p["b"][0]

    def grads(self, p: dict, words: dict, windows, mask, memory, d_logit):
        """Gradients of the parameters and of the word features, given that of the logits."""
        states, e, w, pooled, saved = memory
        t, n, _ = states.shape
        h = self.how.hidden
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["b"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * p["o"]
        d_w = np.einsum("nh,tnh->tn", d_pool, states)
        d_s = w * (d_w - (w * d_w).sum(axis=0))
        d_e = d_s[:, :, None] * p["v"] * (1 - e * e)
        g["v"] = np.einsum("tn,tnk->k", d_s, e)
        g["A"] = np.einsum("tnh,tnk->hk", states, d_e)
        g["a"] = d_e.sum(axis=(0, 1))
        d_states = w[:, :, None] * d_pool + d_e @ p["A"].T
        d_x = np.zeros((n, t, words["x"].shape[1]), np.float32)
        for side, lo in (("f", 0), ("b", h)):
            u, W = p[f"U{side}"], p[f"W{side}"]
            d_now = np.zeros((n, h), np.float32)
            for i, before, z, r, c, un in reversed(saved[side]):
                m = mask[:, i:i + 1]
                d = d_now + d_states[i, :, lo:lo + h]
                live = np.where(m, d, 0)
                d_c = live * (1 - z) * (1 - c * c)
                d_z = live * (before - c) * z * (1 - z)
                d_r = d_c * un * r * (1 - r)
                gates = np.concatenate([d_z, d_r, d_c], axis=1)
                hidden = np.concatenate([d_z, d_r, d_c * r], axis=1)
                x = words["x"][windows[:, i]]
                g[f"W{side}"] += x.T @ gates
                g[f"c{side}"] += gates.sum(axis=0)
                g[f"U{side}"] += before.T @ hidden
                d_x[:, i] += gates @ W.T
                d_now = np.where(m, live * z + hidden @ u.T, d)
        return g, d_x


def features(net: Network, words: list[str], hashed=None, grams=None, bounds=None) -> tuple:
    """Features of distinct words, with the buckets they come from; known buckets may be given."""
    if grams is None:
        hashed = _hashed_words(words, net.how.buckets)
        grams, bounds = _hashed_grams(words, net.how)
    x = np.empty((len(words), 2 * net.how.dim), np.float32)
    x[:, :net.how.dim] = net.words[hashed]
    for lo in range(0, len(words), PART):
        hi = min(lo + PART, len(words))
        sums = np.add.reduceat(net.grams[grams[bounds[lo]:bounds[hi]]], bounds[lo:hi] - bounds[lo], axis=0)
        x[lo:hi, net.how.dim:] = sums / np.diff(bounds[lo:hi + 1])[:, None]
    return x, hashed, grams, bounds


def _projected(p: dict, x: np.ndarray) -> dict:
    return {s: x @ p[f"W{s}"] + p[f"c{s}"] for s in ("f", "b")}


def window_logits(net: Network, x: np.ndarray, laid: Words) -> np.ndarray:
    """Logits of all windows, in parts; ``x`` holds the features of the distinct words."""
    projected, gru, t = _projected(net.p, x), Gru(net.how), laid.window
    logits = np.empty(len(laid.starts), np.float32)
    whole = laid.sizes == t
    places = len(laid.flat) - t
    for lo in range(0, places - t + 1, WINDOWS):
        hi = min(lo + WINDOWS, places - t + 1)
        a, b = np.searchsorted(laid.starts, (lo, hi))
        mine = np.arange(a, b)[whole[a:b]]
        if len(mine):
            logits[mine] = gru.slide(net.p, projected, laid.flat[lo:hi + t - 1], t)[laid.starts[mine] - lo]
    short = np.flatnonzero(~whole)
    for lo in range(0, len(short), WINDOWS):
        logits[short[lo:lo + WINDOWS]] = gru.run(net.p, projected, *laid.at(short[lo:lo + WINDOWS]))
    return logits


def text_logits(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Words]:
    """Highest window logit per text (-inf without words), all window logits, and the windows."""
    laid = Words(texts, net.how)
    best = np.full(len(texts), -np.inf)
    if not len(laid.starts):
        return best, np.zeros(0), laid
    logits = window_logits(net, features(net, laid.words)[0], laid)
    firsts = np.flatnonzero(np.diff(laid.owner, prepend=-1))
    best[laid.owner[firsts]] = np.maximum.reduceat(logits, firsts)
    return best, logits, laid


def _log_odds(per_text: Iterator[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a bucket's texts being toxic: a first guess for one dimension."""
    bad, every = np.zeros(size), np.zeros(size)
    for buckets, y in zip(per_text, toxic):
        found = np.unique(buckets)
        every[found] += 1
        bad[found] += y
    share = max(toxic.mean(), 1e-3)
    return np.log((bad + 8 * share) / (every - bad + 8 * (1 - share))) - np.log(share / max(1 - share, 1e-3))


def train(rows: list[tuple[str, int]], base_rate: float, how: Training = Training()) -> Network | None:
    """Fit on (text, label) rows; a quarter of them sets the shift that puts the best cut at 0.3.

    Returns None unless both labels occur. ``base_rate`` is the share of toxic texts among all
    labelled ones, which the balanced sample hides.
    """
    rows = [r for r in rows if r[0].split()]
    y = np.array([1.0 if r[1] == 1 else 0.0 for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(how.seed)
    order = rng.permutation(len(rows))
    held, fit = (order[: len(rows) // 4], order[len(rows) // 4:]) if len(rows) >= 40 else (order, order)
    if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
        held = fit = order
    net = Network(how, *(rng.normal(0, 0.05, (how.buckets, how.dim)).astype(np.float32) for _ in range(2)))
    laid = Words([rows[i][0] for i in fit], how)
    label = y[fit]
    known = features(net, laid.words)[1:]
    hashed, grams, bounds = known
    firsts = np.flatnonzero(np.diff(laid.owner, prepend=-1))
    edges = np.append(laid.starts[firsts], len(laid.flat) - how.window)
    used = (np.unique(laid.flat[a:b]) for a, b in zip(edges, edges[1:]))
    net.words[:, 0] = _log_odds((hashed[w] for w in used), label, how.buckets)
    used = (np.unique(laid.flat[a:b]) for a, b in zip(edges, edges[1:]))
    net.grams[:, 0] = _log_odds((np.concatenate([grams[bounds[i]:bounds[i + 1]] for i in w]) for w in used), label, how.buckets)
    gru = Gru(how)
    net.p = gru.start(rng)
    x = features(net, laid.words, *known)[0]
    guess = x[:, 0] + 2 * x[:, how.dim]
    scores = np.empty(len(laid.starts), np.float32)
    for lo in range(0, len(scores), WINDOWS):
        w, m = laid.at(np.arange(lo, min(lo + WINDOWS, len(scores))))
        scores[lo:lo + WINDOWS] = np.where(m, guess[w], -9).max(axis=1)
    size = np.diff(bounds)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for k in range(how.rounds):
        if k:
            scores = window_logits(net, features(net, laid.words, *known)[0], laid)
        by = np.lexsort((-scores, laid.owner))
        first = by[firsts]
        clean = np.flatnonzero(label[laid.owner] == 0)
        chosen = np.concatenate([first, rng.choice(clean, min(len(clean), int((label == 0).sum())), replace=False)])
        for _ in range(how.passes):
            for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64)):
                step += 1
                w, m = laid.at(batch)
                used, inverse = np.unique(w, return_inverse=True)
                w = inverse.reshape(w.shape)
                x = features(net, [laid.words[i] for i in used])[0]
                logit, memory = gru.run(net.p, _projected(net.p, x), w, m, keep=True)
                d = ((_sigmoid(logit) - label[laid.owner[batch]]) / len(batch)).astype(np.float32)
                g, d_x = gru.grads(net.p, {"x": x}, w, m, memory, d)
                for name, grad in g.items():
                    a, b = moments[name]
                    a += 0.1 * (grad - a)
                    b += 0.01 * (grad * grad - b)
                    net.p[name] -= how.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
                total = np.zeros_like(x)
                np.add.at(total, w[m], d_x[m])
                np.add.at(net.words, hashed[used], -total[:, :how.dim])
                spans = [grams[bounds[i]:bounds[i + 1]] for i in used]
                back = np.repeat(total[:, how.dim:] / size[used][:, None], [len(s) for s in spans], axis=0)
                np.add.at(net.grams, np.concatenate(spans), -back)
    best = text_logits(net, [rows[i][0] for i in held])[0]
    net.shift = _best_cut(best, y[held], base_rate)
    return net


def _best_cut(logits: np.ndarray, y: np.ndarray, base_rate: float) -> float:
    """Middle of the gap where weighted F1 is highest."""
    weight = np.where(y == 1, base_rate / max(y.mean(), 1e-9), (1 - base_rate) / max(1 - y.mean(), 1e-9))
    values = np.unique(logits)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    right = np.array([(weight * y)[logits > c].sum() for c in cuts])
    flagged = np.array([weight[logits > c].sum() for c in cuts])
    f1 = 2 * right / (flagged + (weight * y).sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[top[len(top) // 2]])


def scores_of(net: Network, texts: list[str]) -> np.ndarray:
    """Scores from 0 to 1; a text without words scores 0."""
    best = text_logits(net, texts)[0]
    at = best - net.shift + np.log(THRESHOLD / (1 - THRESHOLD))
    return np.where(np.isfinite(best), _sigmoid(at), 0.0)


def score_documents(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """``keep`` with ``score`` and ``predicted`` (score >= 0.3).

    Null and empty texts score 0, and so does every text where nothing could be learnt. Repeated
    rows are scored each on its own; kept columns named like a result give way to it.
    """
    keep = besides(keep, ("score", "predicted"))
    small_batches(docs)
    chosen = docs.select(*keep, docs[column].alias("_mm_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.drop("_mm_text").schema)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_mm_text", SLICE_CHARS):
            found = np.zeros(len(texts)) if shared.value is None else scores_of(shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return chosen.mapInArrow(run, f"{schema}score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    rows = docs.select("doc_id", "text")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    ids = known.select("doc_id", F.col("toxic").alias("label"))
    rate = ids.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    net = train(labelled_sample(ids, rows, how.per_label), rate, how)
    judged = rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return score_documents(judged, net, ("doc_id", "held_out"))
