"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word is written ``<word>`` and gives its character n-grams; a text is the mean of their
embeddings, and a linear softmax reads the mean. Training is stochastic gradient descent in numpy
on a bounded sample of labelled texts. Because mean and softmax input are linear, a trained model
of few languages is one small table of logits per bucket, and one of many a table of embeddings;
tasks apply it to whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import besides, held_out, labelled_sample, slices, small_batches

UNDETERMINED = "und"
SLICE_CHARS = 120_000


@dataclass(frozen=True)
class Training:
    """``per_language`` and ``total`` bound the labelled sample; every language takes part, however
    many there are. It is chosen by the order of a hash, so reruns and any split of the input agree."""

    per_language: int = 400
    total: int = 20_000
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 14
    dim: int = 16
    epochs: int = 6
    rate: float = 4.0
    accept: float = 0.99
    seed: int = 7


@dataclass
class Model:
    """``table`` has a row per bucket: its logits, or its embedding where there are more languages than
    dimensions; ``head`` turns the mean embedding into logits then."""

    names: list[str]
    table: np.ndarray
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float
    reject_below: float
    orders: tuple[int, ...]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased words, each between boundary marks (0)."""
    joined = " ".join(text.lower().split())
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.where(codes == 32, np.uint64(0), codes)


def _grams(codes: np.ndarray, n: int, lo: int, hi: int, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of one word that start at places ``lo`` up to ``hi``."""
    size = min(hi, len(codes) - n + 1) - lo
    mixed = np.full(max(size, 0), n, dtype=np.uint64)
    inside = np.ones(len(mixed), dtype=bool)
    for i in range(n):
        part = codes[lo + i:lo + i + len(mixed)]
        mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if 0 < i < n - 1 or n == 1:
            inside &= part != 0
    return (mixed[inside] % np.uint64(buckets)).astype(np.int64)


def subword_parts(text: str, orders: tuple[int, ...], buckets: int, size: int = SLICE_CHARS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of all words, by where they start, so that no n-gram is lost or cut.

    N-grams do not reach past a word's marks.
    """
    codes = _codes(text)
    for lo in range(0, len(codes), size):
        yield np.concatenate([_grams(codes, n, lo, lo + size, buckets) for n in orders])


def subwords(text: str, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    return np.concatenate(list(subword_parts(text, orders, buckets)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], how: Training = Training()) -> Model | None:
    """Fit on (text, language) rows; a fifth of them calibrates temperature and rejection.

    Returns None without any row. The temperature is the one with the best likelihood on the
    calibration rows; ``reject_below`` is the lowest bound above which a share of ``accept`` of
    their predictions is right.
    """
    rows = [r for r in rows if r[0] and any(c.isalpha() for c in r[0])]
    if not rows:
        return None
    rng = np.random.default_rng(how.seed)
    names = sorted({r[1] for r in rows})
    number = {n: i for i, n in enumerate(names)}
    bags = []
    for text, lang in rows:
        ids, counts = np.unique(subwords(text, how.orders, how.buckets), return_counts=True)
        bags.append((ids, (counts / counts.sum()).astype(np.float32), number[lang]))
    order = rng.permutation(len(bags))
    held = order[: len(bags) // 5] if len(bags) >= 20 else order[:0]
    fit = order[len(held):]
    e = rng.normal(0, 0.1, (how.buckets, how.dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (how.dim, len(names))).astype(np.float32)
    b = np.zeros(len(names), dtype=np.float32)
    steps, step = how.epochs * len(fit), 0
    for _ in range(how.epochs):
        for k in rng.permutation(fit):
            ids, weight, y = bags[k]
            lr = how.rate * (1 - step / steps)
            mean = weight @ e[ids]
            grad = _softmax(mean @ w + b)
            grad[y] -= 1
            back = w @ grad
            w -= 0.1 * lr * np.outer(mean, grad)
            b -= 0.1 * lr * grad
            e[ids] -= lr * weight[:, None] * back * 5
            step += 1
    read = lambda ids, weight: (weight @ e[ids]) @ w + b
    temperature, floor = 1.0, 0.0
    if len(held):
        z = np.array([read(*bags[k][:2]) for k in held])
        y = np.array([bags[k][2] for k in held])
        at = np.arange(len(y))
        grid = np.geomspace(0.5, 8, 17)
        temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[at, y] + 1e-12).sum()))
        p = _softmax(z / temperature)
        best = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == y)[best]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= how.accept)
        floor = 0.0 if right[-1] >= how.accept else float(p.max(1)[best[good[-1]]]) if len(good) else 1.0
    table, head = (e @ w, None) if len(names) <= how.dim else (e, w)
    return Model(names, table, head, b, temperature, floor, how.orders)


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and probability of whole texts; ``und`` and 0 where there is no letter."""
    langs, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            langs.append(UNDETERMINED)
            continue
        total, n = np.zeros(model.table.shape[1]), 0
        for ids in subword_parts(text, model.orders, len(model.table)):
            total += model.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        mean = total / max(n, 1)
        p = _softmax(((mean if model.head is None else mean @ model.head) + model.bias) / model.temperature)
        langs.append(model.names[int(p.argmax())])
        scores[i] = p.max()
    return langs, scores


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing
    was learnt. ``rejected`` marks predictions below the calibrated bound. Repeated rows are
    predicted each on its own; kept columns named like a result give way to it.
    """
    keep = besides(keep, ("lang_pred", "score", "rejected"))
    small_batches(docs)
    chosen = docs.select(*keep, docs[column].alias("_mm_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("_mm_text").schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part, texts in slices(batches, "_mm_text", SLICE_CHARS * 4):
            if known is None:
                langs, scores, low = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                langs, scores = predict(texts, known)
                low = scores < known.reject_below
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores), pa.array(low)],
                names=[*keep, "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame, how: Training = Training()) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang")
    ids = rows.where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("lang").alias("label"))
    model = train(labelled_sample(ids, rows, how.per_language, how.total), how)
    judged = rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return identify(judged, model, ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
