"""SentencePiece encoding and decoding by a Viterbi pass over a trie of words.

A text is cut into marked words (runs of the space mark with what follows). The distinct words of
a few texts are sorted, which lays their trie out in depth-first order: going from one word to
the next, the forward states of the common prefix are kept and only the rest is computed.

The forward state after a prefix depends on the prefix alone, for both kinds of model:

* unigram: the best sum of piece scores up to there and the length of its last piece;
* BPE: the last piece of the prefix's own encoding. A sequence of pieces is the greedy encoding
  exactly when every two neighbours, taken alone, are encoded as those two pieces, so a step costs
  0 if the pair stands alone and is forbidden otherwise, and one piece survives at each position.

Texts are encoded where they lie: no shuffle, and a worker holds one slice of texts plus bounded
memories of words and pairs.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmuration.llm.common import besides, slices, small_batches

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_CHARS = 1_500_000
MEMORY = 400_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4


@dataclass
class Pieces:
    """The vocabulary: ids, scores and types as the model file lists them."""

    kind: int
    names: list[str]
    scores: list[float]
    types: list[int]
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        usable = (NORMAL, USER)
        self.ids = {n: i for i, (n, t) in enumerate(zip(self.names, self.types)) if t in usable}
        self.bytes = {int(n[3:5], 16): i for i, (n, t) in enumerate(zip(self.names, self.types)) if t == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        # Pieces by their last characters, from the end: a walk backwards stops at the first
        # ending no piece has.
        self.endings: dict = {}
        for name, i in self.ids.items():
            node = self.endings
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[""] = i
        self.floor = min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - 10.0
        raw = [n.replace(MARK, " ").encode() if t in usable else b"" for n, t in zip(self.names, self.types)]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = raw


def read_model(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; tasks receive the vocabulary, not the path.

    Only models whose pieces never join the end of a word to a following mark can be cut into
    words, and only identity normalisation is known; others are refused.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    names = [p.piece for p in model.pieces]
    if any(re.search(f"[^{MARK}]{MARK}", n) for n in names):
        raise ValueError("a piece spans the end of a word")
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError("only models without normalisation and with a leading mark are supported")
    if not {c for n, p in zip(names, model.pieces) if p.type in (NORMAL, USER) for c in n} <= set(names):
        raise ValueError("every character of a piece must be a piece")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Pieces(model.trainer_spec.model_type, names, [p.score for p in model.pieces], [p.type for p in model.pieces])


class Encoder:
    """Encodes sorted distinct words; keeps bounded memories of words and of piece pairs."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known: dict[str, bytes] = {}
        self.alone: dict[int, bool] = {}
        self.runs: dict[int, tuple] = {}

    def merges(self, piece: int) -> tuple[list, list]:
        """The greedy merges of a piece alone: (score, last part) and (score, first part) after each."""
        known = self.runs.get(piece)
        if known is None:
            ids, scores = self.p.ids, self.p.scores
            parts = list(self.p.names[piece])
            last, first = [(None, parts[-1])], [(None, parts[0])]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    made = ids.get(parts[i] + parts[i + 1])
                    if made is not None and (best is None or scores[made] > best):
                        best, at = scores[made], i
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                last.append((best, parts[-1]))
                first.append((best, parts[0]))
            known = self.runs[piece] = last, first, len(parts) == 1
        return known

    def stands(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces, taken alone, are encoded as those two.

        Both pieces are built merge by merge, the better first and the left one on equal scores;
        the pair fails when joining the parts at its seam would come first at some point.
        """
        (ends, _, whole), (_, heads, complete) = self.merges(left), self.merges(right)
        if not (whole and complete):
            return False
        ids, scores = self.p.ids, self.p.scores
        i = j = 0
        while True:
            seam = ids.get(ends[i][1] + heads[j][1])
            a = ends[i + 1][0] if i + 1 < len(ends) else None
            b = heads[j + 1][0] if j + 1 < len(heads) else None
            if seam is not None:
                cross = scores[seam]
                if (a is None or cross > a) and (b is None or cross >= b):
                    return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def _bpe_states(self, word: str, start: int, back: list, piece_at: list) -> None:
        """The last piece of the encoding of every prefix and its length, from ``start`` on."""
        endings, alone = self.p.endings, self.alone
        for end in range(start, len(word) + 1):
            node, at = endings, end
            # A character without a piece stays alone and is spelt in bytes.
            length, last = 1, -1
            while at:
                at -= 1
                node = node.get(word[at])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    before = piece_at[at]
                    if at == 0 or before < 0:
                        length, last = end - at, piece
                        break
                    pair = before << 20 | piece
                    fits = alone.get(pair)
                    if fits is None:
                        if len(alone) > 4 * MEMORY:
                            alone.clear()
                        fits = alone[pair] = self.stands(before, piece)
                    if fits:
                        length, last = end - at, piece
                        break
            back[end], piece_at[end] = length, last

    def _unigram_states(self, word: str, start: int, back: list, best: list) -> None:
        endings, scores, floor = self.p.endings, self.p.scores, self.p.floor
        for end in range(start, len(word) + 1):
            top, length = None, 1
            node, at = endings, end
            while at:
                at -= 1
                node = node.get(word[at])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    score = best[at] + scores[piece]
                    if top is None or score >= top:
                        top, length = score, end - at
            best[end] = best[end - 1] + floor if top is None else top
            back[end] = length

    def encode_words(self, words: list[str]) -> None:
        """Add the ids of ``words`` (distinct, sorted) to the memory, depth-first over their trie."""
        ids, spelt, unknown = self.p.ids, self.p.bytes, self.p.unknown
        longest = max(map(len, words), default=0)
        back, best, piece_at = [0] * (longest + 1), [0.0] * (longest + 1), [-1] * (longest + 1)
        before, bpe = "", self.p.kind == BPE
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            if bpe:
                self._bpe_states(word, shared + 1, back, piece_at)
            else:
                self._unigram_states(word, shared + 1, back, best)
            before, found, end = word, [], len(word)
            while end:
                at = end - back[end]
                piece = piece_at[end] if bpe and piece_at[end] >= 0 else ids.get(word[at:end])
                if piece is not None:
                    found.append(piece)
                elif spelt:
                    found.extend(spelt[b] for b in reversed(word[at:end].encode("utf-8", "surrogatepass")))
                else:
                    found.append(unknown)
                end = at
            found.reverse()
            if not bpe and not spelt:
                found = [i for n, i in enumerate(found) if i != unknown or n == 0 or found[n - 1] != unknown]
            self.known[word] = array("i", found).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as the bytes of 32-bit integers."""
        units = [marked(t) for t in texts]
        new = set().union(*units).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*units)
        self.encode_words(sorted(new))
        known = self.known
        return [b"".join([known[u] for u in row]) for row in units]

    def decode(self, ids: list[int]) -> str:
        raw = self.p.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def marked(text: str) -> list[str]:
    """The marked words of a text; an empty text has none."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return UNIT.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, pieces: Pieces, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``ids`` (array of int), ``n_pieces`` and ``round_trip``.

    Null and empty texts have no ids and count as coming back as the empty text. ``round_trip``
    is false where a text cannot come back, as when it holds the space mark itself. Repeated rows
    are encoded each on their own. Kept columns named like a result give way to it.
    """
    keep = besides(keep, ("ids", "n_pieces", "round_trip"))
    small_batches(docs)
    chosen = docs.select(*keep, docs[column].alias("_mm_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("_mm_text").schema)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    vocabulary = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker process serves many tasks: keep what it has learnt about this vocabulary.
        if vocabulary not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[vocabulary] = Encoder(shared.value)
        encoder = _ENCODERS[vocabulary]
        for part, texts in slices(batches, "_mm_text", SLICE_CHARS):
            rows = encoder.encode(texts)
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            flat = np.frombuffer(b"".join(rows), dtype=np.int32)
            back = [encoder.decode(flat[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts)]
            done = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32())),
                pa.array(np.diff(ends), type=pa.int32()), pa.array(back, type=pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + done, names=[*keep, "ids", "n_pieces", "round_trip"])

    head = f"{schema}, " if schema else ""
    return chosen.mapInArrow(run, f"{head}ids array<int>, n_pieces int, round_trip boolean")


def decode_documents(encoded: DataFrame, pieces: Pieces, column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``text``: ids back to text. Null ids give the empty text, null or unknown ids
    inside are skipped, and bytes that are no text become replacement characters."""
    keep = besides(keep, ("text",))
    small_batches(encoded)
    chosen = encoded.select(*keep, encoded[column].alias("_mm_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("_mm_ids").schema)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(shared.value)
        size = len(shared.value.raw)
        for part in batches:
            rows = part.column("_mm_ids").to_pylist()
            texts = [decoder.decode([i for i in r or () if i is not None and 0 <= i < size]) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return chosen.mapInArrow(run, f"{schema}, text string" if schema else "text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return encode_documents(docs, read_model(model))
