"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives one pass over each segment of a text; at every position the output
links give the pieces that end there, and the position's best state is relaxed from the states where they begin.

For a unigram model the state is the best score (Viterbi). For a BPE model the sum of scores does not decide: merges
do. There the state is the last piece of the prefix's encoding, and a piece may follow it if merging the two strings
gives back exactly the two pieces. Every prefix has one such state, so the pass gives what the merges give.

A segment is a run of blanks with the letters after it; a model whose pieces hold a blank after a letter is segmented
by whole texts. Segments are remembered, up to a bound, as words repeat.

Defined cases: a null or empty text has no pieces; characters outside the vocabulary become byte pieces where the model
has them, else the unknown piece; decoding inverts encoding but for unknown pieces and U+2581, which reads as a blank.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import FLAG, INTS, LONG, TEXT, small_batches, wider

BLANK = "▁"
# Fixed values of the model format: kinds of pieces, kinds of models, the penalty below the least score.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Segments and pairs remembered per task (beyond, the older half goes), and the longest segment that is.
REMEMBERED, LONGEST = 200_000, 200
#: Above any piece id; as a state, what no merge crosses: the start or a character outside the vocabulary.
LIMIT = 1 << 24
FREE = LIMIT - 1


class Recent(dict):
    """A memory of at most about 2 * size entries: a full one becomes the older one, whose entries return when used. Texts
    of more than LONGEST characters are not remembered, so its bytes are bounded too."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONGEST:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """A model read from its serialised form."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = proto.ModelProto()
        read.ParseFromString(model)
        norm = read.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or read.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser that escape blanks are supported")
        self.kind, self.prefix = read.trainer_spec.model_type, norm.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.names = [p.piece for p in read.pieces]
        self.scores = [p.score for p in read.pieces]
        kinds = [p.type for p in read.pieces]
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.bytes = {int(n[1:-1], 16): i for i, n in enumerate(self.names) if kinds[i] == BYTE}
        self.ids = {n: i for i, n in enumerate(self.names) if kinds[i] in (NORMAL, USER)}
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.spaced = any(BLANK in n.lstrip(BLANK) for n in self.ids)
        self.segment = re.compile("(?s).+" if self.spaced else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.raw = [bytes([int(n[1:-1], 16)]) if kinds[i] == BYTE else b"" if kinds[i] == CONTROL else " ⁇ ".encode() if kinds[i] == UNKNOWN else n.replace(BLANK, " ").encode() for i, n in enumerate(self.names)]
        self.machine = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.machine.add_word(name, (i, len(name)))
        self.machine.make_automaton()
        self.follows = Recent(self._follows)
        self.known = Recent(self._segment_bytes, REMEMBERED // 10)
        self.words = Recent(lambda w: self._segment_bytes(BLANK + w))
        runs = [n for n in self.ids if n == BLANK * len(n)]
        longest = max(runs, key=len, default="")
        tied = len({self.scores[self.ids[n]] for n in runs if len(n) > 1}) == 1
        self.period = len(longest) if tied and self.merged(longest * 4)[0] == longest else 0
        self.chars = {n for n in self.ids if len(n) == 1}
        # A line end that no piece holds parts segments, so that words at line ends are words like others.
        self.lines = self.kind == BPE and 10 in self.bytes and not self.spaced and not any("\n" in n for n in self.ids)
        self.line_end = array("i", [self.bytes[10]]).tobytes() if self.lines else b""

    def merged(self, text: str) -> list[str]:
        """text by merges: the pair of neighbours whose joint piece scores best is joined, the leftmost first.

        A heap holds the pairs that can be joined; one whose parts have changed since is passed over.
        """
        parts, ids, scores = list(text), self.ids, self.scores
        n = len(parts)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for k in range(n - 1):
            i = ids.get(parts[k] + parts[k + 1])
            if i is not None:
                heap.append((-scores[i], k, len(parts[k]) + len(parts[k + 1])))
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = after[k]
            if not parts[k] or j >= n or len(parts[k]) + len(parts[j]) != size:
                continue
            parts[k], parts[j] = parts[k] + parts[j], ""
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                i = ids.get(parts[k] + parts[j])
                if i is not None:
                    heapq.heappush(heap, (-scores[i], k, size + len(parts[j])))
            h = before[k]
            if h >= 0:
                i = ids.get(parts[h] + parts[k])
                if i is not None:
                    heapq.heappush(heap, (-scores[i], h, len(parts[h]) + size))
        return [p for p in parts if p]

    def blanks_merged(self, text: str) -> list[str]:
        """What merged gives for a text that begins with blanks.

        Where all runs of blanks tie in score, the first pair that can be joined always is, so that a long run becomes
        longest pieces from its left, one like the next; all but its end, which the text behind may reach, is known.
        """
        if not self.period:
            return self.merged(text)
        known = max(0, len(text) - len(text.lstrip(BLANK)) - 4 * self.period) // self.period
        return [BLANK * self.period] * known + self.merged(text[known * self.period :])

    def _follows(self, pair: int) -> bool:
        """May the second piece follow the first? After the start or an unknown character: do its own merges lead to it?"""
        first, second = divmod(pair, LIMIT)
        first, second = "" if first == FREE else self.names[first], self.names[second]
        return self.merged(first + second) == ([first, second] if first else [second])

    def _bpe(self, text: str) -> list[str]:
        n, follows, none = len(text), self.follows, -1
        last = [none] * (n + 1)
        last[0] = FREE
        odd = [] if self.chars.issuperset(text) else [i for i, c in enumerate(text) if c not in self.chars]
        for i in odd:
            last[i + 1] = FREE
        for end, (piece, size) in self.machine.iter(text):
            if last[end + 1] == none:
                before = last[end + 1 - size]
                if before != none and follows[before * LIMIT + piece]:
                    last[end + 1] = piece
        out, at, names = [], n, self.names
        while at:
            piece = last[at]
            if piece == none:
                return self.merged(text)
            out.append(text[at - 1] if piece == FREE else names[piece])
            at -= len(out[-1])
        return out[::-1]

    def _unigram(self, text: str) -> list[str]:
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back = [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.machine.iter(text):
            ends[end].append(hit)
        for i in range(n):
            single = False
            for piece, size in ends[i]:
                single |= size == 1
                score = best[i + 1 - size] + self.scores[piece]
                if score > best[i + 1]:
                    best[i + 1], back[i + 1] = score, size
            if not single and best[i] + self.lowest > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.lowest, 1
        out, at = [], n
        while at:
            out.append(text[at - back[at] : at])
            at -= back[at]
        return out[::-1]

    def _segment_bytes(self, text: str) -> bytes:
        """The ids of a segment, as int32 bytes."""
        if self.kind == UNIGRAM:
            parts = self._unigram(text)
        elif text.startswith(BLANK * 2):
            parts = self.blanks_merged(text)  # runs of blanks tie in score; the merges decide
        else:
            parts = self._bpe(text)
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.lines or BLANK in text:
            return self._whole((BLANK if self.prefix else "") + text.replace(" ", BLANK))
        out, spaced, bare = [], self.words, self.known
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_end)
            head = self.prefix and not k
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                out.append(self._whole((BLANK if head else "") + line.replace(" ", BLANK)))
            elif line:
                first, *rest = line.split(" ")
                out.append(spaced[first] if head else bare[first])
                out += [spaced[w] for w in rest]
            elif head:
                out.append(bare[BLANK])
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[s] for s in self.segment.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        if self.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


_held: dict[bytes, Pieces] = {}


def held(model: bytes) -> Pieces:
    """The model's pieces, kept by the process with what they remember: the tasks of a worker share them."""
    key = hashlib.sha256(model).digest()
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(model)
    return _held[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", ids: str = "piece_ids", count: str = "n_pieces", back: str | None = None) -> DataFrame:
    """docs with the piece ids of each text and their number; back names a column that tells whether decoding gives the text.

    A column of docs that has one of these names is replaced.
    """
    added = [(count, LONG), (ids, INTS), *([(back, FLAG)] if back else [])]
    taken = {n.lower() for n, _ in added}
    own = [c for c in docs.columns if c.lower() not in taken]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(box.value)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = part.column(at).to_pylist()
                coded = [pieces.encode_bytes(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                arrays = [pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if back:
                    arrays.append(pa.array([pieces.decode(flat[a:b].tolist()) == (t or "").replace(BLANK, " ") for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*own, *[n for n, _ in added]])

    return small_batches(docs).mapInArrow(run, wider(docs.schema, *added))


def decode_documents(docs: DataFrame, model: bytes, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give null."""
    own = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    at, box = own.index(ids), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(box.value)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*own, out])

    return small_batches(docs).mapInArrow(run, wider(docs.schema, (out, TEXT)))
