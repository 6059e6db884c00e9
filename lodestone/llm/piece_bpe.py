"""Encoding and decoding with SentencePiece models of the merge type (BPE).

The merge rule joins, again and again, the adjacent pair whose concatenation is the piece of the best score, of equal ones
the leftmost. Its result needs no simulation over the whole text: a row of pieces is that result exactly where each two
neighbours stay apart when their concatenation alone is merged anew. So a text is read from the left: an Aho-Corasick
automaton gives the pieces that begin at a position, the longest that is compatible with the piece before it is taken, and
where none is, the last piece is taken back and the position is marked in a bitfield, so that no path comes there again.

Texts are normalised and cut where no piece spans the cut (before a word's space mark, between bytes that are next to one
another in no piece), equal cuts are encoded once, and the ids are laid out by index.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .vectors import flat, slices

#: Bytes of text that are laid out at once; entries of a task's memories of cuts and of pairs, which are emptied beyond it.
PIECE, MEMORY = 2 << 20, 1 << 20
_MARK = "▁"


class Encoder:
    """The pieces of one model: automaton, merges, compatible pairs. Models with pieces that users defined are not supported."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        plain = [i for i in every if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.piece = {i: self.model.id_to_piece(i) for i in plain}
        self.score = {self.piece[i]: self.model.get_score(i) for i in plain}
        self.byte_id = {int(self.model.id_to_piece(i)[3:5], 16): i for i in every if self.model.is_byte(i)}
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            if self.merged(p) == [p]:  # others can't come out of merges
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(self.piece.get(i, "")) for i in every]
        #: The next shorter piece that a piece begins with; -1 where there is none.
        self.shorter = [next((self.automaton.get(p[:n]) for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), -1) if (p := self.piece.get(i)) else -1 for i in every]
        self.known = {p for p in self.score if len(p) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cuts: dict[bytes, np.ndarray] = {}
        #: Bytes that stand next to one another in a piece; whether a space mark follows another character in one.
        self.joint = np.zeros((256, 256), bool)
        for p in self.score:
            b = np.frombuffer(p.encode(), np.uint8)
            self.joint[b[:-1], b[1:]] = True
        self.joint[:, 0x80:0xC0] = True  # no character begins so
        self.at_marks = not any(_MARK in p.lstrip(_MARK) for p in self.score)

    def merged(self, text: str) -> list[str]:
        """The merge rule as it is stated, for short texts."""
        parts, get, none = list(text), self.score.get, -math.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their concatenation is merged anew."""
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        out = self.pairs[a, b] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return out

    def _path(self, text: str) -> list[int]:
        """The pieces of a text whose characters are all pieces."""
        n, length, pairs = len(text), self.length, self.pairs
        longest = [-1] * (n + 1)
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - length[piece]] = piece  # ever longer ones
        failed, taken, at, piece, last = bytearray(n // 8 + 1), [], 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or (pairs[last, piece] if (last, piece) in pairs else self.compatible(last, piece))):
                    break
                piece = self.shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at, last, piece = end, piece, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                taken.pop()
                at, piece, last = at - length[last], self.shorter[last], taken[-1] if taken else -1
        return taken

    def ids(self, text: str) -> list[int]:
        """The ids of a normalised text. A character that is no piece becomes the ids of its bytes, or the unknown id, once for a run of such characters."""
        if self.known.issuperset(text):
            return self._path(text)
        out, begin = [], 0
        for k, c in enumerate(text):
            if c not in self.known:
                out += self._path(text[begin:k])
                if self.byte_id:
                    out += [self.byte_id[b] for b in c.encode()]
                elif begin != k or not k:
                    out.append(self.model.unk_id())
                begin = k + 1
        return out + self._path(text[begin:])

    def _cut_ids(self, raw: bytes) -> np.ndarray:
        found = self.cuts.get(raw)
        if found is None:
            if len(self.cuts) >= MEMORY:
                self.cuts.clear()
            found = self.cuts[raw] = np.array(self.ids(raw.decode()), "<u4")
        return found

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin, and the end."""
        data, at = flat(pa.array(self.model.normalize(texts), pa.large_string()))
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(len(data), bool)
        if self.byte_id:  # without ids of bytes, a run of unknown characters is one id
            cut[1:] = ~self.joint[data[:-1], data[1:]]
        if self.at_marks:
            a, b, c = _MARK.encode()
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            cut[3:] |= mark[3:] & ~mark[:-3]
        cut[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(cut)
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, parts = spans.indices.to_numpy(), [self._cut_ids(raw) for raw in spans.dictionary.to_pylist()]
        count = np.array([len(p) for p in parts])
        first = np.cumsum(count) - count
        per = count[which]
        done = np.cumsum(per)
        ids = np.concatenate(parts)[np.repeat(first[which] - (done - per), per) + np.arange(done[-1])]
        return ids, np.append(0, done)[np.searchsorted(starts, at)]


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder a process; by default for the public model of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Encoder(path)


def encode(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True, column: str = "text") -> DataFrame:
    """All columns of docs and n_tokens int, ids binary (little-endian 32-bit integers, for np.frombuffer(ids, "<u4")) and decoded string, which replace columns of these names.

    `model` is the path of a SentencePiece model of the merge type on every executor. Null counts as empty; an empty text has
    the begin and end ids alone and decodes to an empty text. Repeated rows and ids of documents are handled row by row;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        head, tail = (np.array([i] * wanted, "<u4") for i, wanted in ((own.model.bos_id(), begin), (own.model.eos_id(), end)))
        for batch in batches:
            _, offsets = flat(batch.column(column))
            for i, j in slices(offsets, PIECE):
                part = batch.slice(i, j - i)
                ids, at = own.batch([t or "" for t in part.column(column).to_pylist()])
                rows = [np.concatenate([head, ids[a:b], tail]) for a, b in zip(at[:-1], at[1:], strict=True)]
                new = {"n_tokens": pa.array([len(r) for r in rows], pa.int32()), "ids": pa.array([r.tobytes() for r in rows], pa.binary()), "decoded": pa.array([own.model.decode(r.tolist()) for r in rows], pa.string())}
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new.values()], [*kept, *new])

    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded") or c == column]
    if column in ("n_tokens", "ids", "decoded"):
        raise ValueError(f"the text may not stand in a column named {column}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{fields}, n_tokens int, ids binary, decoded string")


def decode(rows: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """All columns of rows and `decoded`: the text of the ids in a binary column as encode() gives it; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [None if x is None else own.model.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    kept = [c for c in rows.columns if c != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in kept]).schema)
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{fields}, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents and what they decode to, as digests."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
