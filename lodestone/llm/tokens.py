"""Byte-level BPE ids for whole batches of texts.

The vocabulary's pre-tokenizer always cuts before a space that stands between two characters other than white space. So a
batch is cut there, equal cuts are encoded once (they are hashed with NumPy), and the ids are laid out again by index. A
task remembers the cuts that it has encoded, for later batches. Texts with white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa

from .vectors import hash_spans

#: Cuts that a task remembers, and eight times as many ids; beyond that it forgets all.
MEMORY = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that white space beyond ASCII and control characters begin with, and what they are.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@functools.cache
def _tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@functools.cache
def vocabulary(path: str | None = None) -> int:
    """One more than the greatest id."""
    return max(_tokenizer(path).get_vocab().values()) + 1


@functools.cache
def _encoding(path: str | None):
    """The same vocabulary by ranks, and for texts without two white spaces in a row, whose pattern needs not look ahead; and the length in bytes of each id."""
    import tiktoken

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, i in ranks.items():
        length[i] = len(word)
    # no special token is ever allowed; without any, the encoder would stop at each character to look for one
    of = lambda pattern: tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(length)})
    return of(public_tokenizers.PATTERN), of(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")), length


class Known:
    """The cuts that a task has encoded, by two hashes: the row of each, and where its ids stand."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.other, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def rows(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The row of each cut, -1 for those not known."""
        if not len(self.hash):
            return np.full(len(h), -1)
        order = np.argsort(h)  # a sorted search is faster
        k = np.zeros(len(h), np.int64)
        k[order] = np.minimum(np.searchsorted(self.hash, h[order]), len(self.hash) - 1)
        row = self.row[k]
        return np.where((self.hash[k] == h) & (self.other[row] == other), row, -1)

    def add(self, h: np.ndarray, other: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The rows of new cuts, whose ids follow one another."""
        row = len(self.first) + np.arange(len(h))
        order = np.argsort(h)
        k = np.searchsorted(self.hash, h[order])
        self.hash, self.row = np.insert(self.hash, k, h[order]), np.insert(self.row, k, row[order])
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.other, self.count, self.ids = np.append(self.other, other), np.append(self.count, count), np.append(self.ids, ids)
        return row


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `count` of them."""
    done = np.cumsum(count)
    return np.repeat(first - (done - count), count) + np.arange(done[-1] if len(done) else 0)


def _encoded(data: np.ndarray, s: np.ndarray, e: np.ndarray, space: np.ndarray, odd: np.ndarray, json_path: str | None, ranks_path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each of data[s:e] has, and all ids one after another. odd: what `tokenizers` must encode."""
    exact, simple, length = _encoding(ranks_path)
    plain = (data[s] == 32) & (e - s > 1) & ~space[np.minimum(s + 1, len(data) - 1)] & ~space[e - 1] & ~odd
    runs = np.cumsum(np.append(False, space[1:] & space[:-1]), dtype=np.int32)
    run = runs[e - 1] > runs[s]
    parts, order, counts = [], [], []
    for encoding, which in ((simple, np.flatnonzero(plain & ~run)), (exact, np.flatnonzero(plain & run))):
        if len(which):
            size = (e - s)[which]
            ids = np.asarray(encoding.encode_to_numpy(data[_spread(s[which], size)].tobytes().decode(), disallowed_special=()), np.uint32)
            edge = np.searchsorted(np.cumsum(length[ids]), np.cumsum(size), "left") + 1
            parts.append(ids)
            order.append(which)
            counts.append(np.diff(np.append(0, edge)))
    for u in np.flatnonzero(~plain).tolist():
        text = data[s[u] : e[u]].tobytes().decode()
        parts.append(np.array(_tokenizer(json_path).encode(text, add_special_tokens=False).ids if odd[u] else exact.encode_ordinary(text), np.uint32))
        order.append([u])
        counts.append([len(parts[-1])])
    order, counts = np.concatenate(order), np.concatenate(counts)
    count, first = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    count[order], first[order] = counts, np.cumsum(counts) - counts
    return count, np.concatenate(parts)[_spread(first, count)]


def encode(data: np.ndarray, at: np.ndarray, json_path: str | None = None, ranks_path: str | None = None, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (bytes and offsets) one after another, and where each text's begin, and the end. known: cuts of earlier calls for the same vocabulary."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    odd = np.zeros(n, bool)
    if _LEAD[data].any() and _ODD.search(raw := data.tobytes()):
        odd[[i for i in range(n) if _ODD.search(raw, at[i], at[i + 1])]] = True
    space = _SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
    full = at[1:] > at[:-1]
    last = at[1:][full] - 1
    cut[last] = False
    for i in np.flatnonzero(odd):
        cut[at[i] : at[i + 1]] = False
    cut[at[:-1][full]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    found = pa.array(hash_spans(data, starts, ends)).dictionary_encode()
    h, which = found.dictionary.to_numpy(), found.indices.to_numpy()
    one = np.zeros(len(h), np.int64)
    one[which] = np.arange(len(which))
    s, e = starts[one], ends[one]
    known, other = known or Known(), hash_spans(data, s, e, 1)
    if len(known.hash) > MEMORY or len(known.ids) > 8 * MEMORY:
        known.forget()
    row = known.rows(h, other)
    new = np.flatnonzero(row < 0)
    if len(new):
        is_odd = odd[np.searchsorted(at, s[new], "right") - 1]
        row[new] = known.add(h[new], other[new], *_encoded(data, s[new], e[new], space, is_odd, json_path, ranks_path))
    per = known.count[row][which]
    done = np.append(0, np.cumsum(per))
    return known.ids[_spread(known.first[row][which], per)], done[np.searchsorted(starts, at)]
