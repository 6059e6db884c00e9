"""NumPy over the bytes of an Arrow string column: words, hashes of words and of word shingles.

Every function handles a whole batch of texts at once; `slices` keeps the temporaries to a few times SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.arange(256)
#: Bytes of words: all but the ASCII white space [\x20\x09-\x0D]; or ASCII letters and digits and all beyond ASCII.
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins, and the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes, and where each text's words begin in that list, and the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = w[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = w[ends]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes at a time."""
    length = ends - starts
    h = mix(length.astype(np.uint64) * _K1 + np.uint64(seed))
    if not len(starts):
        return h
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(length, 8)]))
    at, more = 8, np.flatnonzero(length > 8)
    while len(more):
        left = length[more] - at
        h[more] = mix(h[more] * _K1 ^ (lanes[starts[more] + at] & _MASK[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    return h


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k hashes that follow one another."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= _K1
        out += h[j : j + n]
    return mix(out)


def whole(h: np.ndarray) -> np.uint64:
    """One hash of a short sequence of hashes, apart from those of roll()."""
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * _K2 + x
    return mix(np.array([out], np.uint64))[0]


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: the first and last row, their bytes and offsets."""
    data, offsets = flat(batch.column(column))
    for i, j in slices(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles: lower-cased A-Z, words between ASCII white space. A text with fewer words has its whole sequence as one; one without words has none."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, NOT_SPACE)
    h = hash_spans(data, starts, ends)
    s = roll(h, k)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        out.append(np.unique(s[a : b - k + 1]) if b - a >= k else np.array([whole(h[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def binary_rows(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
