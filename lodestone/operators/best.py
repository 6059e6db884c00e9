"""The k best rows of each query among those that one task sees, in memory that doesn't grow with the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores (queries times rows) that are held at once.
BLOCK = 1 << 20
_LOWEST = -np.finfo(np.float64).max


def by_id(batch: pa.RecordBatch, id: str) -> pa.RecordBatch:
    """The rows in the order of their ids, nulls first, as Spark sorts them."""
    return batch.take(pc.sort_indices(batch.column(id), null_placement="at_start"))


class Best:
    """Scores from great to small, equal ones by id. At most 3 * k rows a query and a block's are held."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, _LOWEST)
        self.parts, self.new = [], 0

    def block(self, scores: np.ndarray, ids: pa.Array, queries: np.ndarray | None = None) -> None:
        """Takes a row of scores for each query, or each of `queries`, in the order of ids that rise; -inf stands for no hit."""
        if not scores.size:
            return
        own = np.arange(len(self.least)) if queries is None else queries
        some = np.flatnonzero(scores.max(1) >= self.least[own])
        scores, own = scores[some], own[some]
        cut = self.least[own]
        if len(some) and scores.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(scores, -self.k, axis=1)[:, -self.k])
        over, equal = scores > cut[:, None], scores == cut[:, None]
        equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= self.k  # of equal ones the smallest ids are enough
        i, j = np.nonzero(over | equal)
        self.add(own[i], scores[i, j], ids.take(pa.array(j)))

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Takes single hits."""
        if len(queries):
            self.parts.append(pa.RecordBatch.from_arrays([pa.array(queries.astype(np.int32)), pa.array(scores, pa.float64()), ids], ["query", "score", "id"]))
            self.new += len(queries)
        if self.new > 2 * self.k * len(self.least) + 4096:
            self._prune()

    def _prune(self) -> None:
        if not self.parts:
            return
        rows = pa.Table.from_batches(self.parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        query = rows.column("query").to_numpy()
        no = np.arange(len(query)) - np.searchsorted(query, query)
        last = no == self.k - 1
        self.least[query[last]] = rows.column("score").to_numpy()[last]
        self.parts, self.new = rows.filter(pa.array(no < self.k)).combine_chunks().to_batches(), 0

    def rows(self, queries: pa.Array, score: str) -> Iterator[pa.RecordBatch]:
        """query_id, id and the score."""
        self._prune()
        for b in self.parts:
            yield pa.RecordBatch.from_arrays([queries.take(b.column("query")), b.column("id"), b.column("score")], ["query_id", "id", score])
