"""Lexical retrieval packing.

Documents become token ids; what fills whole windows is cut off. The remainders of all documents stand in one order by
content: by their rarest token (the vocabulary lists frequent ones first), then by a hash of the next one, then by a hash of
text and doc_id, so that texts that share rare words stand together. Counts of all remainders by the first two keys - a table
bounded by the vocabulary - cut that order into shards of about SHARD, a common word or a group of copies into as many as it
needs; where a remainder goes depends on the texts alone, not on how the input is dealt. A shard is an inverted index: for
each token its remainders and their BM25 weights, with document frequencies and mean length from all documents. The longest
unused remainder seeds a window; the index returns its unused neighbours, best first, and those that fit fill it. A gap that
none fits is closed with the head of the best neighbour, whose tail stays unused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, table
from .tokens import Known, encode, vocabulary
from .vectors import texts

#: Remainders of a shard, roughly; the shortest gap worth a cut; BM25's parameters; values of the second key's hash.
SHARD, MIN_GAP, K1, B, NEXT = 1024, 16, 1.2, 0.75, 16
END = 1
_PIECE = "cell long, place long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def cell(ids: np.ndarray) -> int:
    """Where ids stand in the order by content: the rarest token, and a hash of the next one."""
    top = ids.max()
    return int(top) * NEXT + (int((ids * (ids != top)).max()) * 0x9E3779B97F4A7C15 >> 32) % NEXT


def tokenized(docs: DataFrame, window: int, with_ids: bool, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents: whole windows, and remainders with their ids. Last rows of each task: tokens and the documents there that have them; cells and the remainders there."""
    names = ["cell", "place", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "token", "df", "cells", "rests"]
    kinds = [pa.int64()] * 7 + [pa.binary()] + [pa.list_(pa.int64())] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = vocabulary(json_path)
        df, rests, seat = np.zeros(size, np.int64), np.zeros(size * NEXT, np.int64), np.zeros(size, np.int64)
        width, known, seen, task = _width(size), Known(), {}, TaskContext.get().partitionId()
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j, data, at in texts(batch):
                ids, begin = encode(data, at, json_path, ranks_path, known)
                ids, begin = np.insert(ids, begin[1:], np.uint32(END)), begin + np.arange(len(begin))
                count = np.arange(np.diff(begin).max())
                rows = []
                for d, a, b in zip(doc_ids[i:j], begin[:-1], begin[1:], strict=True):
                    own = ids[a:b]
                    seat[own] = count[: len(own)]  # of equal tokens one keeps its seat
                    df[own[seat[own] == count[: len(own)]]] += 1
                    last = own[(len(own) - 1) // window * window :]
                    where, crc = cell(last), _crc(last)
                    key = (d, len(own), crc)
                    # repeated rows of one task stand apart, so that any number of them is dealt over shards
                    again = seen[key] = seen.get(key, -1) + 1
                    place = int.from_bytes(hashlib.blake2b(f"{crc} {d} {len(own)} {again} {task if again else 0}".encode(), digest_size=8).digest()) >> 1
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        whole = len(piece) == window
                        rests[where] += not whole
                        rows.append((where, place, d, s, len(piece), _crc(piece) if whole else None, len(own), None if whole and not with_ids else piece.astype(width).tobytes(), None, None, None, None))
                if len(seen) > 1 << 17:
                    seen.clear()
                    task += 1 << 32
                if rows:
                    yield batch_of(rows)
        t, c = np.flatnonzero(df), np.flatnonzero(rests)
        yield batch_of([(None,) * 8 + (t.tolist(), df[t].tolist(), c.tolist(), rests[c].tolist())])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE + ", token array<long>, df array<long>, cells array<long>, rests array<long>")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _sums(rows: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """Sums by a key below `size`, which the vocabulary bounds."""
    found = rows.where(f"{key} is not null").select(F.explode(F.arrays_zip(key, value)).alias("x")).groupBy(F.col(f"x.{key}").alias("k")).agg(F.sum(f"x.{value}").alias("v")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return out


def dealt(pieces: DataFrame, before: np.ndarray, count: np.ndarray) -> DataFrame:
    """pieces with their shard: by their place in the order, `before` remainders stand before a cell, which has `count`."""
    order = pieces.sparkSession.sparkContext.broadcast((before, count))
    names = [c for c in pieces.columns if c not in ("cell", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, count = order.value
        for b in batches:
            at, place = b.column("cell").to_numpy(), b.column("place").to_numpy()
            shard = (before[at] + np.floor(place / 2.0**63 * count[at]).astype(np.int64)) // SHARD
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[b.column(c) for c in names]], ["shard", *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return pieces.mapInArrow(run, f"shard long, {fields}")


class Index:
    """BM25 inverted index of a shard's remainders."""

    def __init__(self, ids: list[np.ndarray], df: np.ndarray, n: int, mean: float):
        self.n, self.left = len(ids), len(ids)
        size = np.array([len(x) for x in ids])
        key = np.sort(np.concatenate(ids).astype(np.int64) * self.n + np.repeat(np.arange(self.n), size))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(new, len(key)))
        token, self.doc = np.divmod(key[new], self.n)
        idf = np.log1p((n - df[token] + 0.5) / (df[token] + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))
        self.at = np.append(0, np.cumsum(np.bincount(token, minlength=len(df))))
        self.terms = np.split(token[np.argsort(self.doc, kind="stable")], np.cumsum(np.bincount(self.doc))[:-1])

    def scores(self, k: int, used: np.ndarray | None = None) -> np.ndarray:
        """BM25 of each remainder for the terms of the k-th. Postings of used ones, whose scores are open, are dropped when they are an eighth."""
        if used is not None and (left := self.n - np.count_nonzero(used)) < self.left * 7 // 8:
            keep, self.left = ~used[self.doc], left
            self.at = np.append(0, np.cumsum(keep))[self.at]
            self.doc, self.weight = self.doc[keep], self.weight[keep]
        t = self.terms[k]
        a, size = self.at[t], self.at[t + 1] - self.at[t]
        end = np.cumsum(size)
        i = np.repeat(a - (end - size), size) + np.arange(end[-1])
        return np.bincount(self.doc[i], self.weight[i], minlength=self.n)


def fill(length: np.ndarray, neighbours, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (remainder, start in it, tokens). neighbours(k, used): a score for each remainder that isn't used."""
    start, left, used = np.zeros(len(length), np.int64), length.copy(), np.zeros(len(length), bool)
    for seed in np.argsort(-length, kind="stable"):
        if used[seed]:
            continue
        out, room = [(int(seed), int(start[seed]), int(left[seed]))], window - int(left[seed])
        used[seed] = True
        if room and not used.all():
            free = np.flatnonzero(~used)
            order = free[np.argsort(-neighbours(int(seed), used)[free], kind="stable")]
            while room and len(order):
                fits = np.flatnonzero(left[order] <= room)
                if len(fits):
                    k = int(order[fits[0]])
                    out.append((k, int(start[k]), int(left[k])))
                    room -= int(left[k])
                    used[k] = True
                    order = order[fits[0] + 1 :] if left[order[: fits[0]]].min(initial=window) > room else np.delete(order, fits[0])
                    order = order[~used[order]]
                    continue
                if room >= MIN_GAP:
                    k = int(order[0])
                    out.append((k, int(start[k]), room))
                    start[k] += room
                    left[k] -= room
                break
        yield out


def packed(docs: DataFrame, window: int = 2048, with_ids: bool = False, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request ids (little-endian, 16 bits each, 32 for vocabularies beyond 65,536).

    A document's ids are those of its text, then id 1; null text counts as empty and gives id 1 alone. Every id is in
    exactly one piece. Repeated rows are packed as rows of their own, also under a null doc_id. Sequences hold `window`
    ids at most. An empty table gives an empty result; other columns of docs are ignored.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "packing")
    size = vocabulary(json_path)
    rows = store.write(tokenized(docs, window, with_ids, json_path, ranks_path), "pieces")
    pieces = rows.where("cell is not null").drop("token", "df", "cells", "rests")
    df, count = _sums(rows, "token", "df", size), _sums(rows, "cells", "rests", size * NEXT)
    total = pieces.agg(F.count_if(F.col("start") == 0).alias("n"), F.sum("length").alias("tokens")).first()
    n, mean = total["n"], (total["tokens"] or 0) / max(1, total["n"])
    stats = spark.sparkContext.broadcast((df, n, mean))
    width = _width(size)

    def shard(t: pa.Table) -> pa.Table:
        df, n, mean = stats.value
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        rows = t.to_pylist()
        base, no, out = (rows[0]["shard"] << 32), 0, []
        for r in rows:
            if r["length"] == window:
                out.append((r["doc_id"], r["start"], window, r["ids_crc32"], r["doc_tokens"], base + no, 0, *[r["ids"]] * with_ids))
                no += 1
        rest = [r for r in rows if r["length"] < window]
        if rest:
            ids = [np.frombuffer(r["ids"], width) for r in rest]
            index = Index(ids, df, n, mean)
            for members in fill(np.array([len(x) for x in ids]), index.scores, window):
                offset = 0
                for k, s, size in members:
                    piece = ids[k][s : s + size]
                    out.append((rest[k]["doc_id"], rest[k]["start"] + s, size, _crc(piece), rest[k]["doc_tokens"], base + no, offset, *[piece.tobytes()] * with_ids))
                    offset += size
                no += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        return pa.table([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(zip(*out, strict=True), names, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt(pieces, np.cumsum(count) - count, count).groupBy("shard").applyInArrow(shard, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """packed() of all rows, in windows of 2048: nulls, ties, repeated rows, empty tables and other columns as there."""
    return packed(docs)
