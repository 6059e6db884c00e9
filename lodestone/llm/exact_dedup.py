"""Exact dedup with a log-structured merge index.

Each task is a memtable over (digest -> best row): it flushes sorted digest runs, cut by digest prefix into buckets, each
with a Bloom filter. Compaction merges the runs of a bucket level by level; a digest that no other run's filter may hold
is passed on unmerged, the rest are merged and keep the smallest identifier. Rows whose digest the index holds more than
once are hits: their bytes are compared with those of the row that would stay, so that two texts that only share a
digest are never merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Store, salted_join, table

#: Entries of a memtable; runs that one merge takes; entries of a bucket, roughly.
MEMTABLE, FAN_IN, BUCKET = 1 << 18, 16, 100_000
#: Rows that are handled at once where texts are held.
PIECE = 500
_SPACE = b"\t\n\x0b\x0c\r "
_RUN = "bucket int, run string, digests binary, counts binary, lengths binary, ids binary, filter binary"


def _normal(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int]]:
    for text in batch.column("text"):
        t = text.as_py() or ""
        yield t.encode().translate(None, _SPACE), len(t)


def digests(docs: DataFrame, size: int = 32, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_cp (code points), sha256 of the normalised text, its first `size` bytes as digest, and on request the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            rows = list(_normal(batch))
            sha = [hashlib.sha256(t).digest() for t, _ in rows]
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array([x.hex() for x in sha], pa.string()), pa.array([x[:size] for x in sha], pa.binary())]
            names = ["doc_id", "n_cp", "text_sha256", "digest"]
            if with_bytes:
                cols, names = [*cols, pa.array([t for t, _ in rows], pa.binary())], [*names, "bytes"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_cp long, text_sha256 string, digest binary" + ", bytes binary" * with_bytes)


def _bits(digest: np.ndarray, m: int) -> np.ndarray:
    """Four filter positions of each digest (rows of bytes)."""
    h = np.zeros((len(digest), 8), np.uint8)
    h[:, : min(8, digest.shape[1])] = digest[:, -8:]
    h = h.view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([(h >> np.uint64(s)) % np.uint64(m) for s in (0, 11, 23, 37)])


def _filter(digest: np.ndarray) -> bytes:
    m = 16 * max(8, len(digest))
    bits = np.zeros(m, np.uint8)
    bits[_bits(digest, m)] = 1
    return np.packbits(bits).tobytes()


def _may_hold(f: bytes, digest: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(f, np.uint8)
    at = _bits(digest, 8 * len(bits)).astype(np.int64)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _best(digest: np.ndarray, counts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per digest, sorted: the counts summed, the longest text's, then the smallest id."""
    keys = [digest[:, i] for i in range(digest.shape[1] - 1, -1, -1)]
    order = np.lexsort([ids, -lengths, *keys])
    digest, counts, lengths, ids = digest[order], counts[order], lengths[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return digest[first], np.add.reduceat(counts, first) if len(first) else counts, lengths[first], ids[first]


#: A null id sorts behind all others.
_NULL = np.iinfo(np.int64).max


def runs(rows: DataFrame, buckets: int, size: int) -> DataFrame:
    """Sorted runs of the memtables, a row for each run and bucket."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], no: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        d, n, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        d, c, n, i = _best(d, np.ones(len(n), np.int64), n, i)
        two = np.zeros((len(d), 2), np.uint8)
        two[:, : min(2, size)] = d[:, :2]
        bucket = (two[:, 0].astype(np.int64) * 256 + two[:, 1]) * buckets >> 16
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        run = f"{TaskContext.get().partitionId():08d}-{no:06d}"
        col = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([run] * len(full)), col(d), col(c), col(n), col(i), pa.array([_filter(d[cut[b] : cut[b + 1]]) for b in full], pa.binary())], names=["bucket", "run", "digests", "counts", "lengths", "ids", "filter"])

    def memtable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, no = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                d = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, size)
                parts.append((d, batch.column("n_cp").to_numpy(False), batch.column("doc_id").fill_null(_NULL).to_numpy(False)))
                held += len(d)
            if held >= MEMTABLE:
                yield flush(parts, no)
                parts, held, no = [], 0, no + 1
        if parts:
            yield flush(parts, no)

    return rows.select("doc_id", "n_cp", "digest").mapInArrow(memtable, _RUN)


def merge(level: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]) -> tuple[np.ndarray, ...]:
    """Merges sorted runs (digests, counts, lengths, ids, filter): entries that no other run's filter may hold pass as they are."""
    alone, met = [], []
    for k, (d, c, n, i, _) in enumerate(level):
        hit = np.zeros(len(d), bool)
        for j, other in enumerate(level):
            if j != k:
                hit |= _may_hold(other[4], d)
        alone.append((d[~hit], c[~hit], n[~hit], i[~hit]))
        met.append((d[hit], c[hit], n[hit], i[hit]))
    merged = _best(*(np.concatenate(x) for x in zip(*met, strict=True)))
    d, c, n, i = (np.concatenate(x) for x in zip(*alone, merged, strict=True))
    order = np.lexsort([d[:, k] for k in range(d.shape[1] - 1, -1, -1)])
    return d[order], c[order], n[order], i[order]


def compact(run_rows: DataFrame, size: int) -> DataFrame:
    """All runs of each bucket merged, FAN_IN at a time: digest, group_size, best_cp, best_id. A run holds a digest once, however often it occurs."""

    def bucket(t: pa.Table) -> pa.Table:
        level = [
            (np.frombuffer(r["digests"], np.uint8).reshape(-1, size), *(np.frombuffer(r[k], np.int64) for k in ("counts", "lengths", "ids")), r["filter"])
            for r in sorted(t.to_pylist(), key=lambda r: r["run"])
        ]
        while len(level) > 1:
            nxt = [merge(level[k : k + FAN_IN]) for k in range(0, len(level), FAN_IN)]
            level = [(*x, _filter(x[0])) for x in nxt]
        d, c, n, i, _ = level[0]
        return pa.table({"digest": pa.array([x.tobytes() for x in d], pa.binary()), "group_size": c, "best_cp": n, "best_id": pa.array(i, mask=i == _NULL)})

    return run_rows.groupBy("bucket").applyInArrow(bucket, "digest binary, group_size long, best_cp long, best_id long")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the longest
    original (code points) stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat the row that stays
    (same doc_id and length) are counted, and one of them is kept. An empty table gives an empty result; other columns of
    docs are ignored. digest_bytes shortens the index's digest (tests make digests collide with it).
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "exact_dedup")
    rows = store.write(digests(docs, digest_bytes), "digests")
    buckets = 1 << max(6, (rows.count() // BUCKET).bit_length())
    flushed = store.write(runs(rows, min(buckets, 1 << 16), digest_bytes), "runs")
    index = store.write(compact(flushed, digest_bytes), "index")
    hits = index.where("group_size > 1")

    alone = rows.join(hits.select("digest"), "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    met = store.write(digests(docs, digest_bytes, with_bytes=True).join(hits, "digest"), "hits")
    stays = met.where(F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_cp") == F.col("best_cp")))
    keeper = stays.groupBy("digest").agg(F.min("bytes").alias("keeper_bytes"), F.first("group_size").alias("group_size"))
    checked = salted_join(met, keeper, "digest", "group_size").select(
        "digest", "doc_id", "n_cp", "text_sha256", F.when(F.col("bytes") != F.col("keeper_bytes"), F.col("bytes")).alias("other")
    )
    checked = store.write(checked, "checked")
    per_class = checked.groupBy("digest", "other").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("best"))
    same = [F.col("a.digest") == F.col("b.digest"), F.col("a.other").eqNullSafe(F.col("b.other"))]
    out = checked.alias("a").join(per_class.alias("b"), same).select("a.digest", "a.other", "a.doc_id", "a.text_sha256", F.col("b.best.id").alias("keep_id"), "b.group_size", (F.col("a.doc_id").eqNullSafe(F.col("b.best.id")) & (-F.col("a.n_cp") == F.col("b.best.n"))).alias("best"))
    first = F.row_number().over(Window.partitionBy("digest", "other").orderBy("doc_id")) == 1
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = out.where("best").withColumn("kept", first).select(result)
    return alone.unionByName(kept).unionByName(out.where("not best").withColumn("kept", F.lit(False)).select(result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
