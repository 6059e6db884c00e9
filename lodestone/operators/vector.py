"""Vector search: exact top-k by blocks, thresholds and neighbours; vector_index.py has the approximate search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .best import BLOCK, Best, by_id
from .relational import topk_per

#: Query vectors that one pass compares with all rows (each 8 bytes a dimension).
QUERIES = 4096


def cosine(column: Column | str, q: Sequence[float]) -> Column:
    """Cosine similarity with a given vector; null for zero vectors."""
    v = F.transform(F.col(column) if isinstance(column, str) else column, lambda x: x.cast("double"))
    q = [float(x) for x in q]
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    dot = add(F.zip_with(v, F.array(*[F.lit(x) for x in q]), lambda a, b: a * b))
    return dot / F.nullif(F.sqrt(add(F.transform(v, lambda x: x * x))) * float(np.linalg.norm(q)), F.lit(0.0))


def vector_topk(df: DataFrame, q: Sequence[float], k: int = 10, where: Column | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: id, similarity. Filters come before the limit."""
    rows = df.filter(where) if where is not None else df
    return rows.select(id, cosine(vector, q).alias("similarity")).filter("similarity is not null").orderBy(F.desc("similarity"), id).limit(k)


def vector_above(df: DataFrame, q: Sequence[float], t: float = 0.5, k: int = 10, where: Column | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
    rows = df.filter(where) if where is not None else df
    return rows.select(id, cosine(vector, q).alias("similarity")).filter(F.col("similarity") > t).orderBy(F.desc("similarity"), id).limit(k)


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vector_topk_batch(df: DataFrame, queries: DataFrame, k: int, above: float | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to each query (id, embedding): query_id, id, similarity.

    Queries go in passes of QUERIES, which each task compares with BLOCK pairs at once. A task keeps k rows a query, however many batches it
    reads, so what it holds and what is shuffled is small. Similarities are rounded to 12 digits: equal vectors tie wherever they stand in a block.
    """
    spark, n = df.sparkSession, queries.count()
    kind = df.schema[id].dataType
    out_schema = T.StructType([T.StructField("query_id", queries.schema[id].dataType), T.StructField("id", kind), T.StructField("similarity", T.DoubleType())])
    passes, out = max(1, -(-n // QUERIES)), None
    for p in range(passes):
        part = queries.select(id, vector).filter(F.pmod(F.xxhash64(id), F.lit(passes)) == p).orderBy(id).toArrow().combine_chunks()
        batch = part.to_batches()[0] if part.num_rows else None
        m = _matrix(batch.column(1)) if batch else np.zeros((0, 1))
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((part.column(0).to_pylist(), np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best, step = Best(len(ids), k), max(1, BLOCK // max(1, len(ids)))
            for b in batches if ids else ():
                b = by_id(b, id)
                v = _matrix(b.column(vector))
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)
                for at in range(0, len(v), step):
                    s = np.round(q @ v[at : at + step].T, 12)
                    best.block(np.where(s > (-np.inf if above is None else above), s, -np.inf), b.column(id).slice(at, step))
            yield from best.rows(pa.array(ids, part_type), "similarity")

        part_type = part.column(0).type
        one = df.select(id, vector).filter(F.col(vector).isNotNull()).mapInArrow(run, out_schema)
        out = one if out is None else out.unionByName(one)
    return topk_per(out, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def neighbours_by_vector(df: DataFrame, items: DataFrame, t: float = 0.85, k: int = 5) -> DataFrame:
    """For each item (id, embedding) the k nearest other rows above t."""
    found = vector_topk_batch(df, items, k + 1, t)
    return topk_per(found.filter("query_id <> id"), ["query_id"], [F.desc("similarity"), F.asc("id")], k)
