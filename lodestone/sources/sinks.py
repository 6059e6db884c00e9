"""Upserts, inserts, replacements and deletions on tables, as DataFrames that a sink then writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import first_per
from ..session import shared_dir as shared_dir


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The target after the changes: the change of a key wins; of several changes the last by `order`."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_per(rows, keys, [F.desc("_new"), *[F.desc(o) for o in order]]).drop("_new")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks, each key once."""
    return first_per(rows.join(target.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def replace_parents(target: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The target with all rows of the parents in `rows` replaced by them."""
    return target.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def cascade_delete(roots: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """How many rows go with the roots: table, deleted. children: name -> (table, its parent column, its own key), parents first."""
    gone = roots.select(F.col(key).alias("_k"))
    out = gone.agg(F.count("*").alias("deleted")).withColumn("table", F.lit("root"))
    for name, (df, parent, own) in children.items():
        dead = df.join(gone, df[parent] == F.col("_k"), "left_semi")
        out = out.unionByName(dead.agg(F.count("*").alias("deleted")).withColumn("table", F.lit(name)))
        gone = dead.select(F.col(own).alias("_k")).distinct()
    return out.select("table", "deleted")


def backfill_default(df: DataFrame, column: str, default: object, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """df with the column added or its nulls filled, and the keys (with the column) that aren't unique."""
    filled = df.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default))
    return filled, filled.groupBy(*keys, column).count().filter("count > 1")


def embed_input(df: DataFrame, text: str, most: int = 8000) -> DataFrame:
    """Rows with a text, cut at `most` characters."""
    return df.filter(F.length(F.trim(text)) > 0).withColumn(text, F.substring(text, 1, most))


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 - 2 * (h >> 31)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    return embed


def backfill_embeddings(df: DataFrame, id: str, text: str, vector: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """id and embedding of the rows without a vector that have a text, in batches."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column(id), pa.array(embed(part.column(text).to_pylist()), pa.list_(pa.float64()))], [id, vector])

    return embed_input(df.filter(F.col(vector).isNull()), text).select(id, text).mapInArrow(run, f"{id} {kind}, {vector} array<double>")


def write_summary(df: DataFrame, path: str) -> None:
    """A JSON line a row."""
    df.write.mode("overwrite").json(path)
