"""Rows that hold phrases, for tables of phrases: all phrases are looked for at once in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best import by_id
from .relational import topk_per

#: Distinct phrases that one pass looks for, at most; more go in further passes. The same where only the first rows of each are wanted, and rows between two looks at which phrases have theirs.
PHRASES = 4096
FIRST, LOOK = 1 << 16, 256


def holding(df: DataFrame, phrases: DataFrame, id: str, text: str, phrase: str, most: int | None = None) -> DataFrame:
    """id, phrase: each row with each distinct phrase that stands in its text, as it is. Null and empty phrases stand in no text."""
    import ahocorasick

    most = most or PHRASES
    spark, kind, out = df.sparkSession, df.schema[id].dataType.simpleString(), None
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter("phrase <> ''").distinct()
    parts = max(1, -(-wanted.count() // most))
    for k in range(parts):
        known = spark.sparkContext.broadcast([r[0] for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k).collect()])

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for p in known.value:
                machine.add_word(p, p)
            if known.value:
                machine.make_automaton()
            for b in batches:
                found = [(i, p) for i, t in enumerate(b.column("_text").to_pylist()) if t and known.value for p in {p for _, p in machine.iter(t)}]
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array([i for i, _ in found], pa.int64())), pa.array([p for _, p in found], pa.string())], ["_id", "phrase"])

        part = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, phrase string")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("_id").alias(id), "phrase")


def first_holding(df: DataFrame, phrases: DataFrame, k: int, id: str, text: str, phrase: str) -> DataFrame:
    """id, phrase: of the rows of holding() the k with the smallest ids for each phrase; rows that share an id count each.

    A task keeps k ids a phrase, however many of its rows hold it, and stops to look for a phrase where no smaller id can come.
    `phrases` is read more than once.
    """
    import ahocorasick

    spark, kind = df.sparkSession, df.schema[id].dataType.simpleString()
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter("phrase <> ''").distinct()
    few = wanted.limit(FIRST + 1).toArrow().column("phrase").to_pylist()
    passes = 1 if len(few) <= FIRST else -(-wanted.count() // FIRST)
    order = lambda i: (i is not None, i)

    def part(p: int) -> DataFrame:
        known = spark.sparkContext.broadcast(few if passes == 1 else wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == p).toArrow().column("phrase").to_pylist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, list] = {w: [] for w in known.value}
            machine, within, of = None, None, None
            for b in batches:
                b, live, of = by_id(b, "_id"), list(best), b.column("_id").type
                ids, bodies = b.column("_id").to_pylist(), b.column("_text").to_pylist()
                for at in range(0, len(ids), LOOK):
                    live = [w for w in live if len(best[w]) < k or order(ids[at]) < order(best[w][-1])]
                    if not live:
                        break
                    if live != within:
                        machine, within = ahocorasick.Automaton(), live
                        for w in live:
                            machine.add_word(w, w)
                        machine.make_automaton()
                    new: dict[str, list] = {}
                    for i, t in zip(ids[at : at + LOOK], bodies[at : at + LOOK], strict=True):
                        for w in {w for _, w in machine.iter(t or "")}:
                            new.setdefault(w, []).append(i)
                    for w, own in new.items():
                        best[w] = sorted(best[w] + own, key=order)[:k]
            found = [(i, w) for w, own in best.items() for i in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], of), pa.array([w for _, w in found], pa.string())], ["_id", "phrase"])

        return df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, phrase string")

    rows = topk_per(reduce(DataFrame.unionByName, map(part, range(passes))), ["phrase"], ["_id"], k)
    return rows.select(F.col("_id").alias(id), "phrase")
