"""What a task holds and emits doesn't grow with the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.operators import retrieval as H
from lodestone.operators import vector as V
from lodestone.operators.best import Best
from lodestone.operators.vector_index import VectorIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_of_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_best_holds_few_rows_and_breaks_ties_by_id():
    rng = np.random.default_rng(2)
    s, best, held = rng.integers(0, 5, (3, 20_000)) / 4.0, Best(3, 7), 0
    for i in rng.permutation(200):
        best.block(s[:, i * 100 : i * 100 + 100], pa.array(range(i * 100, i * 100 + 100)))
        held = max(held, sum(b.num_rows for b in best.parts))
    got = {(r["query_id"], r["id"]) for b in best.rows(pa.array("abc"), "s") for r in b.to_pylist()}
    assert got == {(q, int(i)) for q, row in zip("abc", s, strict=True) for i in np.lexsort((np.arange(20_000), -row))[:7]} and held <= 3 * (3 * 7) + 4096 + 100


def test_equal_vectors_are_not_all_shuffled(spark):
    df = spark.range(5000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).coalesce(1)
    found = V.vector_topk_batch(df, df.filter("id < 2"), 3)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(q, i) for q in range(2) for i in range(3)]


def test_keyword_hits_are_ranked_in_the_task_that_reads_them(spark, monkeypatch):
    monkeypatch.setattr(H, "ASKED", 2)
    df = spark.range(3000).select("id", F.expr("concat('aa bb ', repeat('x ', int(id % 3)))").alias("text"))
    queries = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, "aa"), (4, "bb aa"), (5, "cc"), (6, None)], "query_id long, text string")
    found = H.keyword_topk_batch(df, queries, 2, substring=True)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(q, i) for q in (1, 2, 3, 4) for i in (0, 3)]
    assert "HashAggregate" not in plan(H._keyword_topk(df, queries.filter("query_id = 1"), 2, "all", None, True, "id", "text"))


def test_index_search_broadcasts_no_candidates(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "id long, embedding array<double>")
    found = VectorIndex.build(df, str(tmp_path / "i")).search(df.filter("id % 50 = 0"), 3)
    assert "BroadcastExchange" not in plan(found) and found.count() == 18


def test_joins_of_frequent_keys_are_dealt_by_their_result(spark, monkeypatch):
    monkeypatch.setattr(R, "PER_TASK", 500)
    a, b = spark.range(40).select((F.col("id") % 2).alias("k"), "id"), spark.range(400).select((F.col("id") % 2).alias("k"), F.col("id").alias("other"))
    found = R.even_join(a, b, "k", "other")
    assert found.count() == found.distinct().count() == 8000 and most_of_a_task(found) < 2500
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, a.join(b, "k").collect()))


def test_pairs_of_members_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "PER_TASK", 200)
    bridge = spark.range(1200).select((F.col("id") % 40).alias("event"), (F.col("id") * 7 % 301).alias("member"))
    found = R.coparticipants(bridge, "member", "event")
    x = bridge.distinct()
    want = x.alias("x").join(x.alias("y"), "event").filter("x.member <> y.member").select(F.col("x.member").alias("a"), F.col("y.member").alias("b")).distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and most_of_a_task(found) < 1600
