"""The stored keyword and vector indexes: equal to scans, opened again, and how little they read."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as H
from lodestone.operators import vector as V
from lodestone.operators.keyword_index import KeywordIndex
from lodestone.operators.vector_index import VectorIndex

SF = "/root/testdata/sf0.01"


def rounded(rows):
    return sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in rows.collect())


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """Rows of 1 to 300 words with a common word in a third of them, ties, null and empty texts; and an index of small blocks."""
    rnd = random.Random(1)
    rows = [(i, " ".join(["the"] * rnd.choice([0, 0, 1, 3]) + [f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.choice([1, 5, 40, 300]))])) for i in range(1500)]
    rows += [(5000 + i, "same Words here") for i in range(40)] + [(6000, None), (6001, ""), (6002, " .,; ")]
    df = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "the"), (2, "the w1 w2"), (3, "same words"), (4, "w40 w3 unknown"), (5, ""), (6, "w5 w1"), (7, "THE w5")], "query_id long, text string")
    path = str(tmp_path_factory.mktemp("keyword") / "index")
    KeywordIndex.build(df, path, block=32)
    return df, queries, path


@pytest.mark.parametrize("mode", ["all", "any"])
def test_keyword_index_is_exact(spark, words, mode):
    df, queries, path = words
    index = KeywordIndex(spark, path)
    got = rounded(index.keyword_topk(queries, 10, mode))
    assert got == rounded(H.keyword_topk_batch(df, queries, 10, mode)) and {q for q, *_ in got} >= {1, 2, 3}
    read, own, every = index.share()
    assert read < own < every


def test_keyword_index_bm25(spark, words):
    df, queries, path = words
    index = KeywordIndex(spark, path)
    assert rounded(index.bm25_topk(queries, 7)) == rounded(H.bm25_topk(df, queries, 7))


def test_keyword_index_reads_few_blocks_of_a_common_word(spark, words):
    """The best rows for one common word are short ones; blocks of long rows can't hold them."""
    _, queries, path = words
    index = KeywordIndex(spark, path)
    index.keyword_topk(queries.filter("query_id = 1"), 3).collect()
    read, own, _ = index.share()
    assert read < 0.5 * own


def test_keyword_index_terms_beyond_a_list(spark, words, monkeypatch):
    from lodestone.operators import keyword_index, retrieval

    df, queries, path = words
    want = rounded(H.keyword_topk_batch(df, queries, 5))
    monkeypatch.setattr(keyword_index, "LISTED", 2)
    monkeypatch.setattr(retrieval, "LISTED", 2)
    assert rounded(KeywordIndex(spark, path).keyword_topk(queries, 5)) == want == rounded(H.keyword_topk_batch(df, queries, 5))


def test_keyword_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    index = KeywordIndex.build(empty, str(tmp_path / "i"))
    assert index.keyword_topk(spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
    assert index.bm25_topk(spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_keyword_index_reads_texts_once(spark, tmp_path):
    """Building counts and deals what one pass over the texts has split."""
    seen = spark.sparkContext.accumulator(0)

    def count(t):
        seen.add(1)
        return t

    df = spark.range(300).select("id", F.udf(count, "string")(F.concat(F.lit("the w"), F.col("id") % 7)).alias("text"))
    index = KeywordIndex.build(df, str(tmp_path / "i"), block=32)
    assert seen.value == 300 and (index.docs, index.mean) == (300, 2)


@pytest.mark.parametrize("mode", ["all", "any"])
def test_keyword_index_of_many_queries(spark, words, tmp_path, monkeypatch, mode):
    """Hundreds of queries in several passes, by text ids, equal to scans; a task gives k rows a query on, not a row a hit."""
    from lodestone.operators import retrieval

    rnd = random.Random(2)
    df = words[0].withColumn("id", F.format_string("n%d", "id"))
    asked = [(f"q{i}", " ".join(rnd.choice(["the", f"w{rnd.randint(1, 9)}", f"w{rnd.randint(1, 300)}"]) for _ in range(rnd.randint(1, 3)))) for i in range(300)]
    queries = spark.createDataFrame([*asked, ("x", None), ("y", "w1 w2"), ("z", "w1 w2")], "query_id string, text string")
    index = KeywordIndex.build(df, str(tmp_path / "i"), block=64)
    scored, given = KeywordIndex._score, []
    monkeypatch.setattr(KeywordIndex, "_score", lambda self, *a: given.append(scored(self, *a)) or given[-1])
    monkeypatch.setattr(retrieval, "ASKED", 100)
    assert rounded(index.keyword_topk(queries, 5, mode)) == rounded(H.keyword_topk_batch(df, queries, 5, mode))
    assert rounded(index.bm25_topk(queries, 5)) == rounded(H.bm25_topk(df, queries, 5))
    assert len(given) >= 8 and all(d.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] in (None, 1, 2, 3, 4, 5) for d in given[:4])


def recall(got, want):
    got, want = ({(r["query_id"], r["id"]) for r in d.collect()} for d in (got, want))
    return len(got & want) / len(want)


def test_vector_index_on_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.filter("id % 50 = 0")
    VectorIndex.build(e, str(tmp_path / "i"))
    index = VectorIndex(spark, str(tmp_path / "i"))  # opened again
    assert recall(index.search(queries), V.vector_topk_batch(e, queries, 10)) >= 0.85  # 100 pairs; 0.92 is aimed at
    assert index.compared[0] < 0.25 * index.compared[1]
    every = index.search(queries, probes=len(index.centres), candidates=500, radius=256)
    assert recall(every, V.vector_topk_batch(e, queries, 10)) == 1


def test_vector_index_on_clusters(spark, tmp_path):
    """60 clusters and a third of all rows equal: few lists are probed, few rows compared, and the equal rows are dealt over blocks."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, [1.0] * 32) for i in range(2000)]
    df = spark.createDataFrame([*rows, (20_000, [0.0] * 32), (20_001, None)], "id long, embedding array<double>")
    queries = df.filter("id % 100 = 0")
    index = VectorIndex.build(df, str(tmp_path / "i"))
    true = V.vector_topk_batch(df, queries, 10)
    assert recall(index.search(queries), true) >= 0.9
    assert index.probes < 0.2 * len(index.centres) and index.compared[0] < 0.2 * index.compared[1]
    stored = spark.read.parquet(str(tmp_path / "i" / "vectors"))
    assert stored.count() == 6001 and stored.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 1500


def test_vector_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert VectorIndex.build(empty, str(tmp_path / "i")).search(spark.createDataFrame([(1, [1.0])], empty.schema)).count() == 0
