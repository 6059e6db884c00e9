"""What the operators share: the cluster's shared folder, and skew-safe joins."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a temporary one of this process in local mode, and an error on a cluster, whose executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return (path or _own_dir()).rstrip("/")


#: Rounds that connected components may take: their number is logarithmic in the longest path.
STEPS = 60


class Store:
    """Tables of one run in the shared folder: written once, they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_digest(text: str = "text") -> Column:
    """128 bits that tell the texts under one doc_id, or without one, apart; null for null."""
    return F.unhex(F.md5(text))


def salted_join(many: DataFrame, one: DataFrame, key: str, weight: str, how: str = "inner", per_salt: int = 1024) -> DataFrame:
    """many ⋈ one on key, where `one` holds a row per key and the number of its matches in column `weight`.

    A key with w matches is dealt over ceil(w / per_salt) join keys: its rows of `many` by a random salt fixed by the
    row's contents, its row of `one` copied to each salt. `many` must carry the column `weight` too.
    """
    salts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / per_salt)).cast("int")
    left = many.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), salts(weight)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts(weight) - 1))).drop(weight)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(links: DataFrame, spark: SparkSession, store: Store, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (id, component = smallest reachable id), for the linked ids only.

    Alternating large-star and small-star steps: each takes minima by id (partial ones before the shuffle) and joins them
    back, and the number of steps is logarithmic. The links stay on the executors; each round is a table in the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = store.write(edges, f"{name}_0")
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    for step in range(1, STEPS + 1 if before[0] else 1):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = store.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}_{step}")
        now = state(new)
        if now == before:
            break
        before = now
        edges = new
    else:
        if before[0]:
            raise RuntimeError(f"no components after {STEPS} steps")
    out = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return out.unionByName(edges.select(F.col("v").alias("id")).distinct().join(out.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
