"""A table that lasts over upserts: key-hash buckets, of which a batch writes only those that it touches.

Each bucket has two slots. A batch writes the new rows of a touched bucket into the slot that isn't live, with dynamic
partition overwrite, and then one small manifest that names the live slot of every bucket and the batch. Readers follow the
last manifest, so they never see half a batch, and a batch that is tried again either was finished, and nothing happens, or
starts anew from what the last finished one left. Old rows go when their slot is written again: there are two versions at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import first_per

#: Manifests that are kept.
KEEP = 4


class BucketTable:
    """The last row of each key by `order`. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, list(keys), list(order), buckets

    def _live(self) -> tuple[int, dict[int, int]]:
        """The last finished batch (-1 for none) and the live slot of each bucket that has rows."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest").collect()  # KEEP * buckets rows at most
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        last = max((r["batch"] for r in rows), default=-1)
        return last, {r["bucket"]: r["slot"] for r in rows if r["batch"] == last and r["bucket"] >= 0}

    def _rows(self, live: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/bucket={b}/slot={s}" for b, s in sorted(live.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._live()[1])

    def apply(self, batch: DataFrame, no: int) -> list[int]:
        """Takes the batch in, and gives the buckets that were written: none for a batch that is in already. Batches come in ascending order of `no`, from 0."""
        last, live = self._live()
        if no <= last:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = first_per(batch.select(*self.schema.names), self.keys, [F.desc(o) for o in self.order])
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # numbers of buckets
        if touched:
            before = self._rows({b: s for b, s in live.items() if b in touched})
            rows = first_per(before.unionByName(new), self.keys, [F.desc(o) for o in self.order]).withColumn("bucket", bucket)
            slots = {b: 1 - live.get(b, 1) for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("bucket"))
            rows.withColumn("slot", slot).repartition("bucket").write.partitionBy("bucket", "slot").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/data")
            live |= slots
        manifest = self.spark.createDataFrame([(no, b, s, no % KEEP) for b, s in live.items()] or [(no, -1, 0, no % KEEP)], "batch long, bucket int, slot int, kept int")
        manifest.coalesce(1).write.partitionBy("kept").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/manifest")
        return touched
