"""Incremental ingestion, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import first_per
from ..sources.buckets import BucketTable


def newer_than(df: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows above the target's high-water mark; all rows where the target is empty."""
    mark = target.agg(F.max(column).alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))).drop("_mark")


def latest_status(events: DataFrame, key: str, ts: str, tie: str, status: Column) -> DataFrame:
    last = events.groupBy(key).agg(F.max_by(F.struct(status.alias("status"), F.col(ts)), F.struct(ts, tie)).alias("_l"))
    return last.select(key, "_l.*")


def pending(status: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """Pending items, newest first, at most n."""
    return status.filter("status = 'pending'").orderBy(F.desc(ts), tie).limit(n)


def stale(df: DataFrame, ts: str, now: str, hours: int = 2) -> DataFrame:
    """Unfinished items older than `hours`."""
    return df.filter((F.col("status") != "completed") & (F.col(ts) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))


def dedup_hash(df: DataFrame, target: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """New contents: rows whose hash the target (hash) lacks, each hash once."""
    hashed = df.withColumn("hash", F.sha2(content, 256))
    return first_per(hashed.join(target.select("hash").distinct(), "hash", "left_anti"), ["hash"], order)


def cleanup_report(status: DataFrame, now: str, ts: str, key: str, empty: Column, duplicate: Column) -> DataFrame:
    """What a cleanup would delete, and why (the first reason that holds): key, reason."""
    old = (F.col("status") != "completed") & (F.col(ts) < F.lit(now).cast("timestamp") - F.expr("INTERVAL 2 HOURS"))
    reason = F.when(old, "stale").when((F.col("status") == "completed") & empty, "empty").when(duplicate, "duplicate")
    return status.select(key, reason.alias("reason")).filter("reason is not null")


def processed(status: DataFrame, ts: str, key: str) -> DataFrame:
    return status.filter("status = 'completed'").orderBy(F.desc(ts), key)


def observe_progress(df: DataFrame, name: str, *metrics: Column):
    """df with metrics that are known when it has run: (df, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *metrics), seen


# --- streams ------------------------------------------------------------------------------------------------------


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder; the query's checkpoint remembers which are done."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def dedup_stream(events: DataFrame, ts: str, content: str, late: str = "1 hour") -> DataFrame:
    """Each content once within the watermark."""
    return events.withColumn("hash", F.sha2(content, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts a key and (sliding) event-time window; windows end when the watermark passes them."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> StreamingQuery:
    """Runs over all that is there, then ends: exactly once, by checkpoint and file sink."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()


def run_upserts(stream: DataFrame, checkpoint: str, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> tuple[StreamingQuery, BucketTable]:
    """Keeps the last row of each key in a table of buckets; a batch that runs again changes nothing, and buckets that it doesn't touch aren't written."""
    table = BucketTable(stream.sparkSession, path, stream.schema, keys, order, buckets)
    query = stream.writeStream.foreachBatch(lambda batch, no: table.apply(batch, no) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, table
