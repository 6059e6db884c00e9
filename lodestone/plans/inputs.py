"""Inputs that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: The reference time of all queries about "now".
NOW = "2024-01-31 00:00:00"


def edges(t: Tables) -> DataFrame:
    """src, dst, type, strength: two edges a document, without self edges."""
    n = t.documents.count()
    d = F.col("doc_id")
    ends = F.explode(F.array((d * 7 + 3) % n, (d * 13 + 1) % n)).alias("dst")
    out = t.documents.select(d.alias("src"), ends).filter("src <> dst")
    return out.select("src", "dst", (F.col("src") % 7).cast("int").alias("type"), F.round(((F.col("src") * 37) % 101) / 100, 2).alias("strength"))


EDGES = """edges AS (SELECT src, dst, (src % 7)::int AS type, round(((src * 37) % 101) / 100, 2) AS strength FROM (
  SELECT doc_id AS src, unnest([(doc_id * 7 + 3) % n, (doc_id * 13 + 1) % n]) AS dst FROM documents, (SELECT count(*) AS n FROM documents)) WHERE src <> dst)"""


def tags(t: Tables) -> DataFrame:
    """ref, theme, confidence."""
    confidence = (F.col("n_chars") % 10 / 10).alias("confidence")
    d = t.documents
    return d.select(F.col("doc_id").alias("ref"), F.col("lang").alias("theme"), confidence).unionByName(d.select(F.col("doc_id").alias("ref"), F.col("source").alias("theme"), confidence))


TAGS = """tags AS (SELECT doc_id AS ref, lang AS theme, n_chars % 10 / 10 AS confidence FROM documents UNION ALL SELECT doc_id, source, n_chars % 10 / 10 FROM documents)"""


def status(t: Tables) -> DataFrame:
    """user_id, status, ts: the latest event of each user."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct(kind.alias("status"), "ts", "event_id"), F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", "m.status", "m.ts", "m.event_id")


STATUS = """status AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status, ts, event_id
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def segments(t: Tables) -> DataFrame:
    """conv_id, turn, text, start_s, end_s."""
    return t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 30.0).alias("start_s"), (F.col("turn") * 30.0 + 5 + F.length(F.coalesce("text", F.lit(""))) % 60).alias("end_s"))


SEGMENTS = "segments AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn * 30.0::double AS start_s, turn * 30.0::double + 5 + length(coalesce(text, '')) % 60 AS end_s FROM conversations)"


def tree(t: Tables) -> DataFrame:
    """id, parent, name, ord: region, nation and customer."""
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    return r.unionByName(n).unionByName(c)


TREE = """tree AS (SELECT 'r' || r_regionkey AS id, NULL::varchar AS parent, r_name AS name, r_regionkey::bigint AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey FROM customer)"""


def kin(t: Tables) -> DataFrame:
    """person, parent."""
    return t.customer.select(F.col("c_custkey").alias("person"), F.floor(F.col("c_custkey") / 10).alias("parent"))


def bridge(t: Tables) -> DataFrame:
    """event, member."""
    return t.lineitem.select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("member"))


KIN = "kin AS (SELECT c_custkey AS person, c_custkey // 10 AS parent FROM customer), bridge AS (SELECT l_orderkey AS event, l_suppkey AS member FROM lineitem)"
