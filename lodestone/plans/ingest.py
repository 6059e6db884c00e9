"""Queries: sources, sinks and incremental ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import parts_of, tagged_union
from ..session import shared_dir
from ..sources import nested as N
from ..sources import sinks as S
from ..sources.buckets import BucketTable
from ..streaming import ingest as K
from ..streaming.status import run_status
from . import inputs as I
from .registry import Tables as T
from .registry import query

_KEYED = "c AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer)"


def _target(t: T) -> DataFrame:
    return t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))


def _changes(t: T) -> DataFrame:
    """Orders as changes of customers; several a customer."""
    return t.orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("no"))


@query("""SELECT r_name AS region, n_name AS nation, c_custkey::varchar AS customer, c_name AS name, r_name || ' ' || n_name || ':' || c_custkey AS ref FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def src_nested_map_explode(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    per_nation = t.customer.groupBy("c_nationkey").agg(entries(F.col("c_custkey").cast("string"), "c_name").alias("m"))
    per_region = t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(entries("n_name", "m").alias("m"))
    doc = t.region.join(per_region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.create_map("r_name", "m")).alias("doc"))
    return N.explode_nested(doc, "doc", ["region", "nation", "customer"], "name", "%s %s:%s")


@query("SELECT a.c_custkey AS src, b.c_custkey AS dst, o_custkey::int AS votes FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 700 WHERE o_orderkey % 7 <> 0 AND a.c_custkey <> b.c_custkey")
def src_tsv_edges(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit("# comment")).otherwise(F.concat_ws("\t", F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), (F.col("o_orderkey") % 700).cast("string")), F.col("o_custkey").cast("string")))
    codes = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("code"), F.col("c_custkey").alias("id"))
    return N.tsv_edges(t.orders.select(line.alias("value")), codes)


@query("SELECT n_nationkey, 1 AS depth, n_name AS title, '/n ' || n_nationkey AS link FROM nation UNION ALL SELECT n_nationkey, 2, r_name, '/r' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def src_xml_menu(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    x = F.concat(F.lit('<menu><item name="'), b64(F.col("n_name")), F.lit('" link="%2Fn+'), F.col("n_nationkey").cast("string"), F.lit('"><item name="'), b64(F.col("r_name")), F.lit('" link="%2Fr" display="'), F.when(F.col("n_nationkey") % 2 == 0, "Y").otherwise("N"), F.lit('"></item></item></menu>'))
    menus = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", x.alias("menu"))
    return N.xml_menu(menus, "n_nationkey", "menu")


@query("SELECT doc_id, strftime(date '2020-02-01' + to_months((doc_id % 900)::int - 433), '%Y-%m') AS month, (doc_id % 900)::int AS issue FROM documents")
def issue_number_calendar(s: SparkSession, d: str) -> DataFrame:
    """A label for each document, its number, the month of that, and the number again."""
    label = F.concat(F.lit("Bulletin No. "), (F.col("doc_id") % 900).cast("string"), F.lit(" special.pdf"))
    rows = T(s, d).documents.select("doc_id", N.issue_month(F.regexp_extract(label, r"(\d+)", 1).cast("int")).alias("month"))
    return rows.select("doc_id", "month", N.month_issue(F.col("month")).alias("issue"))


_CH = "h AS (SELECT o_custkey AS id, o_orderpriority AS name, o_totalprice AS value FROM orders WHERE o_orderkey % 5 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"


@query(f"WITH {_KEYED}, {_CH} SELECT id, name, value FROM h UNION ALL SELECT id, name, value FROM c WHERE id % 3 <> 0 AND id NOT IN (SELECT id FROM h)")
def sink_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return S.upsert(_target(t).withColumn("no", F.lit(0).cast("long")), _changes(t), ["id"], ["no"]).drop("no")


@query("SELECT o_custkey AS id, min(o_orderkey) AS no FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1")
def sink_insert_ignore(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return S.insert_ignore(_target(t), _changes(t), ["id"], ["no"]).select("id", "no")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 0")
def sink_replace_partition(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    new = items.filter("l_orderkey % 10 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).cast(items.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return S.replace_parents(items, new, "l_orderkey")


@query("""WITH r AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM r))
SELECT 'root' AS "table", count(*) AS deleted FROM r UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)""")
def sink_cascade_delete(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return S.cascade_delete(t.customer.filter("c_nationkey = 3"), "c_custkey", {"orders": (t.orders, "o_custkey", "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey", "l_orderkey")})


@query("SELECT doc_id, coalesce(nullif(lang, 'fr'), 'en') AS version FROM documents")
def migrate_default_backfill(s: SparkSession, d: str) -> DataFrame:
    docs = T(s, d).documents.select("doc_id", F.nullif("lang", F.lit("fr")).alias("version"))
    return S.backfill_default(docs, "version", "en", ["doc_id"])[0]


@query()
def embed_backfill(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    rows = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", "text", "embedding")
    made = S.backfill_embeddings(rows, "doc_id", "text", "embedding", S.hashing_embedder(16))
    return made.select("doc_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("SELECT doc_id, substr(text, 1, 8000) AS text FROM documents WHERE length(trim(text)) > 0")
def embed_input_clean(s: SparkSession, d: str) -> DataFrame:
    return S.embed_input(T(s, d).documents, "text").select("doc_id", "text")


@query("SELECT source, count(*) AS documents, sum(n_chars)::bigint AS chars FROM documents GROUP BY source")
def sink_json_summary(s: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines to a folder of the session's checkpoint folder, and read again."""
    import uuid

    path = f"{shared_dir(s)}/summary-{uuid.uuid4().hex}"
    S.write_summary(T(s, d).documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), path)
    return s.read.schema("source string, documents long, chars long").json(path)


@query("SELECT o_orderkey AS parent, l_linenumber AS no, 'line ' || l_linenumber AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 0, 'kept' FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F')")
def sink_rebuild_children(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    # rows are dealt once by parent and by their number; what follows needs no other shuffle
    parts = parts_of(t.lineitem.count() + t.orders.count())
    lines = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("int").alias("no")).repartition(parts, "parent")
    old = lines.select("parent").distinct().select("parent", F.lit(0).alias("no"), F.lit("kept").alias("text"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent")).repartition(parts, "parent")
    new = lines.join(done, "parent", "left_semi").withColumn("text", F.concat(F.lit("line "), F.col("no").cast("string")))
    return S.replace_parents(old, new, "parent")


# --- K ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < timestamp '2024-01-20')")
def inc_high_water(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d).events
    return K.newer_than(e, e.filter("ts < timestamp '2024-01-20'"), "event_id").select("event_id")


@query(f"WITH {I.STATUS} SELECT user_id, status, ts FROM status")
def inc_status_latest(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    return K.latest_status(T(s, d).events, "user_id", "ts", "event_id", kind)


@query(f"WITH {I.STATUS} SELECT user_id, ts FROM status WHERE status = 'pending' ORDER BY ts DESC, user_id LIMIT 20")
def inc_pending(s: SparkSession, d: str) -> DataFrame:
    return K.pending(inc_status_latest(s, d), "ts", "user_id", 20).select("user_id", "ts")


@query(f"WITH {I.STATUS} SELECT user_id FROM status WHERE status <> 'completed' AND ts < timestamp '{I.NOW}' - INTERVAL 2 HOUR")
def inc_stale(s: SparkSession, d: str) -> DataFrame:
    return K.stale(I.status(T(s, d)), "ts", I.NOW).select("user_id")


@query("WITH k AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 0 AND sha256(text) NOT IN (FROM k) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def inc_hash_dedup(s: SparkSession, d: str) -> DataFrame:
    docs = T(s, d).documents
    known = docs.filter("doc_id % 4 = 0").select(F.sha2("text", 256).alias("hash"))
    return K.dedup_hash(docs.filter("doc_id % 4 <> 0"), known, "text", ["doc_id"]).select("doc_id", "hash")


@query(f"WITH {_KEYED}, {_CH} SELECT id, name, value FROM h UNION ALL SELECT id, name, value FROM c WHERE id % 3 <> 0 AND id NOT IN (SELECT id FROM h)")
def inc_idempotent(s: SparkSession, d: str) -> DataFrame:
    """The same changes twice give what they give once."""
    t = T(s, d)
    once = S.upsert(_target(t).withColumn("no", F.lit(0).cast("long")), _changes(t), ["id"], ["no"])
    return S.upsert(once, _changes(t), ["id"], ["no"]).drop("no")


@query(f"WITH {I.STATUS}, r AS (SELECT user_id, CASE WHEN status <> 'completed' AND ts < timestamp '{I.NOW}' - INTERVAL 2 HOUR THEN 'stale' WHEN status = 'completed' AND user_id % 2 = 0 THEN 'empty' WHEN user_id % 5 = 0 THEN 'duplicate' END AS reason FROM status) SELECT user_id, reason, count(*) OVER (PARTITION BY reason) AS total FROM r WHERE reason IS NOT NULL")
def inc_cleanup_report(s: SparkSession, d: str) -> DataFrame:
    report = K.cleanup_report(I.status(T(s, d)), I.NOW, "ts", "user_id", F.col("user_id") % 2 == 0, F.col("user_id") % 5 == 0)
    return report.join(report.groupBy("reason").agg(F.count("*").alias("total")), "reason").select("user_id", "reason", "total")


@query(f"WITH {I.STATUS} SELECT user_id, ts FROM status WHERE status = 'completed'")
def inc_processed_list(s: SparkSession, d: str) -> DataFrame:
    return K.processed(I.status(T(s, d)), "ts", "user_id").select("user_id", "ts")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def inc_observe(s: SparkSession, d: str) -> DataFrame:
    seen, _ = K.observe_progress(T(s, d).events, "events", F.count("*").alias("rows"), F.max("ts").alias("last"))
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def inc_window_counts(s: SparkSession, d: str) -> DataFrame:
    """The windowed count that runs over streams too."""
    return K.windowed_counts(T(s, d).events, "ts", "event_type", "1 day").select("event_type", F.col("window.start").alias("day"), "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events),
g AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s) SELECT user_id, min(ts) AS begin, count(*) AS n FROM g GROUP BY user_id, no""")
def inc_session_counts(s: SparkSession, d: str) -> DataFrame:
    return K.session_counts(T(s, d).events, "ts", "user_id").select("user_id", F.col("session_window.start").alias("begin"), "n")


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def agg_union_counts(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return tagged_union("corpus", {"d": t.documents.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n")), "e": t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))}).drop("corpus")


def _kind() -> Column:
    return F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")


@query(f"WITH {I.STATUS} SELECT user_id, status, ts FROM status")
def inc_bucket_upserts(s: SparkSession, d: str) -> DataFrame:
    """All events in three batches, of which the second comes twice, into a table of buckets."""
    events = T(s, d).events.select("user_id", _kind().alias("status"), "ts", "event_id")
    table = BucketTable(s, f"{shared_dir(s)}/buckets-{uuid.uuid4().hex}", events.schema, ["user_id"], ["ts", "event_id"], 16)
    for no in (0, 1, 1, 2):
        table.apply(events.filter(F.col("event_id") % 3 == no), no)
    return table.read().select("user_id", "status", "ts")


@query(f"WITH {I.STATUS} SELECT user_id, status, ts, status <> 'completed' AND ts < timestamp '{I.NOW}' - INTERVAL 2 HOUR AS stale FROM status")
def inc_status_stream(s: SparkSession, d: str) -> DataFrame:
    """The stream's table after all events and the tick of a clock that brings the watermark to the reference time."""
    root, late = f"{shared_dir(s)}/status-{uuid.uuid4().hex}", "60 days"
    events = T(s, d).events.select("user_id", _kind().alias("status"), "ts", "event_id")
    tick = s.createDataFrame([(-1, "completed", 0)], "user_id long, status string, event_id long").withColumn("ts", F.expr(f"timestamp '{I.NOW}' + INTERVAL {late}"))
    tick.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).coalesce(1).write.parquet(f"{root}/tick")
    # a pattern, since a stream reads folders, and the table may be one file
    stream = s.readStream.schema(T(s, d).events.schema).parquet(f"{d}/event[s].parquet").select("user_id", _kind().alias("status"), "ts", "event_id")
    clock = s.readStream.schema(events.schema).parquet(f"{root}/tick")
    query, table = run_status(stream.unionByName(clock), f"{root}/checkpoint", f"{root}/table", late=late, buckets=16)
    query.awaitTermination()
    return table.read().filter("user_id >= 0").select("user_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"), "stale")
