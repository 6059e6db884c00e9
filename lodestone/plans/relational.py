"""Queries: filters, joins, aggregates, order-dependent operators, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from . import inputs as I
from .registry import Tables as T
from .registry import query

# --- B ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey <> 7 AND o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL")
def filter_basic(s: SparkSession, d: str) -> DataFrame:
    rows = R.where(T(s, d).orders, ("o_orderstatus", "eq", "O"), ("o_custkey", "neq", 7), ("o_totalprice", "gt", 1000), ("o_totalprice", "lte", 200000), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_orderdate", "is_null", False))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def filter_optional(s: SparkSession, d: str) -> DataFrame:
    return R.where_given(T(s, d).documents, lang="en", source=None).select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents WHERE coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'en') = 'en'")
def filter_default_null(s: SparkSession, d: str) -> DataFrame:
    docs = T(s, d).documents.withColumn("version", F.when(F.col("lang") != "fr", F.col("lang")))
    return R.where_default(docs, "version", "en", "en").select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bl') OR contains(lower(p_type), 'promo') ORDER BY p_partkey LIMIT 50")
def filter_ilike_any(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d).part
    return R.contains_any(p, ["p_name", "p_type"], "BL", None).select("p_partkey", "p_name").unionByName(R.contains_any(p, ["p_type"], "promo").select("p_partkey", "p_name")).distinct().orderBy("p_partkey").limit(50)


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt')")
def filter_array_contains(s: SparkSession, d: str) -> DataFrame:
    return R.has_alias(T(s, d).part.withColumn("aliases", F.split("p_name", " ")), "aliases", "bolt").select("p_partkey")


@query("SELECT event_id FROM events WHERE ts::date >= date '2023-12-31' AND event_id % 11 <> 0 AND ts::date >= date '2024-01-31' - INTERVAL 1 MONTH")
def filter_relative_date(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d).events.withColumn("day", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.date_format("ts", "yyyyMMdd")))
    return R.since_months(e, "day", 1, "2024-01-31").select("event_id")


@query(f"WITH {I.SEGMENTS} SELECT conv_id, string_agg(text, ' ' ORDER BY start_s, end_s, text) AS text, count(*) AS segments, least(max(end_s), 150.0::double) AS until FROM segments WHERE (start_s >= 40 AND start_s < 150) OR (end_s > 40 AND end_s <= 150) OR (start_s <= 40 AND end_s >= 150) GROUP BY conv_id")
def segment_overlap(s: SparkSession, d: str) -> DataFrame:
    return R.overlapping(I.segments(T(s, d)), "conv_id", "start_s", "end_s", "text", 40.0, 150.0)


@query(f"WITH {I.SEGMENTS} SELECT conv_id, turn FROM segments WHERE start_s >= 30 AND end_s <= 180")
def segment_contained(s: SparkSession, d: str) -> DataFrame:
    return R.contained(I.segments(T(s, d)), "start_s", "end_s", 30.0, 180.0).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE doc_id BETWEEN 120 AND 340")
def filter_range_swap(s: SparkSession, d: str) -> DataFrame:
    return R.between_either(T(s, d).documents, "doc_id", 340, 120).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'click')")
def filter_sentinels(s: SparkSession, d: str) -> DataFrame:
    return R.without(T(s, d).events, "event_type", ["error", "click"]).select("event_id")


@query(f"WITH {I.EDGES} SELECT src, dst, strength FROM edges WHERE strength >= 0.9")
def filter_score_min(s: SparkSession, d: str) -> DataFrame:
    return R.where(I.edges(T(s, d)), ("strength", "gte", 0.9)).select("src", "dst", "strength")


@query(f"WITH {I.EDGES} SELECT src::varchar AS id, 'edge' AS kind, round(1 - strength, 6) AS distance, substr('type-' || type, 1, 6) AS short FROM edges")
def project_legacy_shape(s: SparkSession, d: str) -> DataFrame:
    return I.edges(T(s, d)).select(F.col("src").cast("string").alias("id"), F.lit("edge").alias("kind"), F.round(1 - F.col("strength"), 6).alias("distance"), F.substring(F.concat(F.lit("type-"), "type"), 1, 6).alias("short"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END), ''), role) AS body FROM conversations")
def project_fallback(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d).conversations.withColumn("full", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(" ")))
    return c.select("conv_id", "turn", R.first_nonempty("full", "role").alias("body"))


# --- C ------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 AND l_quantity > 45")
def join_inner_link(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return t.lineitem.filter("l_quantity > 45").join(t.part.filter("p_size > 40"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def join_inner_filter(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return t.lineitem.join(t.orders.filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber")


@query(f"WITH {I.EDGES}, a AS (SELECT src AS id, max(strength) AS va FROM edges WHERE type < 4 GROUP BY 1), b AS (SELECT dst AS id, max(strength) AS vb FROM edges WHERE type > 2 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, coalesce(va, 0) AS va, coalesce(vb, 0) AS vb FROM a FULL JOIN b ON a.id = b.id")
def join_full_outer_scores(s: SparkSession, d: str) -> DataFrame:
    e = I.edges(T(s, d))
    a = e.filter("type < 4").groupBy(F.col("src").alias("id")).agg(F.max("strength").alias("va"))
    b = e.filter("type > 2").groupBy(F.col("dst").alias("id")).agg(F.max("strength").alias("vb"))
    return R.full_outer_scores(a, b, "id", "va", "vb")


@query("SELECT d.doc_id, l.quality, e.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def join_left_chain(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")


_KIN_UNION = f"""WITH {I.KIN} SELECT k.person, p.c_custkey AS other, 'parent' AS kind FROM kin k JOIN customer p ON p.c_custkey = k.parent AND p.c_custkey <> k.person
UNION ALL SELECT k.parent, k.person, 'child' FROM kin k JOIN customer p ON p.c_custkey = k.parent AND p.c_custkey <> k.person"""


@query(_KIN_UNION)
def join_self_kin(s: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import kin_union

    return kin_union(I.kin(T(s, d)), None)


@query(f"WITH {I.KIN} SELECT DISTINCT x.member AS a, y.member AS b FROM bridge x JOIN bridge y USING (event) WHERE x.member <> y.member")
def join_coparticipants(s: SparkSession, d: str) -> DataFrame:
    return R.coparticipants(I.bridge(T(s, d)), "member", "event")


@query(f"WITH {I.EDGES} SELECT src AS id, dst AS other, type FROM edges UNION ALL SELECT dst, src, type FROM edges")
def join_undirected(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    nodes = t.documents.select(F.col("doc_id").alias("src"))
    return R.undirected(I.edges(t)).join(nodes, "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), "type")


@query(f"WITH {I.EDGES}, x AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT src, dst FROM edges WHERE src IN (FROM x) AND dst IN (FROM x)")
def join_semi_both(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.both_ends_in(I.edges(t), t.labels.filter("quality = 1"), "doc_id").select("src", "dst")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings) AS processed FROM documents")
def join_anti_pending(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.processed_or_pending(t.documents.select("doc_id"), "doc_id", t.labels, t.embeddings.withColumnRenamed("vec_id", "doc_id"))


@query("SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part p JOIN lineitem ON l_partkey = p.p_partkey WHERE l_quantity >= 50 AND l_suppkey = 3)")
def join_anti_title(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    done = t.part.join(t.lineitem.filter("l_quantity >= 50 and l_suppkey = 3"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return R.new_only(t.part, done, "p_name").select("p_partkey")


@query("SELECT d.doc_id, coalesce(l.quality, e.label) AS value, CASE WHEN l.quality IS NOT NULL THEN 0 WHEN e.label IS NOT NULL THEN 1 END AS source_no FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON vec_id = d.doc_id")
def join_fallback_lookup(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.lookup_first(t.documents.select("doc_id"), "doc_id", "value", t.labels.select("doc_id", F.col("quality").alias("value")), t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("value")))


@query("""WITH r AS (SELECT conv_id, 1 AS lo, 2 + conv_id % 3 AS hi FROM conversations GROUP BY conv_id)
SELECT conv_id, lo, hi, string_agg('[' || turn || '] ' || text, ' ' ORDER BY turn, text) AS text, count(*) AS units FROM r JOIN conversations USING (conv_id) WHERE turn BETWEEN lo AND hi AND text IS NOT NULL GROUP BY ALL""")
def join_range_concat(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d).conversations
    refs = c.select("conv_id").distinct().select("conv_id", F.lit(1).alias("lo"), (2 + F.col("conv_id") % 3).alias("hi"))
    return R.range_concat(refs, c.filter("text is not null"), "conv_id", "lo", "hi", "turn", "text")


@query("""SELECT u.user_id, m.event_type, m.ts FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM events WHERE event_type IN ('purchase', 'error')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) m USING (user_id)""")
def join_latest_child(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d).events
    return R.latest_child(e.select("user_id").distinct(), e, "user_id", "ts", "event_type", "event_id", F.col("event_type").isin("purchase", "error"))


@query(f"WITH {I.EDGES} SELECT id, other, strength FROM (SELECT src AS id, dst AS other, strength FROM edges UNION ALL SELECT dst, src, strength FROM edges) WHERE id = 5 ORDER BY strength DESC, other")
def join_neighbours(s: SparkSession, d: str) -> DataFrame:
    e = R.undirected(I.edges(T(s, d))).filter("src = 5")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "strength").orderBy(F.desc("strength"), "other")


@query("SELECT o_orderkey, o_custkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL")
def join_detail_nested(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    rows = t.orders.filter("o_orderstatus = 'P'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey", "o_custkey").agg(R.string_ordered(F.concat_ws(":", "l_linenumber", "l_partkey"), ["l_linenumber", "l_partkey"], ",").alias("lines"))


_NAMES = """v AS (SELECT DISTINCT p_name AS word FROM part), q AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS name FROM part)"""


def _typos(t: T) -> DataFrame:
    return t.part.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("name"))


@query(f"WITH {_NAMES} SELECT name, word, levenshtein(name, word)::int AS distance FROM q, v WHERE levenshtein(name, word) <= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, word), word) = 1")
def join_fuzzy_name(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.nearest_name(_typos(t), "name", t.part, "p_name")


@query(f"""WITH {_NAMES}, g AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 2), lambda i: substr('  ' || lower(name) || ' ', i::int, 3))) AS g FROM q),
h AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || lower(word) || ' ', i::int, 3))) AS h FROM v),
p AS (SELECT name AS query, word AS name, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS x FROM g, h)
SELECT query, name, round(x, 6) AS similarity FROM p WHERE x > 0.5 QUALIFY row_number() OVER (PARTITION BY query ORDER BY x DESC, name) <= 5""")
def join_trigram(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.similar_by_trigram(t.part, "p_name", _typos(t), "name").withColumn("similarity", F.round("similarity", 6))


# --- D ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'documents' AS corpus, lang AS part, count(*) AS total, count(label) AS done, count(*) - count(label) AS pending, round(100.0 * count(label) / nullif(count(*), 0), 2) AS percent FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang
UNION ALL SELECT 'labels', quality::varchar, count(*), count(label), count(*) - count(label), round(100.0 * count(label) / nullif(count(*), 0), 2) FROM labels LEFT JOIN embeddings ON vec_id = doc_id GROUP BY quality""")
def agg_completion(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    a = R.completion(t.documents.join(e, "doc_id", "left").withColumnRenamed("lang", "part"), ["part"], "label")
    b = R.completion(t.labels.join(e, "doc_id", "left").withColumn("part", F.col("quality").cast("string")), ["part"], "label")
    return R.tagged_union("corpus", {"documents": a, "labels": b})


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY ALL")
def agg_multi_key(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {I.STATUS} SELECT count(*) AS total, count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed FROM status")
def agg_status_counts(s: SparkSession, d: str) -> DataFrame:
    return R.status_counts(I.status(T(s, d)), "status", ["pending", "processing", "completed", "failed"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0 ORDER BY n DESC, event_type")
def agg_type_counts(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).events.groupBy("event_type").agg(F.count("*").alias("n")).filter("n > 0").orderBy(F.desc("n"), "event_type")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM customer k WHERE k.c_custkey // 10 = c.c_custkey) AS kids FROM customer c")
def agg_child_counts(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.child_counts(t.customer.select("c_custkey"), "c_custkey", orders=t.orders.withColumnRenamed("o_custkey", "c_custkey"), kids=I.kin(t).withColumnRenamed("parent", "c_custkey"))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def agg_distinct(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).documents.select("source").distinct().orderBy("source")


@query("SELECT source, count_if(lang = 'de') AS de, count_if(lang = 'en') AS en, count_if(lang = 'es') AS es, count_if(lang = 'fr') AS fr FROM documents GROUP BY source")
def agg_pivot(s: SparkSession, d: str) -> DataFrame:
    return R.pivot_counts(T(s, d).documents, "source", "lang", ["de", "en", "es", "fr"])


@query("SELECT count(text) AS n, round(avg(length(text)), 6) AS mean, min(length(text))::int AS least, max(length(text))::int AS most, count_if(length(text) < 100) AS short, count_if(length(text) > 3000) AS long FROM documents")
def agg_length_stats(s: SparkSession, d: str) -> DataFrame:
    return R.length_stats(T(s, d).documents, "text")


@query("SELECT text, count(*) AS n, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS members, count(*) - 1 AS surplus FROM documents GROUP BY text HAVING count(*) > 1")
def agg_duplicates(s: SparkSession, d: str) -> DataFrame:
    return R.duplicates(T(s, d).documents, "text", "doc_id")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def agg_string_ordered(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).conversations.groupBy("conv_id").agg(R.string_ordered("text", ["turn", "text"], "\n").alias("text"))


@query(f"WITH {I.TAGS} SELECT ref, string_agg(theme, ',' ORDER BY confidence DESC, theme) AS themes FROM tags GROUP BY ref")
def agg_tags_ordered(s: SparkSession, d: str) -> DataFrame:
    rows = I.tags(T(s, d)).withColumn("less", -F.col("confidence"))
    return rows.groupBy("ref").agg(R.string_ordered("theme", ["less", "theme"], ",").alias("themes"))


@query("SELECT count_if(o_orderstatus <> 'P') AS succeeded, count_if(o_orderstatus = 'P') AS failed, round(sum(o_totalprice), 2) AS amount, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P') / 60, 2) AS succeeded_minutes FROM orders")
def agg_batch_summary(s: SparkSession, d: str) -> DataFrame:
    ok = F.col("o_orderstatus") != "P"
    return T(s, d).orders.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.round(F.sum(F.when(ok, F.col("o_totalprice"))) / 60, 2).alias("succeeded_minutes"))


@query("SELECT user_id, round(avg(value), 6) AS mean, count_if(event_type = 'error') AS warnings, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list(e.event_type)) AS x)) AS kinds FROM events e GROUP BY user_id")
def agg_set_union(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("warnings"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS total, count_if(o_orderstatus <> 'P') AS done FROM orders GROUP BY 1 HAVING count(*) > 0 AND count(*) = count_if(o_orderstatus <> 'P'))
SELECT o_custkey, total, row_number() OVER (ORDER BY total DESC, o_custkey) = 1 AS is_default FROM g""")
def agg_having_complete(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d).orders.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "P").alias("done")).filter("total > 0 and total = done")
    first = g.agg(F.max_by("o_custkey", F.struct("total", -F.col("o_custkey"))).alias("first"))
    return g.crossJoin(F.broadcast(first)).select("o_custkey", "total", (F.col("o_custkey") == F.col("first")).alias("is_default"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM labels WHERE quality = 1) AS good")
def agg_dashboard(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    one = lambda df, e, n: df.agg(e.alias(n))
    n = F.count("*")
    return one(t.documents, n, "documents").crossJoin(one(t.embeddings, n, "embeddings")).crossJoin(one(t.pages, n, "pages")).crossJoin(one(t.conversations, F.countDistinct("conv_id"), "conversations")).crossJoin(one(t.labels.filter("quality = 1"), n, "good"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'de', 'en', 'er'))) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 5""")
def agg_top_terms(s: SparkSession, d: str) -> DataFrame:
    from ..functions.text import tokens

    w = T(s, d).documents.select("doc_id", F.explode(tokens("text")).alias("word")).filter((F.length("word") >= 2) & ~F.col("word").isin("the", "de", "en", "er"))
    return R.topk_per(w.groupBy("doc_id", "word").agg(F.count("*").alias("n")), ["doc_id"], [F.desc("n"), F.asc("word")], 5)


@query("SELECT count(*) AS pending, count(*) * 125 AS tokens, round(count(*) * 125 / 1e6 * 0.02, 8) AS cost FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def agg_cost_estimate(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    pending = R.new_only(t.documents, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return pending.agg(F.count("*").alias("pending")).select("pending", (F.col("pending") * 125).alias("tokens"), F.round(F.col("pending") * 125 / 1e6 * 0.02, 8).alias("cost"))


@query(f"WITH RECURSIVE {I.TREE}, w AS (SELECT id, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM tree t JOIN w ON t.parent = w.id) SELECT count(*) AS nodes, max(depth) AS depth FROM w")
def agg_tree_stats(s: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import tree_walk

    return tree_walk(I.tree(T(s, d)), "id", "parent").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query("SELECT count(*) - count(e.label) AS missing FROM documents LEFT JOIN embeddings e ON vec_id = doc_id")
def agg_needs_work(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").agg((F.count("*") - F.count("label")).alias("missing"))


# --- E ------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def win_distinct_on(s: SparkSession, d: str) -> DataFrame:
    return R.first_per(T(s, d).events, ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) = 1 AS keep FROM part")
def win_keep_best(s: SparkSession, d: str) -> DataFrame:
    return R.mark_best(T(s, d).part, ["p_name"], [F.desc("p_size"), F.desc("p_partkey")]).select("p_partkey", "p_name", "keep")


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) = 1")
def win_first_occurrence(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d).events.withColumn("day", F.to_date("ts"))
    return R.first_per(e, ["user_id", "day"], ["ts", "event_id"]).select("event_id", "user_id", "ts")


_PRIORITY = "r AS (SELECT src AS id, 1 AS prio, strength AS score FROM edges WHERE type < 3 UNION ALL SELECT dst, 2, strength FROM edges WHERE type >= 2)"


@query(f"WITH {I.EDGES}, {_PRIORITY}, b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio, score DESC) = 1) SELECT id, prio, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b")
def win_priority_dedup(s: SparkSession, d: str) -> DataFrame:
    e = I.edges(T(s, d))
    rows = e.filter("type < 3").select(F.col("src").alias("id"), F.lit(1).alias("prio"), F.col("strength").alias("score")).unionByName(e.filter("type >= 2").select(F.col("dst").alias("id"), F.lit(2).alias("prio"), F.col("strength").alias("score")))
    return R.ranked(R.first_per(rows, ["id"], ["prio", F.desc("score")]), "score", "id")


@query("""WITH c AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS no FROM events),
k AS (SELECT * FROM c WHERE no <= ceil(50 / (SELECT count(DISTINCT event_type) FROM events)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type, no) = 1)
SELECT event_type, user_id FROM k ORDER BY event_type, no, user_id LIMIT 50""")
def win_cap_per_group(s: SparkSession, d: str) -> DataFrame:
    return R.capped_union(T(s, d).events.select("event_type", "user_id", "value", "event_id"), "event_type", "user_id", [F.desc("value"), "event_id"], 50).select("event_type", "user_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM conversations")
def win_ordinal(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return T(s, d).conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("no"))


def _pieces(t: T) -> DataFrame:
    """Each conversation as pieces of three turns whose times and numbers begin anew."""
    third, at = F.col("turn") % 3, F.floor(F.col("turn") / 3)
    return I.segments(t).select("conv_id", at.alias("piece"), third.alias("idx"), "text", (third * 30.0).alias("start_s"), (F.col("end_s") - at * 90.0).alias("end_s"))


@query(f"WITH {I.SEGMENTS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, turn // 3 AS piece, turn % 3 AS idx, start_s AS start_at, end_s AS end_at FROM segments")
def win_time_rebase(s: SparkSession, d: str) -> DataFrame:
    return R.rebase(_pieces(T(s, d)), "conv_id", "piece", "idx", "start_s", "end_s", 90.0)


@query(f"WITH {I.SEGMENTS} SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS segments, max(end_s) AS duration FROM segments GROUP BY conv_id")
def win_transcript_merge(s: SparkSession, d: str) -> DataFrame:
    return R.merge_transcripts(_pieces(T(s, d)), "conv_id", "piece", "idx", "end_s", "text", 90.0)


@query("""WITH c AS (SELECT conv_id, turn, length(text) % 5 = 0 AS a, length(text) % 3 = 0 AS b, length(text) % 4 = 0 AS c FROM conversations),
x AS (SELECT *, coalesce(max(turn) FILTER (a) OVER (PARTITION BY conv_id), -1) AS la FROM c),
y AS (SELECT *, min(turn) FILTER (b AND turn > la) OVER (PARTITION BY conv_id) AS s FROM x),
z AS (SELECT conv_id, count(*) AS n, min(s) AS s, min(turn) FILTER (c AND turn > s) AS e FROM y GROUP BY conv_id)
SELECT conv_id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s ELSE floor(n * 0.2) END::bigint AS start_idx, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e ELSE floor(n * 0.8) END::bigint AS end_idx, s IS NOT NULL AND e IS NOT NULL AS detected FROM z""")
def win_boundary_detect(s: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return R.detect_boundary(T(s, d).conversations, "conv_id", "turn", n % 5 == 0, n % 3 == 0, n % 4 == 0)


@query("""WITH c AS (SELECT conv_id, turn, text, CASE WHEN length(text) >= 200 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS b FROM conversations WHERE text IS NOT NULL),
i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, island::bigint AS island, min(turn) AS turn, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS parts FROM i GROUP BY conv_id, island""")
def win_merge_short(s: SparkSession, d: str) -> DataFrame:
    return R.merge_short(T(s, d).conversations.filter("text is not null"), "conv_id", "turn", "text")


@query("""WITH c AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, island::bigint AS island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), '') AS text FROM i GROUP BY conv_id, island""")
def win_page_continuation(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = T(s, d).conversations.withColumn("begins", before.isNull() | (before != "system"))
    return R.merge_continued(c, ["conv_id"], "turn", F.col("begins"), "text")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def win_last_n_turns(s: SparkSession, d: str) -> DataFrame:
    return R.last_turns(T(s, d).conversations, "conv_id", "turn", 10).select("conv_id", "turn", "role")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def topn_recent(s: SparkSession, d: str) -> DataFrame:
    return R.top(T(s, d).events, [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "ts")


# --- F ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_multi_key(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).customer.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'm') ORDER BY CASE WHEN lower(p_type) = 'm' THEN 0 WHEN starts_with(lower(p_type), 'm') THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey LIMIT 50")
def sort_case_rank(s: SparkSession, d: str) -> DataFrame:
    return R.ranked_lookup(T(s, d).part, "p_type", "M", "p_retailprice", "p_partkey").select("p_partkey", "p_type")


@query(f"WITH {I.TAGS} SELECT ref, theme, confidence FROM tags WHERE theme = 'en' AND confidence >= 0.7 ORDER BY confidence DESC, ref LIMIT 10")
def topk_theme(s: SparkSession, d: str) -> DataFrame:
    return R.top(I.tags(T(s, d)), [F.desc("confidence"), "ref"], 10, (F.col("theme") == "en") & (F.col("confidence") >= 0.7))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_overfetch(s: SparkSession, d: str) -> DataFrame:
    return R.overfetch(T(s, d).orders, [F.desc("o_totalprice"), "o_orderkey"], F.col("o_orderstatus") == "F", 10).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y%m%d') END AS day FROM events ORDER BY day DESC NULLS LAST, event_id")
def sort_date_string(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d).events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyyMMdd")).alias("day"))
    return e.orderBy(F.desc_nulls_last("day"), "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 7 ORDER BY l_orderkey, l_linenumber LIMIT 10")
def topk_entity_refs(s: SparkSession, d: str) -> DataFrame:
    return R.top(T(s, d).lineitem, ["l_orderkey", "l_linenumber"], 10, F.col("l_suppkey") == 7).select("l_orderkey", "l_linenumber")


# --- G ------------------------------------------------------------------------------------------------------------


@query(f"WITH {I.EDGES} SELECT src AS ref, dst AS other, strength, 'outgoing' AS direction FROM edges UNION ALL SELECT dst, src, strength, 'incoming' FROM edges")
def set_union_direction(s: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import relations

    return relations(I.edges(T(s, d)))


@query(_KIN_UNION + " UNION ALL SELECT DISTINCT x.member, y.member, 'co-participant' FROM bridge x JOIN bridge y USING (event) WHERE x.member <> y.member")
def set_union_kinds(s: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import kin_union

    t = T(s, d)
    return kin_union(I.kin(t), I.bridge(t))


_TWO = "a AS (SELECT src, dst, type, strength FROM edges WHERE type <= 4), b AS (SELECT src, dst, type, 0.0 AS strength FROM edges WHERE type >= 2)"


@query(f"WITH {I.EDGES}, {_TWO} SELECT src, dst, type, strength::double AS strength FROM (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY p, type) = 1")
def set_union_distinct(s: SparkSession, d: str) -> DataFrame:
    e = I.edges(T(s, d))
    return R.union_first(["src", "dst"], ["type"], e.filter("type <= 4"), e.filter("type >= 2").withColumn("strength", F.lit(0.0)))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def set_except_new(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return R.new_only(t.documents.select("doc_id"), t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query(f"WITH {I.EDGES} SELECT src, dst, type, min(g) AS graph FROM (SELECT src, dst, type, 0 AS g FROM edges WHERE src % 3 = 0 UNION ALL SELECT src, dst, type, 1 FROM edges WHERE dst % 3 = 0) GROUP BY ALL")
def set_merge_graphs(s: SparkSession, d: str) -> DataFrame:
    e = I.edges(T(s, d)).select("src", "dst", "type")
    parts = [e.filter("src % 3 = 0").withColumn("graph", F.lit(0)), e.filter("dst % 3 = 0").withColumn("graph", F.lit(1))]
    return R.union_first(["src", "dst", "type"], ["graph"], *parts)
