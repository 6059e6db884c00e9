"""Queries: vector, keyword and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as H
from ..operators import vector as V
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex, index_path
from ..session import shared_dir
from .registry import Tables as T
from .registry import query

#: Queries are the vectors whose id is divisible by 50, against all rows; their text is two words of their document, or a known topic.
_TEXT = r"CASE WHEN vec_id % 200 = 0 THEN 'and thath' ELSE array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[3:4], ' ') END"
#: Corpus c (id, text, lang, v), queries q, similarities s, tokens and ranks, all in full.
_BASE = rf"""c AS (SELECT doc_id AS id, text, lang, embedding::double[] AS v FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT vec_id AS query_id, {_TEXT} AS text, embedding::double[] AS v FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0),
s AS (SELECT query_id, id, list_cosine_similarity(q.v, c.v) AS similarity FROM q, c),
t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM c),
n AS (SELECT id, count(*) AS n_tokens FROM t GROUP BY id),
f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT DISTINCT query_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS term FROM q), m AS (SELECT query_id, count(*) AS n_terms FROM w GROUP BY 1),
k AS (SELECT query_id, id, count(*) AS found, sum(ln(1 + tf)) AS x FROM f JOIN w USING (term) GROUP BY ALL),
r AS (SELECT query_id, id, found = n_terms AS whole, x / n_terms / (1 + ln(1 + n_tokens)) AS rank FROM k JOIN m USING (query_id) JOIN n USING (id))"""


def _topk(table: str, order: str, k: int, where: str = "TRUE") -> str:
    return f"(SELECT * FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, id) <= {k})"


def _hybrid(k: int, wv: float, wk: float, fv: int, fk: int, where: str, r: str = "r", s: str = "s") -> str:
    both = f"(SELECT query_id, id, coalesce(similarity, 0) AS similarity, coalesce(rank, 0) AS rank, {wv}::double * coalesce(similarity, 0) + {wk}::double * coalesce(rank, 0) AS score FROM {_topk(s, 'similarity', fv * k)} a FULL JOIN {_topk(r, 'rank', fk * k, where)} b USING (query_id, id))"
    return _topk(both, "score", k)


def corpus(t: T) -> DataFrame:
    return t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang", "source", "embedding")


def queries_of(t: T) -> DataFrame:
    words = F.when(F.col("vec_id") % 200 == 0, "and thath").otherwise(F.array_join(F.slice(X.tokens("text"), 3, 2), " "))
    chosen = t.embeddings.filter("vec_id % 50 = 0").join(t.documents.select("doc_id", "text"), F.col("doc_id") == F.col("vec_id"))
    return chosen.select(F.col("vec_id").alias("query_id"), words.alias("text"), "embedding")


def _q(t: T, i: int) -> list[float]:
    return t.embeddings.filter(F.col("vec_id") == i).first()["embedding"]


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("similarity", "rank", "score") if c in df.columns})


@query(f"WITH {_BASE} SELECT id, round(similarity, 6) AS similarity FROM s JOIN c USING (id) WHERE query_id = 50 AND lang = 'en' ORDER BY s.similarity DESC, id LIMIT 10")
def vec_topk(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(V.vector_topk(corpus(t), _q(t, 50), 10, F.col("lang") == "en"))


@query(f"WITH {_BASE} SELECT id, round(similarity, 6) AS similarity FROM s WHERE query_id = 100 AND similarity > 0.2 ORDER BY s.similarity DESC, id LIMIT 25")
def vec_threshold(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(V.vector_above(corpus(t), _q(t, 100), 0.2, 25))


@query(f"WITH {_BASE} SELECT query_id, id, round(similarity, 6) AS similarity FROM {_topk('s', 'similarity', 10)}")
def vec_topk_batch(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(V.vector_topk_batch(corpus(t), queries_of(t).withColumnRenamed("query_id", "id"), 10))


@query()
def vec_ivf(s: SparkSession, d: str) -> DataFrame:
    """All vectors are indexed; queries are the ids divisible by 50; recall against exact search is tested."""
    t = T(s, d)
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return _round(VectorIndex.build(e, index_path(shared_dir(s))).search(e.filter("id % 50 = 0"), 10))


@query(f"WITH {_BASE}, e AS (SELECT s.query_id, s.id, s.similarity FROM s WHERE query_id <> id AND similarity > 0.25) SELECT query_id, id, round(similarity, 6) AS similarity FROM {_topk('e', 'similarity', 5)}")
def vec_neighbours(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(V.neighbours_by_vector(corpus(t), queries_of(t).select(F.col("query_id").alias("id"), "embedding"), 0.25, 5))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def text_tokens(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).documents.select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


@query(r"WITH t AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS t FROM documents) SELECT doc_id, list_contains(t, 'the') AND list_contains(t, 'thath') OR contains(lower(text), 'the thath') AS hit FROM t")
def text_match_all(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).documents.select("doc_id", X.match_terms("text", "the thath").alias("hit"))


#: r1: r, and texts that hold the whole query, which count too.
_HOLDS = """p AS (SELECT query_id, c.id FROM q JOIN c ON q.text <> '' AND contains(lower(c.text), lower(q.text))),
r1 AS (SELECT query_id, id, coalesce(rank, 0) AS rank, coalesce(whole, FALSE) OR held IS NOT NULL AS whole FROM r FULL JOIN (SELECT *, 1 AS held FROM p) USING (query_id, id))"""


@query(f"WITH {_BASE}, {_HOLDS} SELECT query_id, id, round(rank, 6) AS rank FROM {_topk('r1', 'rank', 10, 'whole')}")
def text_keyword_topk(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.keyword_topk_batch(corpus(t), queries_of(t), 10, substring=True))


_BM25 = f"""WITH {_BASE}, z AS (SELECT count(*) AS docs, avg(n_tokens) AS mean FROM n), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
b AS (SELECT query_id, f.id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS rank FROM f JOIN w USING (term) JOIN g USING (term) JOIN n ON n.id = f.id, z GROUP BY ALL)
SELECT query_id, id, round(rank, 6) AS rank FROM {_topk('b', 'rank', 10)}"""


@query(_BM25)
def text_bm25_topk(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.bm25_topk(corpus(t), queries_of(t), 10))


def _index(t: T, s: SparkSession) -> KeywordIndex:
    return KeywordIndex.build(corpus(t), f"{shared_dir(s)}/keyword-index-{uuid.uuid4().hex}")


@query(f"WITH {_BASE} SELECT query_id, id, round(rank, 6) AS rank FROM {_topk('r', 'rank', 10, 'whole')}")
def text_index_topk(s: SparkSession, d: str) -> DataFrame:
    """Keyword search on a stored index."""
    t = T(s, d)
    return _round(_index(t, s).keyword_topk(queries_of(t), 10))


@query(_BM25)
def text_index_bm25(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(_index(t, s).bm25_topk(queries_of(t), 10))



_SHOW = "SELECT query_id, id, round(similarity, 6) AS similarity, round(rank, 6) AS rank, round(score, 6) AS score FROM "


@query(f"WITH {_BASE}, {_HOLDS} {_SHOW} {_hybrid(10, 0.7, 0.3, 2, 2, 'whole', 'r1')}")
def hybrid_v1(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.hybrid(corpus(t), queries_of(t), 10, substring=True))


@query(f"WITH {_BASE} {_SHOW} {_hybrid(10, 0.85, 0.15, 3, 2, 'whole AND rank > 0.01')}")
def hybrid_v2(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.hybrid(corpus(t), queries_of(t), 10, 0.85, 0.15, 3, 2, 0.01))


@query(f"WITH {_BASE}, a AS {_topk('s', 'similarity', 15)}, b AS (SELECT query_id, id, a.similarity, coalesce(rank, 0) AS rank, 0.7::double * a.similarity + 0.3::double * coalesce(rank, 0) AS score FROM a LEFT JOIN r USING (query_id, id)) SELECT query_id, id, round(similarity, 6) AS similarity, round(rank, 6) AS rank, round(score, 6) AS score, quality FROM {_topk('b', 'score', 5)} LEFT JOIN labels ON doc_id = id")
def hybrid_left(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.hybrid_left(corpus(t), t.labels.select(F.col("doc_id").alias("id"), "quality"), queries_of(t)))


_EN = "(SELECT {0}.* FROM {0} JOIN c USING (id) WHERE lang = 'en')"


@query(f"WITH {_BASE} {_SHOW} {_hybrid(10, 0.7, 0.3, 2, 2, 'whole', _EN.format('r'), _EN.format('s'))} WHERE similarity >= 0.3")
def hybrid_postfilter(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.postfilter(corpus(t), queries_of(t), 10, F.col("lang") == "en", 0.3))


_MAP = {"the": ["thath", "thein"], "de": ["laen", "ouen"], "er": ["berver"]}
_MAPS = "CASE x WHEN 'the' THEN ['thath', 'thein'] WHEN 'de' THEN ['laen', 'ouen'] WHEN 'er' THEN ['berver'] END"


@query(f"""WITH {_BASE}, o AS (SELECT query_id, list_filter(string_split(text, ' '), lambda x: length(x) > 1) AS own FROM q),
e AS (SELECT query_id, own, flatten(list_filter(list_transform(own, lambda x: {_MAPS}), lambda y: y IS NOT NULL)) AS more FROM o),
y AS (SELECT query_id, CASE WHEN len(more) > 0 THEN more ELSE own END[1:5] AS z FROM e), u AS (SELECT query_id, len(z) AS n, unnest(range(0, len(z))) AS no, unnest(z) AS term FROM y),
h AS (SELECT query_id, id, term, no, n, row_number() OVER (PARTITION BY query_id, term ORDER BY id) AS r FROM u JOIN c ON contains(lower(c.text), u.term)),
i AS (SELECT * FROM h WHERE r <= ceil(10 / n) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY no) = 1)
SELECT query_id, id, term, 0.5::double AS score FROM i QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY no, r, id) <= 10""")
def text_expand_search(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return H.expand_search(corpus(t), queries_of(t), _MAP)


@query(f"WITH {_BASE.replace("'and thath'", "'the on'")} {_SHOW} {_hybrid(5, 0.6, 0.4, 3, 2, 'TRUE')}")
def hybrid_topic(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return _round(H.topic_search(corpus(t), queries_of(t), {"and thath": "the on"}, 5))


@query(f"WITH {_BASE}, p AS {_topk('s', 'similarity', 5, 'similarity > 0.45')}, b AS {_topk('r', 'rank', 5)} SELECT query_id, id, round(similarity, 6) AS score FROM p UNION ALL SELECT query_id, id, round(rank, 6) FROM b WHERE query_id NOT IN (SELECT query_id FROM p)")
def search_fallback(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    q = queries_of(t)
    a = V.vector_topk_batch(corpus(t), q.withColumnRenamed("query_id", "id"), 5, 0.45).withColumnRenamed("similarity", "score")
    return _round(H.with_fallback(a, H.keyword_topk_batch(corpus(t), q, 5, "any").withColumnRenamed("rank", "score")))


@query(f"""WITH {_BASE}, a AS (SELECT query_id, id, 1.0::double AS score, 0 AS tier FROM q JOIN c ON c.id = q.query_id), b AS (SELECT query_id, id, 0.7::double AS score, 1 AS tier FROM {_topk('r', 'rank', 2, 'whole')}),
e AS (SELECT query_id, id, similarity AS score, 2 AS tier FROM {_topk('s', 'similarity', 8, 'similarity >= 0.25')}),
u AS (SELECT * FROM (FROM a UNION ALL FROM b UNION ALL FROM e) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY tier, score DESC) = 1),
x AS (SELECT *, (SELECT count(*) FROM u y WHERE y.query_id = u.query_id AND y.tier < u.tier) AS before FROM u)
SELECT query_id, id, round(score, 6) AS score, tier FROM x WHERE before < 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8""")
def search_cascade(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    c, q = corpus(t), queries_of(t)
    exact = q.join(c.select("id"), F.col("id") == F.col("query_id"), "inner").select("query_id", "id", F.lit(1.0).alias("score"))
    words = H.keyword_topk_batch(c, q, 2).withColumn("score", F.lit(0.7))
    near = V.vector_topk_batch(c, q.withColumnRenamed("query_id", "id"), 8).filter("similarity >= 0.25").withColumnRenamed("similarity", "score")
    return _round(H.cascade([exact, words, near]))


@query(f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT query_id, id, round(similarity, 6) AS score, '{lang}' AS corpus FROM (SELECT s.* FROM s JOIN c USING (id) WHERE lang = '{lang}') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= {k}" for lang, k in (("en", 5), ("fr", 3))))
def search_multi_corpus(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    q = queries_of(t).withColumnRenamed("query_id", "id")
    hits = {lang: V.vector_topk_batch(corpus(t).filter(F.col("lang") == lang), q, k).withColumnRenamed("similarity", "score") for lang, k in (("en", 5), ("fr", 3))}
    return _round(H.multi_corpus(hits, {"en": 5, "fr": 3}))


@query(f"WITH {_BASE}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS no FROM s QUALIFY no <= 3) SELECT query_id, string_agg('[' || no || '] ' || substr(text, 1, 80), chr(10) ORDER BY no) AS context, count(*) AS snippets FROM h JOIN c USING (id) GROUP BY query_id")
def context_assemble(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    hits = V.vector_topk_batch(corpus(t), queries_of(t).withColumnRenamed("query_id", "id"), 3).withColumnRenamed("similarity", "score")
    return H.assemble_context(hits.join(corpus(t).select("id", "text"), "id"), "text", 80)


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'what') OR contains(lower(text), '?') THEN 'question' WHEN contains(lower(text), 'the') THEN 'english' WHEN contains(lower(text), 'de') THEN 'romance' ELSE 'other' END AS intent FROM conversations")
def classify_rules(s: SparkSession, d: str) -> DataFrame:
    return T(s, d).conversations.select("conv_id", "turn", X.classify("text", [("question", ["what", "?"]), ("english", ["the"]), ("romance", ["de"])], "other").alias("intent"))


@query("WITH x AS (SELECT p_name AS wrong, p_brand AS correct, p_size / 50.0::double AS confidence FROM part) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY confidence DESC, correct) = 1")
def lookup_correction(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d).part
    return H.best_correction(p.select(F.col("p_name").alias("text")), p.select(F.col("p_name").alias("wrong"), F.col("p_brand").alias("correct"), (F.col("p_size") / 50.0).alias("confidence")))
