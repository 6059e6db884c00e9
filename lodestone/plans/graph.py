"""Queries: graph and tree operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..operators.vector import neighbours_by_vector
from . import inputs as I
from .registry import Tables as T
from .registry import query


def _seeds(s: SparkSession, *ids: int) -> DataFrame:
    return s.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id"))


def _bfs_sql(seeds: str, depth: int) -> str:
    """Shortest paths by levels, ties by path, then type."""
    both = "both_ AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"
    out = [I.EDGES, both, f"l0 AS (SELECT seed, id, 0 AS depth, NULL::int AS type, id::varchar AS path FROM ({seeds}))", "s0 AS (FROM l0)"]
    for d in range(1, depth + 1):
        out.append(f"l{d} AS (SELECT seed, dst AS id, {d} AS depth, b.type, path || '>' || dst AS path FROM l{d - 1} l JOIN both_ b ON b.src = l.id WHERE (seed, dst) NOT IN (SELECT (seed, id) FROM s{d - 1}) QUALIFY row_number() OVER (PARTITION BY seed, dst ORDER BY path, b.type) = 1)")
        out.append(f"s{d} AS (FROM s{d - 1} UNION ALL FROM l{d})")
    return ", ".join(out)


_ONE = "SELECT 0 AS seed, 3::bigint AS id UNION ALL SELECT 0, 17"
_MANY = "SELECT id AS seed, id FROM (SELECT unnest([3, 17, 40])::bigint AS id)"


@query(f"WITH {_bfs_sql(_ONE, 2)} SELECT id, depth, type, path FROM s2 ORDER BY depth, id LIMIT 20")
def graph_bfs(s: SparkSession, d: str) -> DataFrame:
    return G.bfs(I.edges(T(s, d)), _seeds(s, 3, 17), 2, 20)


@query(f"WITH {I.EDGES}, r AS (SELECT src AS ref, dst AS other, strength, 'outgoing' AS direction FROM edges UNION ALL SELECT dst, src, strength, 'incoming' FROM edges) SELECT * FROM r WHERE ref IN (3, 17) QUALIFY row_number() OVER (PARTITION BY ref, direction ORDER BY strength DESC, other) <= 15")
def graph_direct(s: SparkSession, d: str) -> DataFrame:
    return G.direct(I.edges(T(s, d)), _seeds(s, 3, 17), 15)


@query(f"""WITH {_bfs_sql(_ONE, 2)}, {I.TAGS}, f AS (SELECT id, depth FROM s2 ORDER BY depth, id LIMIT 50)
SELECT id, depth, substr(text, 1, 40) AS content, (SELECT string_agg(theme, ',' ORDER BY confidence DESC, theme) FROM tags WHERE ref = id) AS themes, depth = 0 AS is_center,
  (SELECT count(*) FROM edges WHERE src = id AND dst IN (SELECT id FROM f)) AS out_edges FROM f JOIN documents ON doc_id = id""")
def graph_induced(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    content = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("content"))
    nodes, edges = G.induced(I.edges(t), _seeds(s, 3, 17), content, I.tags(t))
    return R.child_counts(nodes, "id", out_edges=edges.select(F.col("src").alias("id")))


@query(f"""WITH {_bfs_sql(_ONE, 2)}, {I.TAGS}, n AS (SELECT id FROM s2 ORDER BY depth, id LIMIT 50), o AS (SELECT DISTINCT ref, theme FROM tags WHERE ref IN (FROM n))
SELECT a.ref AS src, b.ref AS dst, min(a.theme) AS theme, 0.5::double AS strength FROM o a JOIN o b ON a.theme = b.theme AND a.ref < b.ref
WHERE NOT EXISTS (FROM edges e WHERE least(e.src, e.dst) = a.ref AND greatest(e.src, e.dst) = b.ref) GROUP BY 1, 2""")
def graph_theme_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges by theme among the nodes of one search's graph, as the graph view draws them."""
    t = T(s, d)
    return G.theme_edges(G.bfs(I.edges(t), _seeds(s, 3, 17), 2, 50), I.tags(t), I.edges(t))


@query(f"""WITH {I.EDGES}, q AS (SELECT vec_id AS src, vec::double[] AS v FROM (SELECT vec_id, embedding AS vec FROM embeddings WHERE vec_id % 50 = 0)),
p AS (SELECT src, vec_id AS dst, list_cosine_similarity(v, embedding::double[]) AS x FROM q, embeddings WHERE vec_id <> src),
k AS (SELECT src, dst, x FROM p WHERE x > 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY x DESC, dst) <= 5),
n AS (SELECT src, dst, x FROM k WHERE NOT EXISTS (FROM edges e WHERE least(e.src, e.dst) = least(k.src, k.dst) AND greatest(e.src, e.dst) = greatest(k.src, k.dst)))
SELECT src, dst, type::varchar AS type, strength FROM edges UNION ALL SELECT src, dst, 'semantic', round(x, 6) FROM n""")
def graph_semantic_edges(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    near = neighbours_by_vector(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding"), 0.3, 5)
    near = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.round("similarity", 6).alias("similarity"))
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("depth"))
    return G.add_semantic(nodes, I.edges(t), near)[1]


@query(f"WITH {_bfs_sql(_MANY, 2)}, k AS (FROM s2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, id) <= 20) SELECT id, seed, depth FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, seed) = 1")
def graph_multi_seed(s: SparkSession, d: str) -> DataFrame:
    return G.multi_seed(I.edges(T(s, d)), _seeds(s, 3, 17, 40))


_LABELS = {"0": "parallel", "1": "quotes", "2": "fulfils"}


@query(f"WITH {I.EDGES}, n AS (SELECT doc_id FROM documents WHERE lang = 'en'), x AS (SELECT src, dst, CASE type WHEN 0 THEN 'parallel' WHEN 1 THEN 'quotes' WHEN 2 THEN 'fulfils' ELSE type::varchar END AS label FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)) SELECT src, dst, label, src || ' is linked to ' || dst || ' (' || label || ')' AS text FROM x")
def graph_relations_among(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    return G.relations_among(I.edges(t), t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("id")), _LABELS)


@query(f"WITH {I.EDGES}, x AS (SELECT src, src || ' is linked to ' || dst || ' (' || CASE type WHEN 0 THEN 'parallel' WHEN 1 THEN 'quotes' WHEN 2 THEN 'fulfils' ELSE type::varchar END || ')' AS text FROM edges) SELECT src, string_agg(text, '; ' ORDER BY text COLLATE \"C\") AS text, count(*) AS edges FROM x GROUP BY src".replace(' COLLATE "C"', ""))
def explain_edges(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    rel = G.relations_among(I.edges(t), t.documents.select(F.col("doc_id").alias("id")), _LABELS)
    return G.explain(rel, "src", "text")


_WALK = f"WITH RECURSIVE {I.TREE}, w AS (SELECT id, parent, name, ord, 0 AS depth, '/' || name AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.name, t.ord, w.depth + 1, w.path || '/' || t.name FROM tree t JOIN w ON t.parent = w.id)"


@query(_WALK + " SELECT id, parent, depth FROM w ORDER BY depth, ord, id")
def tree_walk(s: SparkSession, d: str) -> DataFrame:
    return G.tree_walk(I.tree(T(s, d)), "id", "parent").orderBy("depth", "ord", "id").select("id", "parent", "depth")


@query(f"""WITH {I.TREE}, k AS (SELECT parent, string_agg(name, ',' ORDER BY ord, id) AS kids FROM tree WHERE parent LIKE 'n%' GROUP BY 1),
m AS (SELECT t.parent, string_agg(CASE WHEN kids IS NULL THEN name ELSE name || '(' || kids || ')' END, ',' ORDER BY ord, id) AS kids FROM tree t LEFT JOIN k ON k.parent = t.id WHERE t.parent LIKE 'r%' GROUP BY 1)
SELECT id, CASE WHEN kids IS NULL THEN name ELSE name || '(' || kids || ')' END AS nested FROM tree t LEFT JOIN m ON m.parent = t.id WHERE t.parent IS NULL""")
def tree_nest(s: SparkSession, d: str) -> DataFrame:
    return G.nest(I.tree(T(s, d)), "id", "parent", "name", "ord")


@query(_WALK + " SELECT id, path, depth FROM w")
def tree_paths(s: SparkSession, d: str) -> DataFrame:
    return G.tree_paths(I.tree(T(s, d)), "id", "parent", "name")


@query(f"WITH {I.EDGES}, l0 AS (SELECT 1::bigint AS id, 0 AS depth), " + ", ".join(f"l{k} AS (SELECT DISTINCT dst AS id, {k} AS depth FROM l{k - 1} JOIN edges ON src = id WHERE dst NOT IN (SELECT id FROM s{k - 1})), s{k} AS (FROM s{k - 1} UNION ALL FROM l{k})" if k else "s0 AS (FROM l0)" for k in range(6)) + " SELECT id, depth, row_number() OVER (ORDER BY depth, id) AS no FROM s5 ORDER BY no LIMIT 40")
def graph_crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    return G.link_frontier(I.edges(T(s, d)), _seeds(s, 1), 5, 40)


@query(f"WITH {I.EDGES} SELECT src, dst, strength FROM edges WHERE type = 2")
def graph_type_filter(s: SparkSession, d: str) -> DataFrame:
    return G.edges_of_type(I.edges(T(s, d)), 2).select("src", "dst", "strength")


@query(f"WITH {I.KIN}, u AS (SELECT k.person, p.c_custkey AS other, 'parent' AS kind FROM kin k JOIN customer p ON p.c_custkey = k.parent AND p.c_custkey <> k.person UNION ALL SELECT k.parent, k.person, 'child' FROM kin k JOIN customer p ON p.c_custkey = k.parent AND p.c_custkey <> k.person UNION ALL SELECT DISTINCT x.member, y.member, 'co-participant' FROM bridge x JOIN bridge y USING (event) WHERE x.member <> y.member) SELECT person, count_if(kind = 'parent') AS parents, count_if(kind = 'child') AS children, count_if(kind = 'co-participant') AS partners FROM u GROUP BY person")
def graph_kin(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    kind = lambda k: F.count_if(F.col("kind") == k)
    return G.kin_union(I.kin(t), I.bridge(t)).groupBy("person").agg(kind("parent").alias("parents"), kind("child").alias("children"), kind("co-participant").alias("partners"))
