"""Graph operators over edge tables (src, dst, type, strength) and parent-child tables.

Traversals go level by level: a frontier is joined with the edges, visited nodes are removed by an anti-join, and each level
is written to the shared folder, so that the plan doesn't grow. Trees are climbed by pointer doubling. Only tests for an empty
frontier reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .relational import both_ends_in, coparticipants, first_per, string_ordered, tagged_union, topk_per, undirected


def relations(edges: DataFrame) -> DataFrame:
    """Edges of both directions, tagged: ref, other, strength, direction."""
    out = edges.select(F.col("src").alias("ref"), F.col("dst").alias("other"), "strength")
    back = edges.select(F.col("dst").alias("ref"), F.col("src").alias("other"), "strength")
    return tagged_union("direction", {"outgoing": out, "incoming": back})


def kin_union(kin: DataFrame, bridge: DataFrame | None) -> DataFrame:
    """Parents and children of (person, parent) where both are persons, and members that share an event (member, event)."""
    k = kin.filter("parent <> person").join(kin.select(F.col("person").alias("parent")).distinct(), "parent", "left_semi")
    parts = {"parent": k.select("person", F.col("parent").alias("other")), "child": k.select(F.col("parent").alias("person"), F.col("person").alias("other"))}
    if bridge is not None:
        parts["co-participant"] = coparticipants(bridge, "member", "event").toDF("person", "other")
    return tagged_union("kind", parts)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nodes within `depth` undirected steps of the seeds (id, and `keys` that name separate searches): id, depth, type, path.

    The nearest path stays, of equally near ones the smallest path, then type. Seeds have depth 0 and no type. With a limit, the first
    nodes by depth and id.
    """
    spark = edges.sparkSession
    both = undirected(edges.select("src", "dst", "type"))
    seen = seeds.select(*keys, "id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("type"), F.col("id").cast("string").alias("path")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        near = frontier.select(*keys, F.col("id").alias("src"), "path").join(both, "src")
        step = near.select(*keys, F.col("dst").alias("id"), F.lit(level).alias("depth"), "type", F.concat("path", F.lit(">"), F.col("dst").cast("string")).alias("path"))
        step = first_per(step.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti"), [*keys, "id"], ["path", "type"])
        frontier = _cut(step, spark)
        seen = seen.unionByName(frontier)
        if level < depth and frontier.isEmpty():
            break
    return topk_per(seen, list(keys), ["depth", "id"], limit) if limit and keys else seen.orderBy("depth", "id").limit(limit) if limit else seen


def _cut(df: DataFrame, spark) -> DataFrame:
    """Written to the shared folder and read again, so that plans don't grow by level and lost executors cost little."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def direct(edges: DataFrame, seeds: DataFrame, n: int = 15) -> DataFrame:
    """At most n edges of each side of each seed, strongest first."""
    rel = relations(edges).join(seeds.select(F.col("id").alias("ref")), "ref", "left_semi")
    return topk_per(rel, ["ref", "direction"], [F.desc("strength"), F.asc("other")], n)


def induced(edges: DataFrame, seeds: DataFrame, content: DataFrame, tags: DataFrame, depth: int = 2, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes around the seeds with content and tags in order of confidence, and the edges with both ends among them."""
    found = bfs(edges, seeds, depth, limit)
    themes = tags.withColumn("_less", -F.col("confidence")).groupBy(F.col("ref").alias("id")).agg(string_ordered("theme", ["_less", "theme"], ",").alias("themes"))
    nodes = found.join(content.select("id", "content"), "id", "left").join(themes, "id", "left").select("id", "depth", "content", "themes", (F.col("depth") == 0).alias("is_center"))
    return nodes, both_ends_in(edges, found, "id")


def _pair(df: DataFrame) -> DataFrame:
    return df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def theme_edges(nodes: DataFrame, tags: DataFrame, edges: DataFrame, strength: float = 0.5) -> DataFrame:
    """Pairs of nodes that share a theme and no edge in either direction: src < dst, the first theme. nodes are those of one graph to show, some hundreds: all their pairs may come out."""
    own = tags.join(nodes.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("ref", "theme").distinct()
    a, b = own.toDF("src", "theme"), own.toDF("dst", "theme")
    pairs = a.join(b, "theme").filter("src < dst").groupBy("src", "dst").agg(F.min("theme").alias("theme"))
    linked = _pair(edges).toDF("src", "dst")
    return pairs.join(linked, ["src", "dst"], "left_anti").withColumn("strength", F.lit(strength))


def add_semantic(nodes: DataFrame, edges: DataFrame, similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, depth) and edges (src, dst, type, strength) with the similar pairs (src, dst, similarity) that no edge joins yet."""
    new = similar.join(_pair(edges), [F.least("src", "dst") == F.col("a"), F.greatest("src", "dst") == F.col("b")], "left_anti")
    more = new.select("src", "dst", F.lit("semantic").alias("type"), F.col("similarity").alias("strength"))
    ids = first_per(nodes.select("id", "depth").unionByName(similar.select(F.col("dst").alias("id"), F.lit(1).alias("depth"))), ["id"], ["depth"])
    return ids, edges.select("src", "dst", F.col("type").cast("string").alias("type"), "strength").unionByName(more)


def multi_seed(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_seeds: int = 5, limit: int = 20) -> DataFrame:
    """The searches of up to max_seeds seeds merged: each node with its smallest depth, then smallest seed."""
    first = seeds.select("id").distinct().orderBy("id").limit(max_seeds)
    found = bfs(edges, first.select(F.col("id").alias("seed"), "id"), min(depth, 2), limit, keys=("seed",))
    return first_per(found, ["id"], ["depth", "seed"]).select("id", "seed", "depth")


def relations_among(edges: DataFrame, nodes: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Edges with both ends in nodes, labelled, with a sentence each."""
    from ..functions.text import label

    found = both_ends_in(edges, nodes, "id")
    named = found.withColumn("label", label("type", labels))
    return named.select("src", "dst", "label", F.format_string("%d is linked to %d (%s)", "src", "dst", "label").alias("text"))


def explain(edges: DataFrame, key: str, text: str) -> DataFrame:
    """The sentences of a key's edges in one text."""
    return edges.groupBy(key).agg(string_ordered(text, [text], "; ").alias("text"), F.count("*").alias("edges"))


#: Levels of a tree; rows that still go on are a cycle, which is an error.
LEVELS = 10_000


def _climb(df: DataFrame, id: str, parent: str, name: str | None, max_depth: int) -> DataFrame:
    """id, depth and path of all nodes that roots reach, by pointer doubling: each round, a node that points k levels up points 2k levels up.

    So a tree of d levels takes log2(d) rounds, each a join of the open nodes with all. Nodes whose way up ends at a missing parent drop out. Ids are expected once each.
    """
    path = F.concat(F.lit("/"), F.col(name)) if name else F.lit("")
    nodes = df.select(F.col(id).alias("id"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"), path.alias("path"))
    for _ in range(max(1, max_depth).bit_length() + 1):
        nodes = _cut(nodes, df.sparkSession)
        rest = nodes.filter("up is not null")
        if rest.isEmpty():
            if nodes.filter(F.col("depth") > max_depth).limit(1).count():
                break
            return nodes.drop("up")
        above = nodes.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        step = rest.join(above, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", "path").alias("path"))
        nodes = nodes.filter("up is null").unionByName(step)
    raise ValueError(f"a path of more than {max_depth} levels")


def tree_walk(df: DataFrame, id: str, parent: str, max_depth: int = LEVELS) -> DataFrame:
    """All nodes that roots (null parent) reach, with their depth. ValueError where a path has more than max_depth levels."""
    return df.join(_climb(df, id, parent, None, max_depth).select(F.col("id").alias(id), "depth"), id).select(*df.columns, "depth")


def tree_paths(df: DataFrame, id: str, parent: str, name: str, max_depth: int = LEVELS) -> DataFrame:
    """id, path '/a/b/c' of the names, depth. ValueError where a path has more than max_depth levels."""
    return _climb(df, id, parent, name, max_depth).select(F.col("id").alias(id), "path", "depth")


def nest(df: DataFrame, id: str, parent: str, name: str, order: str) -> DataFrame:
    """Roots with nested children, at most three levels, as text 'name(child(grandchild,...),...)'. Rows whose parent is missing are roots."""
    ids = df.select(F.col(id).alias("_p")).distinct()
    known = df.join(ids, F.col(parent) == F.col("_p"), "left").withColumn(parent, F.col("_p")).drop("_p")
    level = lambda rows, kids: rows.join(kids, F.col(id) == F.col("_k"), "left").withColumn("nested", F.when(F.col("kids").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("("), "kids", F.lit(")")))).drop("_k", "kids")
    group = lambda rows: rows.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_k")).agg(string_ordered("nested", [order, id], ",").alias("kids"))
    leaves = group(known.withColumn("nested", F.col(name)))
    middle = group(level(known, leaves))
    return level(known, middle).filter(F.col(parent).isNull()).select(id, "nested")


def link_frontier(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 100) -> DataFrame:
    """Pages in breadth order from the seeds over directed links (src, dst), at most max_pages: id, depth, no."""
    seen = seeds.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, max_depth + 1):
        step = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        frontier = _cut(step, links.sparkSession)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    first = seen.orderBy("depth", "id").limit(max_pages)
    return first.withColumn("no", F.row_number().over(Window.orderBy("depth", "id")))


def edges_of_type(edges: DataFrame, type: int | None = None) -> DataFrame:
    return edges if type is None else edges.filter(F.col("type") == type)
