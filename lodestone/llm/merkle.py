"""Merkle dataset manifest: leaf coordinates by rank queries on bitmaps, levels by keyed slot arrays.

Each group's ids are a bitmap that is kept as its non-empty words of 64 bits; every task makes the words of what it reads,
and those of equal places are merged by OR. A directory holds the number of rows below each word, built in levels of
FAN words. A row's place in its group is then the directory's number plus the bits below its own in its word: no sort of
the rows, however many a group has. Each run of `arity` places is one key with an array of slots; its digest is a slot one
level higher. Paths go down again the same way, so that every join is between a run and its own nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Store, table

#: Words of a bitmap, and nodes, below one entry of the next level of a directory, as a power of two.
FAN = 10
#: The word of the smallest id; rows without an id have the word 0.
FIRST = 1 - (-(2**63) >> 6)
#: Places of equal rows that one step makes.
COPIES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """sha256 (lowercase hex) of the fields one after another: `-` for null, else the length in UTF-8 bytes, `:` and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def number(store: Store, df: DataFrame, by: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with `_before`: the rows (or the sum of weights) before each in the order of `by`, nulls first. Ranges of rows are sorted in tasks of their own; only their totals meet."""
    w = F.col(weight) if weight else F.lit(1)
    rows = store.write(df.repartitionByRange(*by).withColumn("_task", F.spark_partition_id()).withColumn("_w", w.cast("long")), name)
    totals = rows.groupBy("_task").agg(F.sum("_w").alias("_total"))
    totals = totals.select("_task", (F.sum("_total").over(Window.orderBy("_task")) - F.col("_total")).alias("_base"))
    own = F.sum("_w").over(Window.partitionBy("_task").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return rows.withColumn("_own", own).join(F.broadcast(totals), "_task").withColumn("_before", F.col("_base") + F.col("_own")).drop("_task", "_w", "_own", "_base")


def below(store: Store, nodes: DataFrame, name: str) -> DataFrame:
    """(group, key, n) with `below`: the sum of n of the group's smaller keys. A window holds 2^FAN keys at most."""
    lo, hi = nodes.agg(F.min("key"), F.max("key")).first()
    up = F.shiftright("key", FAN)
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if lo is None or lo >> FAN == hi >> FAN:
        return nodes.withColumn("below", before("group"))
    parents = store.write(nodes.groupBy("group", up.alias("key")).agg(F.sum("n").alias("n")), name)
    parents = below(store, parents, f"{name}_").select("group", F.col("key").alias("_up"), F.col("below").alias("_above"))
    within = nodes.withColumn("_up", up).withColumn("_within", before("group", "_up"))
    return within.join(parents, ["group", "_up"]).withColumn("below", F.col("_above") + F.col("_within")).drop("_up", "_above", "_within")


def places(store: Store, rows: DataFrame, last: list[str]) -> DataFrame:
    """rows (group string, id long, ...) with `pos`: the place in the group by ascending id, null first, gapless from 0.

    Equal ids are ordered by the columns `last`; rows that are equal in all columns are counted, and get consecutive places.
    """
    at = rows.withColumn("word", F.coalesce(F.shiftright("id", 6) + FIRST, F.lit(0))).withColumn("bit", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int"))
    words = store.write(at.groupBy("group", F.col("word").alias("key")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")), "words")
    directory = store.write(below(store, words, "directory"), "ranks").withColumnsRenamed({"key": "word"})
    ranked, single = at.join(directory, ["group", "word"]), F.col("n") == F.bit_count("bits")
    own = F.col("below") + F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    out = ranked.where(single).select(*rows.columns, own.alias("pos"))
    if directory.where(~single).limit(1).count():  # ids that several rows share
        key = ["group", "word", "id", *last]
        again = ranked.where(~single).groupBy(*key, *(c for c in rows.columns if c not in key), "below").agg(F.count("*").alias("_copies"))
        again = store.write(number(store, again, key, "again", "_copies"), "numbered")
        first = again.groupBy("group", "word").agg(F.min("_before").alias("_first"))
        again = again.join(first, ["group", "word"]).withColumn("_at", F.col("below") + F.col("_before") - F.col("_first"))
        again = again.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(COPIES)))).repartition("_at", "_block")
        copy = F.explode(F.sequence(F.col("_at") + F.col("_block"), F.col("_at") + F.least(F.col("_block") + COPIES, F.col("_copies")) - 1))
        out = out.unionByName(again.select(*rows.columns, copy.alias("pos")))
    return store.write(out, "places")


def _lone() -> Column:
    """Whether a run is all of its group's level: its node is the group's root and is not hashed again."""
    return (F.col("run") == 0) & (F.size("slots") == 1)


def climb(store: Store, nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, as runs (group, run, slots), from nodes (group, pos, digest); and the roots (group, digest)."""
    levels, roots = [], None
    while True:
        slot = F.struct((F.col("pos") % arity).alias("slot"), "digest")
        runs = nodes.groupBy("group", F.expr(f"pos div {arity}").alias("run")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        runs = store.write(runs.withColumn("slots", F.col("slots.digest")), f"{name}_{len(levels)}")
        levels.append(runs)
        lone = runs.where(_lone()).select("group", F.col("slots")[0].alias("digest"))
        roots = roots.unionByName(lone) if roots else lone
        more = runs.where(~_lone())
        if not more.limit(1).count():
            return levels, roots
        nodes = more.select("group", F.col("run").alias("pos"), F.sha2(F.array_join("slots", ""), 256).alias("digest"))


def siblings(slots: str, at: Column) -> Column:
    """The digests before and after one slot of a run, joined."""
    return F.struct(F.array_join(F.slice(slots, F.lit(1), at.cast("int")), "").alias("before"), F.array_join(F.slice(slots, (at + 2).cast("int"), F.size(slots)), "").alias("after"))


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The runs of the lowest level with `above`, the siblings on the way from their nodes' parents to the top, and the columns of tops (group, above, ...)."""
    upper = None
    for runs in reversed(levels):
        out = runs.where(_lone()).join(tops, "group")
        if upper is not None:
            step = upper.select("group", F.col("run").alias("_up"), F.col("slots").alias("_slots"), _lone().alias("_top"), *(c for c in tops.columns if c != "group"))
            low = runs.where(~_lone()).withColumn("_up", F.expr(f"run div {arity}")).join(step, ["group", "_up"])
            own = F.array(siblings("_slots", F.col("run") % arity))
            out = out.unionByName(low.withColumn("above", F.when(F.col("_top"), F.col("above")).otherwise(F.concat(own, "above"))).drop("_up", "_slots", "_top"))
        upper = out
    return upper


def manifest(docs: DataFrame, leaf: Column, key: str = "doc_id", group: str = "lang", arity: int = 8, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: key, group, leaf, pos (place in the group), subroot, root and proof, an array of the siblings' digests before and after, from the leaf's run to the root's; and the columns of `keep`.

    Per group, leaves ascend by key; while a level has several nodes, each `arity` consecutive ones become the digest of
    theirs, the last run as it is. The groups' roots, ordered by group (null first, bytewise), give the root in the same way.
    Rows without a key come first in their group; rows that share a key are ordered by leaf, and equal rows get one place each.
    A lone leaf is its group's root. No rows give no rows.
    """
    store, keep = Store(docs.sparkSession, "merkle_manifest"), keep or {}
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(named.alias("group"), F.col(key).cast("long").alias("id"), leaf.alias("digest"), *(c.alias(f"_{n}") for n, c in keep.items()))
    leaves = places(store, rows, ["digest"])
    levels, subroots = climb(store, leaves.select("group", "pos", "digest"), arity, "run")
    subroots = store.write(number(store, subroots, ["group"], "groups").withColumnRenamed("_before", "_pos"), "subroots")
    top, root = climb(store, subroots.select(F.lit("").alias("group"), F.col("_pos").alias("pos"), "digest"), arity, "top")
    none = F.lit([]).cast("array<struct<before:string,after:string>>")
    ways = descend(top, root.select("group", F.col("digest").alias("root"), none.alias("above")), arity)
    tops = _paths(subroots.select(F.col("group").alias("_group"), F.lit("").alias("group"), F.col("_pos").alias("pos"), F.col("digest").alias("subroot")), ways, arity)
    tops = store.write(tops.select(F.col("_group").alias("group"), "subroot", "root", F.col("proof").alias("above")), "tops")
    out = _paths(leaves, descend(levels, tops, arity), arity)
    return out.select(F.col("id").alias(key), F.when(F.col("group") != "-", F.substring("group", 2, 1 << 30)).alias(group), F.col("digest").alias("leaf"), "pos", "subroot", "root", "proof", *(F.col(f"_{n}").alias(n) for n in keep))


def _paths(nodes: DataFrame, runs: DataFrame, arity: int) -> DataFrame:
    """nodes with `proof`, all siblings on their way, and what runs carry."""
    out = nodes.withColumn("run", F.expr(f"pos div {arity}")).join(runs, ["group", "run"])
    own = F.array(siblings("slots", F.col("pos") % arity))
    return out.withColumn("proof", F.when(_lone(), F.col("above")).otherwise(F.concat(own, "above"))).drop("run", "slots", "above")


def fold(leaf: Column, proof: Column | str) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and which rows a change of A-Z to a-z in every third text would give away.

    A row without doc_id is not tampered with; where text is null there is nothing to change.
    """
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest({**fields, "text": lower}))
    rows = manifest(docs, leaf_digest(fields), keep={"changed": changed})
    siblings_of = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_of, 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), "proof").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 bit by bit: a byte is added, then eight steps follow, which -1 stands for.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_SIBLINGS = """
{0}_sib AS (
  SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {0}_nodes WINDOW w AS (PARTITION BY g, lvl, pos // 8 ORDER BY pos))"""
_NODES = "{0}_nodes(g, lvl, pos, n, h) AS ({1} UNION ALL SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {0}_nodes WHERE n > 1 GROUP BY g, lvl, pos // 8, n)"
_WALK = """{0}_walk(rid, g, lvl, pos, n, h, p) AS ({1} UNION ALL
  SELECT rid, w.g, w.lvl + 1, w.pos // 8, (w.n + 7) // 8, sha256(b || h || a), p || b || a FROM {0}_walk w JOIN {0}_sib s ON w.g = s.g AND w.lvl = s.lvl AND w.pos = s.pos WHERE n > 1)"""
SQL = f"""
WITH RECURSIVE digests AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS g, {_LEAF} AS leaf,
    CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM digests),
{_NODES.format("low", "SELECT g, 0, pos, n, leaf FROM leaves")},{_SIBLINGS.format("low")},
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low_nodes WHERE n = 1),
{_NODES.format("top", "SELECT '', 0, pos, n, h FROM subroots")},{_SIBLINGS.format("top")},
{_WALK.format("low", "SELECT rid, g, 0, pos, n, coalesce(changed, leaf), '' FROM leaves")},
{_WALK.format("top", "SELECT rid, '', 0, s.pos, s.n, w.h, w.p FROM low_walk w JOIN subroots s USING (g) WHERE w.n = 1")}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(w.p) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves JOIN top_walk w USING (rid) JOIN subroots s ON leaves.g = s.g, (SELECT h FROM top_nodes WHERE n = 1) r
WHERE w.n = 1
"""
