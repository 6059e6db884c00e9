"""K-d tree sharding, with DataFrame functions alone.

Every document is a point in metadata space (size, language, source). All nodes of a level are split at once: the widest
dimension of each node is found by one small aggregate, and the weighted median (or the quantile that the numbers of
leaves on both sides ask for) by histograms of bytes that are refined until the cut is exact to a thousandth of a leaf.
The driver sees at most LEAVES * BINS sums a pass, whatever the input. Equal texts are one range, with the metadata of their
smallest doc_id, ordered among themselves by a hash of the doc_id: a cut that falls among them moves to the nearer of their
ends if that is within SLACK of a shard, so that they stay in one shard; else it splits them. Texts are told apart within a
dimension's value by a hash, so that a source or a text that holds a third of all rows is split like any other range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Store, table

BINS, TOLERANCE, SLOTS = 4096, 0.001, 10_000
#: How far of a shard's bytes a cut may move so as not to split equal texts.
SLACK = 0.03
#: Bits of a key that order rows of equal texts.
LOW = 20
DIMENSIONS = ("k_size", "k_lang", "k_source")


def _low(c: Column) -> Column:
    return F.pmod(c, F.lit(1 << 20))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text, and a 20-bit code for each dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("th"),
        F.least(F.log2(size.cast("double")) / 40 * (1 << 20), F.lit((1 << 20) - 1)).cast("long").alias("c_size"),
        _low(F.xxhash64(F.coalesce(F.col("lang"), F.lit("")))).alias("c_lang"),
        _low(F.xxhash64(F.coalesce(F.col("source"), F.lit("")))).alias("c_source"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """rows of points() with a 60-bit key per dimension: 20 bits of the code, for equal texts of their first row's, 20 of the text's hash, LOW of the doc_id's."""
    text = ["th", "text_crc32", "size"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c_lang", "c_source")).alias("first")
    groups = rows.groupBy(*text).agg(F.count("*").alias("n"), first).where("n > 1").drop("n")
    own = rows.join(groups, text, "left")
    tie = F.shiftleft(_low(F.col("th")), LOW) + _low(F.xxhash64("doc_id"))
    code = {"k_size": F.col("c_size"), **{f"k_{c}": F.coalesce(F.col(f"first.c_{c}"), F.col(f"c_{c}")) for c in ("lang", "source")}}
    return own.select("doc_id", "size", "text_crc32", *[(F.shiftleft(c, 40) + tie).alias(k) for k, c in code.items()])


class Node:
    """A range of leaves; once split, the dimension and the key from which on rows go right."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves, self.cut, self.sides = first, leaves, None, None

    def split(self, dimension: str, key: int) -> None:
        half = self.leaves // 2
        self.cut, self.sides = (dimension, key), (Node(self.first, half), Node(self.first + half, self.leaves - half))

    def ends(self) -> list[Node]:
        return [n for s in self.sides for n in s.ends()] if self.sides else [self]

    def column(self) -> Column:
        if not self.sides:
            return F.lit(self.first)
        return F.when(F.col(self.cut[0]) < F.lit(self.cut[1]), self.sides[0].column()).otherwise(self.sides[1].column())


def _per_node(values: dict[int, object], of) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col("node") == k, of(v)).otherwise(out)
    return out


def tree(rows: DataFrame, leaves: int) -> Node | None:
    """The k-d tree over rows of points(); None for an empty table."""
    root, spread = Node(0, leaves), None
    while open_ := [n for n in root.ends() if n.leaves > 1]:
        here = rows.withColumn("node", root.column()).where(F.col("node").isin([n.first for n in open_]))
        found = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("size"), *[f(d).alias(f"{at}_{d}") for d in DIMENSIONS for at, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if not found:
            if root.sides is None:
                return None
            for n in open_:
                n.split(DIMENSIONS[0], 0)
            continue
        width = lambda r, d: (r[f"hi_{d}"] >> 40) - (r[f"lo_{d}"] >> 40)
        spread = spread or {d: max(1, max(width(r, d) for r in found.values())) for d in DIMENSIONS}
        state = {}
        for n in open_:
            if n.first not in found:  # no rows: any cut will do
                n.split(DIMENSIONS[0], 0)
                continue
            r = found[n.first]
            d = max(DIMENSIONS, key=lambda d, r=r: width(r, d) / spread[d])
            half = n.leaves // 2
            state[n.first] = {"n": n, "d": d, "unit": LOW, "lo": r[f"lo_{d}"] >> LOW, "hi": (r[f"hi_{d}"] >> LOW) + 1, "target": r["size"] * half / n.leaves, "before": 0, "leaf": r["size"] / n.leaves}
        while state:
            for s in state.values():
                s["step"] = -(-(s["hi"] - s["lo"]) // BINS)
            key = _per_node(state, lambda s: F.col(s["d"]))
            lo, hi, step, unit = (_per_node(state, lambda s, k=k: F.lit(s[k])) for k in ("lo", "hi", "step", "unit"))
            part = here.where(F.col("node").isin([*state])).select("node", "size", key.alias("key"), lo.alias("lo"), hi.alias("hi"), step.alias("step"), unit.alias("unit"))
            part = part.withColumn("key", F.expr("shiftright(key, unit)")).where("key >= lo and key < hi")
            bins: dict[int, list[tuple[int, int, int]]] = {}
            for r in part.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
                bins.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
            for k, s in list(state.items()):
                at = s["before"]
                for b, weight, n in sorted(bins[k]):
                    if at + weight >= s["target"]:
                        break
                    at += weight
                left, right = s["lo"] + b * s["step"], s["lo"] + (b + 1) * s["step"]
                miss = min(s["target"] - at, at + weight - s["target"])
                if n == 1 or s["step"] == 1 and (not s["unit"] or miss <= SLACK * s["leaf"]) or weight <= TOLERANCE * s["leaf"]:
                    s["n"].split(s["d"], (left if s["target"] - at < weight / 2 else right) << s["unit"])
                    del state[k]
                elif s["step"] == 1:  # equal texts that can't stay together
                    s.update(lo=left << s["unit"], hi=right << s["unit"], unit=0, before=at)
                else:
                    s.update(lo=left, hi=min(right, s["hi"]), before=at)
    return root


def kd_shards(docs: DataFrame, shards: int = 24, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 8. The law is `bytes`: shards hold near equal sizes. With target_bytes
    the number of shards is the smallest that keeps them at it. Equal texts share a shard unless a cut falls
    among them and is farther than SLACK of a shard from both their ends; so groups of up to twice SLACK are never split, and each
    cut splits one group at most. slot counts from 0 within a shard without gaps; repeated rows get slots of their own, and so do rows with a null doc_id. Null lang and source count as empty. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    store = Store(docs.sparkSession, "kd_shards")
    rows = store.write(points(docs), "points")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if target_bytes:
        shards = max(1, -(-(total["size"] or 0) // target_bytes))
    rows = store.write(keyed(rows), "keyed")
    root = tree(rows, shards) if total["n"] else None
    groups = max(1, total["n"] // shards // SLOTS)
    placed = rows.withColumn("shard", (root.column() if root else F.lit(0)).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    before = placed.groupBy("shard", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    numbered = placed.withColumn("no", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    return numbered.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("no") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))
