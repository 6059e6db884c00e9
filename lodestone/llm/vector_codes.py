"""Vector codes: the parts of vectors as indexes into codebooks that Lloyd's rounds make, assigned by cover trees.

Each task puts the parts of its vectors into cover trees, one per part position and block of vectors: a node's points lie
within its radius of its centre, its children's centres are more than half that radius apart and each covers points within half of it. A
tree's points stand in one order, in which every subtree is a range, so that running totals give the sum of any subtree.
In a round, a node goes as a whole to the codebook entry nearest to its centre if no other entry can be nearer to any of
its points (triangle inequality: the second nearest is farther by more than twice the radius); other nodes hand over to
their children, and leaves compare their points exactly, in integers. The trees are written once and serve all rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, table

#: Points of a leaf that aren't split further; vectors of a block, whose trees are built together.
LEAF, BLOCK = 16, 4096
#: Components are held to 2^24 units, so that every sum of squares fits in 64 bits.
MOST = 1 << 24
_TREE = "vec_ids array<long>, labels array<{label}>, points binary, orders binary, nodes binary, ends array<int>"
#: Of a node: the centre's place among the block's points, the range of its points in the order, its first child and their number.
_NODE = np.dtype([("centre", "<i4"), ("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def usable(vector: str | Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def units(rows: list, width: int) -> np.ndarray:
    """floor(256 x) of each component as integers, shorter vectors filled up with 0."""
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        x = np.floor(np.asarray(r, np.float64) * 256)
        out[k, : len(x)] = np.clip(x, -MOST, MOST)
    return out


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact; floating point only where it holds every number in between."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, points.shape[1]) < 1 << 52 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points and the nodes, parents before children. A node is not split if that takes more than a child for every two points."""
    order = np.arange(len(points), dtype=np.int32)
    away = lambda c, rows: np.sqrt(((points[rows] - points[c]) ** 2).sum(1).astype(np.float64))
    nodes, k = [[0, 0, len(points), 0, 0, float(away(0, order).max(initial=0))]], 0
    while k < len(nodes):
        centre, start, end, _, _, radius = nodes[k]
        rest, parts, half = order[start:end], [], radius / 2
        if end - start > LEAF and radius > 0:
            far = away(centre, rest)
            while len(rest) and 2 * len(parts) <= end - start:
                near = far <= half
                parts.append((centre, rest[near], float(far[near].max())))
                rest = rest[~near]
                if len(rest):
                    centre = int(rest[0])
                    far = away(centre, rest)
        if parts and not len(rest):
            order[start:end] = np.concatenate([p for _, p, _ in parts])
            nodes[k][3:5] = len(nodes), len(parts)
            for c, p, r in parts:
                nodes.append([c, start, start + len(p), 0, 0, r])
                start += len(p)
        k += 1
    return order, np.array([tuple(n) for n in nodes], _NODE)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    done = np.cumsum(lengths)
    return np.repeat(starts - (done - lengths), lengths) + np.arange(done[-1] if len(done) else 0)


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that go as a whole and their entries, and places in the order of the points that were compared and theirs."""
    at, whole, theirs, alone, own = np.zeros(1, np.int64), [], [], [], []
    while len(at):
        here = nodes[at]
        d = np.sqrt(squares(points[here["centre"]], entries).astype(np.float64))
        best = d.argmin(1)
        first = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.inf
        second = d.min(1)
        clear = first + 2 * here["radius"] < second * (1 - 1e-9) - 1e-9
        whole.append(at[clear])
        theirs.append(best[clear])
        leaf = here[~clear & (here["children"] == 0)]
        places = ranges(leaf["start"].astype(np.int64), (leaf["end"] - leaf["start"]).astype(np.int64))
        if len(places):
            alone.append(places)
            own.append(squares(points[order[places]], entries).argmin(1))
        inner = here[~clear & (here["children"] > 0)]
        at = ranges(inner["child"].astype(np.int64), inner["children"].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (whole, theirs, alone, own))


def sums(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every entry the sum of its points and their number; whole subtrees by running totals."""
    whole, theirs, alone, own = assign(points, order, nodes, entries)
    running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], 0, out=running[1:])
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    start, end = nodes["start"][whole], nodes["end"][whole]
    np.add.at(total, theirs, running[end] - running[start])
    np.add.at(count, theirs, end - start)
    np.add.at(total, own, points[order[alone]])
    np.add.at(count, own, 1)
    return total, count


def codes(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    whole, theirs, alone, own = assign(points, order, nodes, entries)
    out = np.zeros(len(points), np.int64)
    length = (nodes["end"][whole] - nodes["start"][whole]).astype(np.int64)
    out[order[ranges(nodes["start"][whole].astype(np.int64), length)]] = np.repeat(theirs, length)
    out[order[alone]] = own
    return out


def _trees(parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            points = units(batch.column("vector").to_numpy(zero_copy_only=False), width)
            d = width // parts
            built = [cover_tree(points[:, k * d : (k + 1) * d]) for k in range(parts)]
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c))  # noqa: E731, B023
            cols = [one("vec_id"), one("label"), pa.array([points.astype("<i4").tobytes()], pa.binary()), pa.array([b"".join(o.tobytes() for o, _ in built)], pa.binary())]
            cols += [pa.array([b"".join(n.tobytes() for _, n in built)], pa.binary()), pa.array([np.cumsum([len(n) for _, n in built]).tolist()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_ids", "labels", "points", "orders", "nodes", "ends"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple]:
    """Of each block its row, its points and, part by part, the tree."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            points = np.frombuffer(row.column("points")[0].as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
            orders = np.frombuffer(row.column("orders")[0].as_buffer(), "<i4").reshape(parts, -1)
            nodes, ends = np.frombuffer(row.column("nodes")[0].as_buffer(), _NODE), row.column("ends")[0].as_py()
            d = width // parts
            yield row, points, [(points[:, j * d : (j + 1) * d], orders[j], nodes[a:b]) for j, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error) of every usable vector, and the codebooks, an array (entries, components) for each part.

    A component x counts as floor(256 x), held to 2^24 units on either side. Vectors that are null or hold nulls, NaN or
    infinities are left out. The length is the longest one's, filled up to a multiple of `parts`; shorter vectors are filled
    up with 0. Codebooks begin as the vectors of the smallest ids (null last; equal ids by their vectors), of fewer if there
    are no more; ties go to the lower index and unused entries stay. Repeated rows are coded one by one. No rows give no rows
    and empty codebooks.
    """
    spark = vectors.sparkSession
    store = Store(spark, "vector_codes")
    rows = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts) * parts
    kind = rows.schema["label"].dataType.simpleString()
    trees = store.write(rows.mapInArrow(_trees(parts, width), _TREE.format(label=kind)), "trees")
    first = units([r["vector"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()], width)
    d = width // parts
    books = [first[:, k * d : (k + 1) * d].copy() for k in range(parts)]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, len(books[0]), d), np.int64), np.zeros((parts, len(books[0])), np.int64)
        for _, _, own in _blocks(batches, parts, width):
            for k, (points, order, nodes) in enumerate(own):
                t, n = sums(points, order, nodes, books[k])
                total[k] += t
                count[k] += n
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    for _ in range(rounds if len(first) else 0):
        found = trees.mapInArrow(totals, "part int, entry int, n long, total array<long>")
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(d))).collect()  # parts * entries rows
        for r in found:
            books[r["part"]][r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(d)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, points, own in _blocks(batches, parts, width):
            found = np.stack([codes(p, order, nodes, books[k]) for k, (p, order, nodes) in enumerate(own)], 1)
            error = sum(((p - books[k][found[:, k]]) ** 2).sum(1) for k, (p, _, _) in enumerate(own))
            cols = [row.column("vec_ids").flatten(), row.column("labels").flatten(), pa.array(list(found.astype(np.int32)), pa.list_(pa.int32())), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "codes", "error"])

    return trees.mapInArrow(coded, f"vec_id long, label {kind}, codes array<int>, error long"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all embeddings, their errors, the errors of each label, and a digest of the codebooks."""
    rows, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = Store(spark, "vector_codes").write(rows, "coded")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: The same by comparing every part with every entry.
SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
  FROM kept, (SELECT unnest(range(16)) AS p)
),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, k, x FROM parts JOIN first USING (vec_id)),
{rounds},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(format('{{:x}}', k), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM assigned2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM book2) AS codebooks_sha256
FROM coded
"""
_ROUND = """
assigned{a} AS (
  SELECT vec_id, label, p, x, m % 64 AS k, m // 64 AS d FROM (
    SELECT a.vec_id, any_value(a.label) AS label, a.p, any_value(a.x) AS x,
      min(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 64 + b.k)::BIGINT AS m
    FROM parts a JOIN book{a} b ON a.p = b.p GROUP BY a.vec_id, a.p))"""
_MEANS = """
means{a} AS (
  SELECT p, k, list(y ORDER BY i) AS x FROM (
    SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y
    FROM assigned{a}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS i) GROUP BY p, k, i) GROUP BY p, k),
book{b} AS (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{a} b LEFT JOIN means{a} m ON b.p = m.p AND b.k = m.k)"""
SQL = SQL.format(rounds=",".join([_ROUND.format(a=0), _MEANS.format(a=0, b=1), _ROUND.format(a=1), _MEANS.format(a=1, b=2), _ROUND.format(a=2)]))
