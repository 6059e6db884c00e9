"""Benchmark decontamination by SimHash windows.

Windows of a document with as many words as an item get a 64-bit SimHash of their word shingles, each as often as it
occurs. Item fingerprints are indexed by BLOCKS blocks of bits: of two fingerprints within the radius at least one block
differs in at most (RADIUS + 1) / BLOCKS - 1 bits, and all block values so near are looked up, so that the index misses no
fingerprint within the radius. Candidates within the radius are verified by exact weighted similarity, the sum of the lesser over the
sum of the greater counts of all shingles. A window without any shingle of the items of its size has similarity 0 with
each of them, and is not hashed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .vectors import LOWER, NOT_SPACE, flat, hash_spans, roll, texts, whole, words

#: Windows of similarity 0.75 differ in 11 bits on average with a deviation of 3: 19 bits hold 99.6 % of them, and more of those more alike.
RADIUS, BLOCKS, SHINGLE = 19, 4, 5
#: Items that are searched for in one pass over the documents; more go in further passes.
ITEMS = 20_000
_BITS = np.arange(64, dtype=np.uint64)


def signs(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    return (((s[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    return roll(w, k) if len(w) >= k else np.array([whole(w)], np.uint64) if len(w) else np.zeros(0, np.uint64)


def masks(width: int, near: int) -> np.ndarray:
    """All values of `width` bits with at most `near` ones."""
    return np.array([sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(width), k)], np.uint64)


def _spread(a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [a, e), and which range each is of."""
    size = e - a
    k = np.repeat(np.arange(len(a)), size)
    return np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size), k


class Items:
    """Items of one size in words: fingerprints in a multi-index, and shingles with counts."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], radius: int):
        self.ids = [i for i, _ in rows]
        self.counts = [Counter(s.tolist()) for _, s in rows]
        self.size = len(rows[0][1])
        self.radius = radius
        self.prints = fingerprints(np.stack([signs(s).sum(0) for _, s in rows]))
        self.width = 64 // BLOCKS
        near = -(-(radius + 1) // BLOCKS) - 1
        #: Differences of a block that are looked up.
        self.probes = masks(self.width, near)
        self.blocks = []
        for a in range(0, 64, self.width):
            part = self._part(self.prints, a, a + self.width)
            order = np.argsort(part, kind="stable")
            value, first = np.unique(part[order], return_index=True)
            self.blocks.append((a, near, value, np.append(first, len(order)), order))

    @staticmethod
    def _part(x: np.ndarray, a: int, b: int) -> np.ndarray:
        return (x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Pairs of a position in x and an item, as position * items + item, with a block that differs in few bits."""
        found = []
        for a, near, value, first, order in self.blocks:
            own, at = np.unique(self._part(x, a, a + self.width), return_inverse=True)
            if len(value) <= len(self.probes):
                i, v = np.nonzero(np.bitwise_count(own[:, None] ^ value) <= near)
            else:
                probe = (own[:, None] ^ self.probes).ravel()
                v = np.minimum(np.searchsorted(value, probe), len(value) - 1)
                hit = np.flatnonzero(value[v] == probe)
                i, v = hit // len(self.probes), v[hit]
            # every position with such a value, then every item with such a value
            by = np.argsort(at, kind="stable")
            begin = np.searchsorted(at[by], np.arange(len(own) + 1))
            pos, k = _spread(begin[i], begin[i + 1])
            i, v = by[pos], v[k]
            pos, k = _spread(first[v], first[v + 1])
            found.append(i[k] * len(self.ids) + order[pos])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def near(self, x: np.ndarray) -> set[tuple[int, int]]:
        """(position in x, item) of all fingerprints within the radius."""
        pairs = self.candidates(x)
        at, item = pairs // len(self.ids), pairs % len(self.ids)
        keep = np.bitwise_count(x[at] ^ self.prints[item]) <= self.radius
        return set(zip(at[keep].tolist(), item[keep].tolist(), strict=True))


class Benchmark:
    def __init__(self, rows: list[tuple[int, str | None]], k: int = SHINGLE, radius: int = RADIUS):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.k, known = k, []
        for i, text in rows:
            w = word_hashes(text)
            if len(w):
                by_size.setdefault(len(w), []).append((i, shingles(w, k)))
                known.append(by_size[len(w)][-1][1])
        self.sizes = {n: Items(x, radius) for n, x in sorted(by_size.items())}
        #: The item sizes that a shingle occurs in.
        self.sizes_of: dict[int, set[int]] = {}
        for n, rows in by_size.items():
            for _, s in rows:
                for x in s.tolist():
                    self.sizes_of.setdefault(x, set()).add(n)
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.short = sorted(n for n in self.sizes if n < k)

    def search(self, w: np.ndarray, s: np.ndarray, hits: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each item. w: hashes of the document's words; s: of its shingles; hits: which of these the benchmark has."""
        best: dict[int, tuple[float, int, int]] = {}
        where: dict[int, list[int]] = {}
        for i in np.flatnonzero(hits).tolist():
            for n in self.sizes_of[int(s[i])]:
                where.setdefault(n, []).append(i)
        for n in sorted({*where, *self.short} if len(w) >= self.k else {*self.sizes}):
            items = self.sizes[n]
            if n < self.k:
                own = np.array([whole(w[i : i + n]) for i in range(len(w) - n + 1)], np.uint64)
                near_hits = np.flatnonzero(np.isin(own, self.known))
                size = 1
            else:
                own, near_hits, size = s, np.array(where.get(n, []), np.int64), min(items.size, len(s))
            if not len(near_hits) or not len(own):
                continue
            cover = np.zeros(len(own) + 1, np.int64)
            np.add.at(cover, np.maximum(0, near_hits - size + 1), 1)
            np.add.at(cover, near_hits + 1, -1)
            windows = np.flatnonzero(np.cumsum(cover[:-1])[: len(own) - size + 1] > 0)
            for part in np.split(windows, np.flatnonzero(np.diff(windows) > size) + 1):
                if not len(part):
                    continue
                lo = int(part[0])
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(own[lo : part[-1] + size]), axis=0, dtype=np.int32)])
                prints = fingerprints(sums[part - lo + size] - sums[part - lo])
                for i, item in items.near(prints):
                    p = int(part[i])
                    have, want = Counter(own[p : p + size].tolist()), items.counts[item]
                    least = sum(min(c, have[x]) for x, c in want.items() if x in have)
                    similarity = least / (size + items.size - least)
                    if similarity >= threshold and (old := best.get(items.ids[item], (-1.0, 0, 0))) and (similarity, -p) > (old[0], -old[1]):
                        best[items.ids[item]] = (similarity, p, min(n, len(w)))
        return [(i, p, n, x) for i, (x, p, n) in best.items()]


def word_hashes(text: str | None) -> np.ndarray:
    data, at = flat(pa.array([text], pa.string()))
    data = LOWER[data]
    starts, ends, _ = words(data, at, NOT_SPACE)
    return hash_spans(data, starts, ends)


def passes(docs: DataFrame, benchmark: DataFrame, radius: int) -> Iterator[Broadcast]:
    """The benchmark's items, in as many parts as passes over the documents."""
    spark, n = docs.sparkSession, benchmark.count()
    parts = max(1, -(-n // ITEMS))
    dealt = benchmark.select("item_id", "text").withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for k in range(parts):
        rows = sorted(((r["item_id"], r["text"]) for r in dealt.where(F.col("pass") == k).collect()), key=lambda r: (r[0] is None, r))
        yield spark.sparkContext.broadcast(Benchmark(rows, SHINGLE, radius))


def found_in(batch: pa.RecordBatch, bench: Benchmark, threshold: float) -> list[tuple]:
    """(row of the batch, item_id, start_word, n_words, similarity)"""
    found = []
    for i, j, data, at in texts(batch):
        data = LOWER[data]
        starts, ends, first = words(data, at, NOT_SPACE)
        w = hash_spans(data, starts, ends)
        s = roll(w, bench.k)
        known = bench.known
        hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
        total = np.append(0, np.cumsum(hit))
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            a = int(a)
            e = max(a, int(b) - bench.k + 1)
            if b > a and (total[min(e, len(s))] > total[min(a, len(s))] or bench.short or b - a < bench.k):
                for item, p, n, x in bench.search(w[a:b], s[a:e], hit[a:e], threshold):
                    found.append((i + d, item, p, n, x))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start_word, n_words, similarity of the best window.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles have five words, or are the whole item where it has
    fewer. A document shorter than an item is one window. Null and wordless texts hold nothing, wordless items are held
    by nothing. Of equally similar windows the first counts. Repeated rows give rows of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    out = None
    for index in passes(docs, benchmark, radius):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[row], *rest) for row, *rest in found_in(batch, index.value, threshold)]
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Each row is judged by its own text, whatever other rows have its doc_id.

    Null and wordless texts hold nothing and stay; repeated rows stay or go together. Without items, or rows, all rows
    stay; all columns are kept.
    """
    for index in passes(docs, table(spark, sf_dir, "benchmark"), RADIUS):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in found_in(batch, index.value, 0.75)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
s AS (SELECT doc_id, unnest(range(0, len(words) - 4)) AS p, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS s FROM w WHERE len(words) >= 5),
i AS (SELECT item_id, len(words) AS n, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS s FROM b WHERE len(words) >= 5),
c AS (SELECT item_id, n, s, count(*) AS c FROM i GROUP BY ALL),
h AS (SELECT s.doc_id, s.p, c.item_id, c.n FROM s JOIN c USING (s)),
l AS (SELECT doc_id, len(words) AS l FROM w),
v AS (SELECT DISTINCT h.doc_id, item_id, least(n, l) AS n, n AS m, unnest(range(greatest(0, p - (n - 5)), least(p, greatest(0, l - n)) + 1)) AS start_word FROM h JOIN l USING (doc_id)),
x AS (SELECT v.doc_id, v.item_id, v.n, v.m, v.start_word, s.s, count(*) AS k FROM v JOIN s ON s.doc_id = v.doc_id AND s.p BETWEEN v.start_word AND v.start_word + v.n - 5 GROUP BY ALL),
y AS (SELECT doc_id, item_id, x.n, m, start_word, sum(least(k, c.c)) AS q FROM x JOIN c USING (item_id, s) GROUP BY ALL),
z AS (SELECT doc_id, item_id, start_word, n AS n_words, q / (n - 4 + m - 4 - q) AS similarity FROM y)
SELECT doc_id, item_id, start_word, n_words, round(similarity, 6) AS similarity FROM z WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1
"""
