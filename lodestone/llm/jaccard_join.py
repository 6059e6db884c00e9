"""Near-duplicate join on word shingles: size-banded tiles, bitmap signatures, exact intersection.

1. Documents with one shingle set form a node (128 bits of the set); only nodes are compared. A node has a parity bitmap of
   its set. Tiles name it by the first 64 bits; nodes that share these are told apart wherever sets are compared.
2. Tiles: two sets that reach the similarity share a shingle among the first n - ceil(t n) + 1 of each, under any one
   order of all shingles. The order puts frequent shingles last (a bounded list of them, found over all documents), so
   tiles - a shingle and a band of sizes - stay small. Lists of the nodes in a tile are all that is kept.
3. Each node is first compared with one leader of its tiles, which joins groups of near copies into components with a
   comparison per node. Then the members of tiles that hold several components meet: a task compares the bitmaps of a part of
   a tile with those of another part, and only pairs of different components whose bitmaps allow the similarity leave it -
   first the most alike one of each member, which merges components, then more in those tiles that have more, in the end all.
4. Bitmaps bound the overlap from above: |A & B| <= (|A| + |B| - popcount(a ^ b)) / 2, and so does the place of a shared
   shingle in both orders. Pairs that may reach the similarity have their sorted arrays intersected.
A pair is left out only if its ends are in one component already; so components are those of all links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, components, table, text_digest
from .vectors import binary_rows, mix, shingle_sets, texts

#: Frequent shingles that are told apart (8 bytes each), the smallest count of one, those that a task reports.
FREQUENT, FREQUENT_COUNT, REPORTED = 1 << 18, 16, 1 << 14
#: Candidates of a member in a tile, round by round; None: all.
ROUNDS = (1, 16, None)
#: Most members of a list without salt; members that one leader serves; members of a part of a tile; bytes of a bucket.
LIST, BLOCK, PART, BUCKET = 8192, 256, 2048, 8 << 20
_POSTING = np.dtype([("token", "u1", 5), ("cls", "<i8"), ("n", "<u4"), ("at", "u1")])


def _signature(s: np.ndarray) -> bytes:
    bits = 64
    while bits < len(s) and bits < 8192:
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _nodes(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each set; None for empty ones."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out: list[bytes | None] = [None] * len(sets)
    if len(full):
        s = np.concatenate(sets)
        first = np.cumsum(size[full]) - size[full]
        h, g = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0xA0761D6478BD642F))
        d = np.empty((len(full), 2), np.uint64)
        d[:, 0] = (np.add.reduceat(h, first) ^ np.bitwise_xor.reduceat(h * np.uint64(0x9E3779B97F4A7C15), first)) + size[full].astype(np.uint64)
        d[:, 1] = np.add.reduceat(g, first) + np.bitwise_xor.reduceat(g * np.uint64(0xD6E8FEB86659FD93), first)
        raw = mix(d).tobytes()
        for k, x in enumerate(full.tolist()):
            out[x] = raw[16 * k : 16 * k + 16]
    return out


def _class(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


class Counts:
    """Counts of frequent tokens: those met at least `least` times in a chunk; at most `most` are carried."""

    def __init__(self, chunk: int = 1 << 21, least: int = 3, most: int = 1 << 17):
        self.chunk, self.least, self.most, self.held, self.parts = chunk, least, most, 0, []
        self.tokens, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.parts.append(s)
        self.held += len(s)
        if self.held >= self.chunk:
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        t, n = np.unique(np.concatenate(self.parts), return_counts=True)
        keep = (n >= self.least) | np.isin(t, self.tokens)
        t, at = np.unique(np.concatenate([self.tokens, t[keep]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([self.n, n[keep]]), minlength=len(t)).astype(np.int64)
        top = np.sort(np.argsort(-n, kind="stable")[: self.most])
        self.tokens, self.n, self.parts, self.held = t[top], n[top], [], 0


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents: doc_id, n, cls and node (null without words), the text's digest, and for the first of a node in a task its signature and its text, compressed. A last row of each task: frequent shingles and their counts there."""
    names = ["doc_id", "n", "cls", "node", "signature", "z", "frequent", "counts", "digest"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, packer = Counts(), set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, digest = batch.column("doc_id").cast(pa.int64()), batch.column("digest")
            for i, j, data, at in texts(batch):
                sets = shingle_sets(data, at, k)
                nodes = _nodes(sets)
                signed, packed = [None] * len(sets), [None] * len(sets)
                raw, begin = data.tobytes(), at.tolist()
                for x, (s, node) in enumerate(zip(sets, nodes, strict=True)):
                    counts.add(s)
                    if node is not None and node not in seen:
                        seen.add(node)
                        signed[x], packed[x] = _signature(s), packer.compress(raw[begin[x] : begin[x + 1]])
                none = pa.array([None] * len(sets), longs)
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([None if x is None else _class(x) for x in nodes], pa.int64()), pa.array(nodes, pa.binary()), binary_rows(signed), binary_rows(packed)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols, none, none, digest.slice(i, j - i)], names)
        counts.fold()
        top = np.argsort(-counts.n, kind="stable")[:REPORTED]
        empty = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([counts.tokens[top].view(np.int64).tolist()], longs), pa.array([counts.n[top].tolist()], longs), pa.array([None], pa.binary())], names)

    rows = docs.select("doc_id", "text", text_digest().alias("digest"))
    return rows.mapInArrow(run, "doc_id long, n long, cls long, node binary, signature binary, z binary, frequent array<long>, counts array<long>, digest binary")


def _needed(n: int, t: int) -> int:
    return -(-t * n // 100)


def _band(n: np.ndarray, t: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / t) + 1e-9).astype(np.int64)


def postings(docs: DataFrame, k: int, t: int, frequent, buckets: int) -> DataFrame:
    """(bucket, blob, salted): the postings of each task for a bucket; a node is posted once a task. salted names the tile of a shingle with over LIST members, whose members are dealt over several lists; each is in the tiles of its band of sizes and of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = frequent.value
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([s for s, _, _ in held])
            lens = np.array([len(s) for s, _, _ in held])
            p = np.empty(len(token), _POSTING)
            p["cls"] = np.repeat(np.array([c for _, c, _ in held], np.int64), lens)
            p["n"] = np.repeat(np.array([n for _, _, n in held]), lens)
            p["at"] = np.concatenate([np.arange(k) * 255 // k for k in lens]).astype(np.uint8)
            salted = np.zeros(len(token), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, token), len(often) - 1)
                hot = (often[at] == token) & (count[at] > LIST)
                if hot.any():
                    h = mix(p["cls"][hot].view(np.uint64))
                    salts = -(-count[at[hot]] // LIST).astype(np.uint64)
                    band = _band(p["n"][hot].astype(np.int64), t)
                    add = []
                    for tile in (band, band + 1):
                        name = mix(token[hot] + mix(tile.astype(np.uint64)))
                        salt = mix(name ^ mix(h % salts + np.uint64(1)))
                        # every 512th member meets in one more list, which joins those of the salts
                        meet = h % np.uint64(512) == 0
                        add += [(salt, name, p[hot]), (name[meet], name[meet], p[hot][meet])]
                    token = np.concatenate([token[~hot], *[x for x, _, _ in add]])
                    salted = np.concatenate([salted[~hot], *[y.view(np.int64) | 1 for _, y, _ in add]])
                    p = np.concatenate([p[~hot], *[z for _, _, z in add]])
            bucket = (token & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            p, salted = p[order], salted[order]
            p["token"] = np.ascontiguousarray(token[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :5]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            part = lambda x, b: x[cut[b] : cut[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), binary_rows([part(p, b).tobytes() for b in full]), binary_rows([part(salted, b).tobytes() if part(salted, b).any() else None for b in full])], ["bucket", "blob", "salted"])

        for batch in batches:
            for _, _, data, at in texts(batch):
                sets = shingle_sets(data, at, k)
                for s, node in zip(sets, _nodes(sets), strict=True):
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    p = len(s) - _needed(len(s), t) + 1
                    first = s[:p]
                    if len(often):
                        i = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        f = often[i] == s
                        first = s[~f][:p]
                        if len(first) < p:
                            first = np.concatenate([first, s[f][np.lexsort([s[f], count[i[f]]])][: p - len(first)]])
                    held.append((first, _class(node), len(s)))
                    size += p
                if size >= 1 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, blob binary, salted binary")


def tile_lists(posted: DataFrame, t: int) -> DataFrame:
    """(list_id, cls, n, at, lead): members of the tiles with several nodes; equal lists count once. at is where the shingle stands in the set's prefix (0 to 255); lead is the member that this one is compared with first."""

    def bucket(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        p = np.concatenate([np.frombuffer(r["blob"], _POSTING) for r in rows])
        salted = np.concatenate([np.frombuffer(r["salted"], np.int64) if r["salted"] else np.zeros(len(r["blob"]) // _POSTING.itemsize, np.int64) for r in rows])
        token = np.zeros((len(p), 8), np.uint8)
        token[:, :5] = p["token"]
        token = token.view("<u8").ravel()
        order = np.lexsort([p["at"], p["cls"], p["n"], salted, token])
        token, cls, n, place, salted = token[order], p["cls"][order], p["n"][order].astype(np.int64), p["at"][order].astype(np.int64), salted[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (salted[1:] != salted[:-1]) | (cls[1:] != cls[:-1]) | (n[1:] != n[:-1])
        token, cls, n, place, salted = token[keep], cls[keep], n[keep], place[keep], salted[keep]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salted[1:] != salted[:-1]) | (100 * n[:-1] < t * n[1:])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(token)))
        with np.errstate(over="ignore"):
            member = np.add.reduceat(mix(cls.view(np.uint64) + n.astype(np.uint64)), first)
        hot = salted[first] != 0
        name = np.where(hot, salted[first], mix(member + size.astype(np.uint64)).view(np.int64) & ~np.int64(1))
        # of equal lists the one whose shingle comes first in its members' order
        by = np.lexsort([np.add.reduceat(place, first), np.where(hot, np.arange(len(first)), -1), name])
        head = np.ones(len(first), bool)
        head[1:] = (name[by][1:] != name[by][:-1]) | hot[by][1:]
        once = np.zeros(len(first), bool)
        once[by[head]] = True
        rows_of = np.repeat(((size > 1) | hot) & once, size)
        start, at = np.repeat(first, size)[rows_of], np.flatnonzero(rows_of)
        pos = at - start
        lead = cls[start + np.where(pos % BLOCK == 0, np.maximum(pos - BLOCK, 0), pos - pos % BLOCK)]
        return pa.table({"list_id": np.repeat(name, size)[rows_of], "cls": cls[at], "n": n[at], "at": place[at].astype(np.int32), "lead": lead})

    return posted.groupBy("bucket").applyInArrow(bucket, "list_id long, cls long, n long, at int, lead long")


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _most(n: int, m: np.ndarray, odd: np.ndarray) -> np.ndarray:
    return (n + m - odd) // 2


def _bound(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps allow the similarity."""
    for batch in batches:
        keep = []
        for a, b, n, m in zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint8) for s in (a, b))
            size = min(len(x), len(y))
            most = _most(n, m, int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()))
            keep.append(100 * most >= t * (n + m - most))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])


def tile_pairs(tile: pa.Table, t: int, quota: int | None) -> pa.Table:
    """Pairs (x, y) of nodes of different components in two parts of a tile whose sizes, places and bitmaps allow the similarity. Of each member outside of the largest component at most `quota`, the most alike first; a row with the tile alone says that there are more."""
    out: set[tuple[bytes, bytes]] = set()
    more = False
    _, part = np.unique(np.array(tile.column("component").to_pylist(), "S16"), return_inverse=True)
    if part.max() > 0:
        n, at, group = (tile.column(c).to_numpy() for c in ("n", "at", "group"))
        order = np.argsort(n, kind="stable")
        n, at, group, part = n[order], at[order], group[order], part[order]
        node, signature = tile.column("node").to_pylist(), tile.column("signature").to_pylist()
        bits = [np.frombuffer(signature[k], np.uint64) for k in order]
        size = np.array([len(b) for b in bits])
        # sizes rise with n; stacks[s]: (first member, members' bitmaps) folded to s words, as far as sizes may be linked
        stacks, far = {}, 1 << (-(-100 // t) - 1).bit_length()
        for s in np.unique(size).tolist():
            a, e = np.searchsorted(size, [s, far * s + 1])
            stacks[s] = (int(a), np.stack([_fold(bits[k], s) for k in range(a, e)]))
        # what two sets share lies behind the first shingle that they share: `left` of either bounds it
        left = n - at * (n - -(-t * n // 100) + 1) // 255
        main, two = np.bincount(part).argmax(), tile.column("i")[0].as_py() != tile.column("j")[0].as_py()
        lo, hi = np.searchsorted(n, -(-t * n // 100)), np.searchsorted(n, 100 * n // t, "right")
        reach = t * n - (100 + t) * left
        for k in np.flatnonzero(part != main).tolist():
            a, e = int(lo[k]), int(hi[k])
            # (100 + t) min(left) >= t (n + m), for both
            other = (part[a:e] != part[k]) & (reach[a:e] <= -t * n[k]) & (t * n[a:e] <= -reach[k])
            if two:
                other &= group[a:e] != group[k]
            j = np.flatnonzero(other) + a
            if not len(j):
                continue
            most = np.zeros(len(j), np.int64)
            sizes = np.minimum(size[j], size[k])
            for s in np.unique(sizes).tolist():
                first, stack = stacks[s]
                own = j[sizes == s]
                most[sizes == s] = _most(n[k], n[own], np.bitwise_count(stack[own - first] ^ _fold(bits[k], s)).sum(1, dtype=np.int64))
            ok = 100 * most >= t * (n[j] + n[k] - most)
            j, most = j[ok], most[ok]
            if quota is not None and len(j) > quota:
                j, more = j[np.lexsort([j, -most])[:quota]], True
            x = node[order[k]]
            out.update((min(x, y), max(x, y)) for y in (node[order[m]] for m in j.tolist()) if x != y)
    last = [(None, None, *(tile.column(c)[0].as_py() for c in ("list_id", "i", "j")))] * more
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    rows = [(x, y, None, None, None) for x, y in out] + last
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["x", "y", "list_id", "i", "j"])


def _exact(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = []
        for x, y in zip(batch.column("sx"), batch.column("sy"), strict=True):
            x, y = unpack(x.as_buffer()), unpack(y.as_buffer())
            both = len(np.intersect1d(x, y, assume_unique=True))
            share.append(both / (len(x) + len(y) - both) if 100 * both >= t * (len(x) + len(y) - both) else None)
        out = pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(share, pa.float64())], ["x", "y", "similarity"])
        yield out.filter(out.column("similarity").is_valid())


def pack(s: np.ndarray) -> bytes:
    """Sorted hashes, 48 bits each."""
    return np.ascontiguousarray(np.ascontiguousarray(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def arrays(kept: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, s): the packed sets of the wanted nodes, from kept (node, z), which is bucketed by node and stays in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in (whole.slice(x, 256) for x in range(0, whole.num_rows, 256)):
                raw = pa.array([unzip.decompress(z.as_buffer()) for z in batch.column("z")], pa.binary()).cast(pa.string())
                sets = [pack(s) for _, _, data, at in texts(pa.RecordBatch.from_arrays([raw], ["text"])) for s in shingle_sets(data, at, k)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), binary_rows(sets)], ["node", "s"])

    return kept.join(wanted, "node", "left_semi").mapInArrow(run, "node binary, s binary")


class Join:
    """Nodes, links between them and components, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 75):
        spark = docs.sparkSession
        store = self.store = Store(spark, "jaccard_join")
        rows = store.write(shingle_classes(docs, shingle), "rows")
        self.documents = rows.where("n is not null").select("doc_id", "n", "node", "digest")
        top = rows.where("frequent is not null").select(F.explode(F.arrays_zip("frequent", "counts")).alias("x")).groupBy(F.col("x.frequent").alias("token")).agg(F.sum("x.counts").alias("n"))
        top = top.where(F.col("n") >= FREQUENT_COUNT).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
        token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.argsort(token)
        frequent = spark.sparkContext.broadcast((token[order], n[order]))
        total = rows.agg(F.sum("n")).first()[0] or 0
        buckets = 1 << max(6, (int(total) * _POSTING.itemsize // 4 // BUCKET).bit_length())
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
        nodes = rows.where("cls is not null").groupBy("cls", "node").agg(best, F.max("n").alias("n"), F.max("signature").alias("signature"))
        #: (cls, node, best, n, signature); best: the row with the smallest doc_id, null last, then the smallest digest.
        self.nodes = nodes = store.write(nodes, "nodes")
        kept = self._kept(rows.where("z is not null").select("node", "z"))
        lists = store.write(tile_lists(postings(docs, shingle, percent, frequent, min(buckets, 1 << 16)), percent), "lists")

        def verified(pairs: DataFrame, name: str) -> DataFrame:
            wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
            sets = arrays(kept, wanted, shingle)
            both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
            return store.write(both.select("x", "y", "sx", "sy").mapInArrow(lambda it: _exact(it, percent), "x binary, y binary, similarity double"), f"links_{name}")

        def of_tile(quota: int | None):
            return lambda tile: tile_pairs(tile, percent, quota)

        # one pair for each member: the leader that it meets most often; and nodes with one name
        own = lists.where("lead <> cls").repartition("cls").groupBy("cls", "lead").count().groupBy("cls").agg(F.max_by("lead", F.struct("count", (-F.col("lead")).alias("l"))).alias("lead"))
        own = own.unionByName(nodes.groupBy("cls").count().where("count > 1").select("cls", F.col("cls").alias("lead")))
        side = lambda c, s: nodes.select(F.col("cls").alias(c), F.col("node").alias(s), F.col("n").alias(f"n{c[0]}"), F.col("signature").alias(f"s{c[0]}"))
        led = own.select(F.col("cls").alias("a"), F.col("lead").alias("b")).join(side("a", "x"), "a").join(side("b", "y"), "b")
        led = led.where(f"x <> y and 100 * least(na, nb) >= {percent} * greatest(na, nb)").mapInArrow(lambda it: _bound(it, percent), "x binary, y binary")
        tried = store.write(led.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "tried")
        found = [verified(tried, "0")]
        parts = store.write(components(found[0], spark, store, "edges_0", "x", "y"), "parts_0")
        part_of = lambda: nodes.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # lists that lie in one component are done with
        member = lists.groupBy("list_id", "cls", "n").agg(F.min("at").alias("at"))
        sizes = member.join(part_of().select("cls", "n", F.xxhash64("component").alias("c")), ["cls", "n"]).groupBy("list_id").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("list_id", "m")
        groups = F.ceil(F.col("m") / PART).cast("int")
        rest = member.join(sizes, "list_id").join(nodes.select("cls", "node", "n"), ["cls", "n"]).withColumn("group", F.pmod(F.xxhash64("node"), groups).cast("int"))
        rest = rest.withColumn("k", F.explode(F.sequence(F.lit(0), groups - 1))).withColumn("i", F.least("group", "k")).withColumn("j", F.greatest("group", "k"))
        rest = store.write(rest.select("list_id", "i", "j", "group", "node", "at"), "mixed")
        for k, quota in enumerate(ROUNDS, 1):
            tiles = rest.join(part_of().select("node", "component", "n", "signature"), "node").groupBy("list_id", "i", "j").applyInArrow(of_tile(quota), "x binary, y binary, list_id long, i int, j int")
            tiles = store.write(tiles.distinct().join(tried, ["x", "y"], "left_anti"), f"tiles_{k}")
            pairs = tiles.where("x is not null").select("x", "y")
            if not pairs.isEmpty():
                found.append(verified(pairs, str(k)))
                tried = tried.unionByName(pairs)
                if not found[-1].isEmpty():
                    star = parts.select(F.col("id").alias("x"), F.col("component").alias("y"))
                    parts = store.write(components(found[-1].select("x", "y").unionByName(star), spark, store, f"edges_{k}", "x", "y"), f"parts_{k}")
            again = tiles.where("x is null").select("list_id", "i", "j")
            if again.isEmpty():
                break
            rest = store.write(rest.join(again, ["list_id", "i", "j"], "left_semi"), f"mixed_{k}")
        #: (x, y, similarity) between nodes: enough links for all components.
        self.links = reduce(DataFrame.unionByName, found)
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        linked = store.write(parts.join(nodes.select(F.col("node").alias("id"), "best"), "id"), "linked")
        linked = linked.join(linked.groupBy("component").agg(F.min("best").alias("first")), "component").select(F.col("id").alias("node"), "first")
        #: (node, best): the row of the node's component that stays.
        self.components = store.write(nodes.select("node", "best").join(linked, "node", "left").select("node", F.coalesce("first", "best").alias("best")), "components")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """One text a node as a table bucketed by node in the shared folder: what is fetched later moves no texts."""
        spark = rows.sparkSession
        size = int(rows.agg(F.sum(F.octet_length("z"))).first()[0] or 0)
        n = min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (32 << 20))))
        self.table = f"lodestone_texts_{uuid.uuid4().hex}"
        rows.repartition(n, "node").dropDuplicates(["node"]).write.option("path", self.store.path("texts")).bucketBy(n, "node").sortBy("node").saveAsTable(self.table)
        return spark.table(self.table)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set is the distinct shingles, the whole sequence where words are
    fewer, empty for null and wordless texts, which are linked with nothing. Links: 100 |A & B| >= percent |A | B|.
    Repeated rows are rows of one node. A null doc_id is larger than any other; a component of such rows alone has null.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    j = Join(docs, shingle, percent)
    return j.documents.join(j.components, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of the smallest doc_id, null last, then of the smallest digest of the text; of rows with that doc_id and text one.

    Null and wordless texts are in no component and stay, repeated ones too. Other texts under the doc_id of a row that goes,
    or without one, stay. Columns are those of docs. An empty table gives an empty result.
    """
    j = Join(docs)
    rows = j.documents.join(j.components, "node").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest")))
    marked = j.store.write(rows.groupBy("doc_id", "digest", "stays").count().where("not stays or count > 1").select("doc_id", "digest", "stays"), "marked")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (text_digest("d.text") == F.col("g.digest"))
    kept = docs.alias("d").join(marked.alias("g"), same, "left_anti")
    many = docs.alias("d").join(marked.where("stays").alias("g"), same).select("d.*", F.col("g.digest").alias("_kept_digest"))
    return kept.unionByName(many.dropDuplicates(["doc_id", "_kept_digest"]).drop("_kept_digest"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
