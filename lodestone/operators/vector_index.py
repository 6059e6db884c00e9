"""A stored index for approximate vector search: lists around centres, sign codes in each list, exact similarity of candidates.

build() fits about sqrt(n) centres on a sample, splits lists that hold too many rows, deals every row to its nearest centre, and
writes codes and vectors, both sorted by list over files. A search reads each query's nearest lists only, and compares in full the
rows whose codes differ least, in the task that reads them: no candidates are shuffled or broadcast. How many lists are probed and how many candidates are
kept is chosen at build time by the recall that it measures on some of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best import Best
from .relational import topk_per
from .vector import QUERIES, vector_topk_batch

#: Bits of a code; lists at most; rows of the sample that centres are fitted on at most; rows that recall is measured on.
BITS, LISTS, SAMPLE, PROBED = 256, 4096, 65_536, 64
#: A list is split beyond so many times the mean; queries of a pass times their probes, which are broadcast; numbers of the sample; comparisons at once.
OVERFULL, PROBES, NUMBERS, AT_ONCE = 4, 1 << 22, 1 << 22, 1 << 19


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _rows(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by blocks."""
    step = max(1, AT_ONCE // max(1, len(centres)))
    return np.concatenate([(x[i : i + step] @ centres.T).argmax(1).astype(np.int32) for i in range(0, len(x), step)] or [np.zeros(0, np.int32)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by cosine; begins with rows spread over x. Empty centres stay."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = _home(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where((np.bincount(near, minlength=len(c)) > 0)[:, None], _unit(sums), c)
    return c


class VectorIndex:
    """An index in a folder that all executors share. It may be opened again with VectorIndex(spark, path)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.directory = spark.read.parquet(f"{self.path}/directory")
        model = sorted(spark.read.parquet(f"{self.path}/model").collect(), key=lambda r: (r["kind"], r["no"]))  # LISTS * (1 + OVERFULL) + BITS rows at most
        self.centres, self.planes = (np.array([r["vector"] for r in model if r["kind"] == kind]) for kind in ("centre", "plane"))
        self.probes, self.candidates, self.radius = next(tuple(map(int, r["vector"])) for r in model if r["kind"] == "chosen")

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes.T > 0, axis=1)

    @classmethod
    def build(cls, df: DataFrame, path: str, lists: int | None = None, k: int = 10, recall: float = 0.92, id: str = "id", vector: str = "embedding") -> VectorIndex:
        """Indexes all rows whose vector isn't null; vectors are of one length, ids are expected once each. No rows give an index without lists."""
        spark, path = df.sparkSession, path.rstrip("/")
        df = df.select(F.col(id).alias("id"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
        n = df.count()
        lists = min(LISTS, lists or max(1, round(n**0.5)), n)
        most = min(SAMPLE, NUMBERS // max(1, len(df.first()["vector"]) if n else 1))
        sample = _rows(df.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow().column(0).combine_chunks()) if n else np.zeros((0, 1))
        own = cls.__new__(cls)
        own.spark, own.path, own.centres = spark, path, _kmeans(sample, lists) if n else sample
        own.planes = np.random.default_rng(1).standard_normal((BITS, sample.shape[1]))
        sizes = {r["list"]: r["count"] for r in own._dealt(df).groupBy("list").count().collect()}  # a row for each list
        near, parts = _home(sample, own.centres) if n else None, []
        for j, c in enumerate(own.centres):
            times = sizes.get(j, 0) * len(own.centres) / n
            mine = sample[near == j] if times > OVERFULL else None
            parts.append(_kmeans(mine, int(np.ceil(times))) if mine is not None and len(mine) > 1 else c[None])
        own.centres = np.concatenate(parts) if parts else own.centres
        dealt = own._dealt(df, codes=True)
        mean = max(1, n // max(1, len(own.centres)))
        counts = F.broadcast(dealt.groupBy("list").count())  # a row for each list
        # equal vectors can't be split by centres: what is still overfull is dealt over blocks
        blocked = dealt.join(counts, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / (OVERFULL * mean))).cast("int")).drop("count")
        blocked.repartitionByRange("list", "block", "id").sortWithinPartitions("list", "block", "id").write.parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        stored.select("list", "block", "id", "code").repartitionByRange("list", "block", "id").sortWithinPartitions("list", "block", "id").write.parquet(f"{path}/codes")
        files = [spark.read.parquet(f"{path}/{t}").groupBy("list", F.input_file_name().alias("file")).agg(F.count("*").alias("n")).withColumn("of", F.lit(t)) for t in ("vectors", "codes")]
        files[0].unionByName(files[1]).coalesce(1).write.parquet(f"{path}/directory")  # a row for each list and file
        own.directory = spark.read.parquet(f"{path}/directory")
        own._choose(df, n, k, recall)
        model = [("centre", j, c.tolist()) for j, c in enumerate(own.centres)] + [("plane", j, p.tolist()) for j, p in enumerate(own.planes)] + [("chosen", 0, [float(own.probes), float(own.candidates), float(own.radius)])]
        spark.createDataFrame(model, "kind string, no int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path)

    def _dealt(self, df: DataFrame, codes: bool = False) -> DataFrame:
        """list, id and, on request, vector and code of every row."""
        centres, kind = self.centres, df.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _rows(b.column("vector"))
                    near = pa.array(_home(x, centres))
                    more = [b.column("vector"), pa.array([c.tobytes() for c in self._codes(x)], pa.binary())] if codes else []
                    yield pa.RecordBatch.from_arrays([near, b.column("id"), *more], ["list", "id", "vector", "code"][: 2 + len(more)])

        names = f"list int, id {kind['id'].dataType.simpleString()}" + f", vector {kind['vector'].dataType.simpleString()}, code binary" * codes
        bound = VectorIndex.__new__(VectorIndex)
        bound.planes = self.planes
        self = bound  # what travels to the tasks holds no session
        return df.mapInArrow(run, names)

    def _choose(self, df: DataFrame, n: int, k: int, recall: float) -> None:
        """The fewest probes, and then the least distance of codes and the fewest candidates, that hold sqrt(recall) of the true neighbours of some rows each."""
        self.probes, self.candidates, self.radius = len(self.centres), max(k, 1), BITS
        if not n:
            return
        some = df.orderBy(F.xxhash64("id"), "id").limit(PROBED)
        true = vector_topk_batch(df, some, k, id="id", vector="vector")
        pairs = true.join(df.select("id", "vector"), "id").join(some.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").select("q", "vector").toArrow()
        q, x = (_rows(pairs.column(c).combine_chunks()) for c in ("q", "vector"))
        if not len(q):
            return
        share = recall**0.5
        home = (x @ self.centres.T).argmax(1)
        score = q @ self.centres.T
        rank = (score > score[np.arange(len(q)), home][:, None]).sum(1) + 1
        self.probes = int(np.quantile(rank, share, method="higher"))
        # how many codes of the probed lists are as near as each true neighbour's
        apart = np.bitwise_count(self._codes(q) ^ self._codes(x)).sum(1)
        self.radius = int(np.quantile(apart, share, method="higher"))
        as_near = self._histograms(some)
        of = [r.tobytes() for r in q]
        # a code like the query's own comes first, by id, however many rows share it
        at_most = np.array([as_near[key][: d + 1].sum() if d else k for key, d in zip(of, apart, strict=True)])
        self.candidates = max(k, int(np.quantile(at_most, share, method="higher")))

    def _histograms(self, some: DataFrame) -> dict[bytes, np.ndarray]:
        """For each of a few vectors, how many codes of its nearest lists differ in so many bits."""
        q = _rows(some.select("vector").toArrow().column(0).combine_chunks())
        q = q[sorted({r.tobytes(): i for i, r in enumerate(q)}.values())]
        codes, probed = self._codes(q), self._nearest(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(codes), BITS + 1), np.int64)
            for b in batches:
                own, lists = _bytes(b.column("code")), b.column("list").to_numpy()
                for i in range(len(codes)):
                    total[i] += np.bincount(np.bitwise_count(own[np.isin(lists, probed[i])] ^ codes[i]).sum(1), minlength=BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(codes)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "n"])

        found = self.spark.read.parquet(f"{self.path}/codes").select("list", "code").mapInArrow(run, "i int, n array<long>")
        out = found.select("i", F.posexplode("n").alias("d", "n")).groupBy("i", "d").agg(F.sum("n").alias("n")).collect()  # PROBED * (BITS + 1) numbers
        total = np.zeros((len(codes), BITS + 1), np.int64)
        for r in out:
            total[r["i"], r["d"]] = r["n"]
        return {r.tobytes(): t for r, t in zip(q, total, strict=True)}

    def _nearest(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        step = max(1, AT_ONCE // max(1, len(self.centres)))
        return np.concatenate([np.argsort(-(q[i : i + step] @ self.centres.T), axis=1, kind="stable")[:, : probes or self.probes].astype(np.int32) for i in range(0, max(1, len(q)), step)])

    def _read(self, table: str, lists: np.ndarray) -> DataFrame:
        """The rows of some lists, from the files that hold these."""
        wanted = [int(x) for x in np.unique(lists)]
        files = [r[0] for r in self.directory.filter((F.col("of") == table) & F.col("list").isin(wanted)).select("file").distinct().collect()]
        return self.spark.read.parquet(*files).filter(F.col("list").isin(wanted))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None, radius: int | None = None, id: str = "id", vector: str = "embedding") -> DataFrame:
        """query_id, id, similarity: the k nearest among the candidates of each query's nearest lists, whose codes differ in at most `radius` bits.

        A query's candidates are at least `candidates` of those; each list adds so many at most. Queries go in passes of QUERIES, or fewer by PROBES.
        """
        probes, candidates, radius = probes or self.probes, max(k, candidates or self.candidates), self.radius if radius is None else radius
        queries = queries.select(F.col(id).alias("query_id"), F.col(vector).alias("q")).filter(F.col("q").isNotNull())
        n, out = queries.count(), None
        passes = max(1, -(-n // max(1, min(QUERIES, PROBES // max(1, probes)))))
        self.compared = (n * candidates, n * self.directory.filter("of = 'codes'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        for p in range(passes):
            own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
            part = own.toArrow().combine_chunks()
            if part.num_rows and len(self.centres):
                found = self._pass(own, part, k, probes, candidates, radius)
                out = found if out is None else out.unionByName(found)
        if out is None:
            kind = {f.name: f.dataType.simpleString() for f in queries.schema}
            return self.spark.createDataFrame([], f"query_id {kind['query_id']}, id {kind['query_id']}, similarity double")
        return out

    def _pass(self, own: DataFrame, part: pa.Table, k: int, probes: int, candidates: int, radius: int) -> DataFrame:
        q = _rows(part.column("q").chunk(0))
        lists, ids = self._nearest(q, probes), part.column("query_id").chunk(0)
        order, wanted = np.argsort(lists, axis=None, kind="stable"), np.unique(lists)
        cuts = np.searchsorted(lists.ravel()[order], wanted)[1:]
        of = {int(j): (x // lists.shape[1]).astype(np.int32) for j, x in zip(wanted, np.split(order, cuts), strict=True)}
        shared = self.spark.sparkContext.broadcast((ids.to_pylist(), q, self._codes(q), of))
        kind, rows = ids.type, self._read("vectors", lists).select("list", "id", "code", "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, codes, of = shared.value
            best = Best(len(names), k)
            for b in batches:
                own, at, x = _bytes(b.column("code")), b.column("list").to_numpy(), _rows(b.column("vector"))
                for j in np.unique(at):
                    here, mine = np.flatnonzero(at == j), of.get(int(j), [])
                    step, pairs = max(1, AT_ONCE // len(here)), max(1, AT_ONCE // max(1, q.shape[1]))
                    for i in range(0, len(mine), step):
                        some = mine[i : i + step]
                        d = np.bitwise_count(codes[some][:, None].view(np.uint64) ^ own[here][None].view(np.uint64)).sum(2, dtype=np.int32)
                        least = np.partition(d, candidates - 1, axis=1)[:, candidates - 1 : candidates] if d.shape[1] > candidates else BITS
                        who, which = np.nonzero((d <= least) & (d <= radius))
                        who, which = some[who], here[which]
                        for p in range(0, len(who), pairs):
                            a, c = who[p : p + pairs], which[p : p + pairs]
                            s = np.round((q[a] * x[c]).sum(1), 12)
                            good = s >= best.least[a]
                            best.add(a[good], s[good], b.column("id").take(pa.array(c[good])))
            yield from best.rows(pa.array(names, kind), "similarity")

        kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *own.schema]}
        near = rows.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
        return topk_per(near, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8)


def index_path(shared: str) -> str:
    """A new folder for an index."""
    return f"{shared}/vector-index-{uuid.uuid4().hex}"
