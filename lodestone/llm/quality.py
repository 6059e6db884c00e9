"""Quality classifier: Bradley-Terry ranking on preference pairs.

A document's features are counts and shares taken from its whole text. Each good labelled row is paired with each bad one;
the weights w maximise P(good over bad) = sigmoid(w (x_good - x_bad)) over all pairs, that is logistic loss on feature
differences. The threshold is the quantile of the labelled rows' scores at their share of bad rows; a score is
sigmoid((w x - threshold) / scale), so that 0.5 is the threshold.

Pairs are not made: what a pair adds to the loss is a smooth function of its two scores, and a sum of such a function over
many scores is that over a grid of them, to which each row gives interpolation weights. Tasks sum the rows of each grid
point, and the driver holds the grid alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, table
from .vectors import NOT_SPACE, hash_spans, roll, texts, words

#: Distance of grid points, and the points near a score that share its weight (error of a pair's term below 1e-10). Rows that are weighed at once; bins of a quantile.
STEP, POINTS = 1 / 8, 10
ROWS, BINS = 1024, 1024
#: The first of the keys of products of features, under those of all grid points.
LOWEST = -(1 << 40)
SHAPES = 25
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.full(256, 4, np.uint8)  # upper, lower, digit, symbol, beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[_SYMBOLS] = 3
NAMES = ["log words", "mean word", "upper", "digits", "symbols", "stops", "bangs", "bars", "lines", "beyond ASCII", "most symbol", "distinct words", "distinct pairs", "repeats", "common word", "long words", "symbols at ends", "upper words", *[f"shape {i}" for i in range(SHAPES)]]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(at) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    bytes_ = np.diff(at)
    doc = np.repeat(np.arange(n) * 256, bytes_)
    h = np.bincount(doc + data, minlength=n * 256).reshape(n, 256).astype(float)
    inside = np.maximum(1, h[:, NOT_SPACE].sum(axis=1))
    starts, ends, first = words(data, at, NOT_SPACE)
    count = np.diff(first)
    some = np.maximum(1, count)
    whose = np.repeat(np.arange(n), count)
    share = lambda flag: np.bincount(whose, flag, minlength=n) / some
    length = ends - starts
    last, head = _CLASS[data[ends - 1]], _CLASS[data[starts]]
    upper = np.append(0, np.cumsum(_CLASS[data] == 0))
    symbol = h[:, _SYMBOLS]
    cols = [np.log1p(count), share(length), h[:, 65:91].sum(1) / inside, h[:, 48:58].sum(1) / inside, symbol.sum(1) / inside]
    cols += [h[:, [46, 44]].sum(1) / some, h[:, [33, 63]].sum(1) / some, h[:, 124] / some, h[:, 10] / some, h[:, 128:].sum(1) / inside, symbol[:, [i for i, c in enumerate(_SYMBOLS) if c not in (44, 46)]].max(1) / some]
    w = hash_spans(data, starts, ends)
    pair = roll(w, 2)
    distinct, pairs, common = np.ones(n), np.ones(n), np.zeros(n)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            _, c = np.unique(w[a:b], return_counts=True)
            distinct[i], common[i] = len(c) / (b - a), c.max() / (b - a)
            pairs[i] = len(np.unique(pair[a : b - 1])) / max(1, b - a - 1) if b - a > 1 else 1
    again = np.zeros(len(w), bool)
    if len(w):
        again[1:] = (w[1:] == w[:-1]) & (whose[1:] == whose[:-1])
    cols += [distinct, pairs, share(again), common, share(length > 12), share(last == 3), share(upper[ends] - upper[starts] >= np.maximum(2, length * 0.6))]
    shape = (head * 5 + last).astype(np.int64)
    cols += list((np.bincount(whose * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / some[:, None]).T)
    return np.stack(cols, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.scaled(x), self.weights)  # equal rows have equal sums, whatever stands beside them

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -40, 40)))


def grid(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the POINTS grid points around each score, and its share of each: the sum of share times f(point) is f(score)."""
    at = s / STEP
    first = np.floor(at).astype(np.int64) - POINTS // 2 + 1
    away, share = (at - first)[:, None] - np.arange(POINTS), np.ones((len(s), POINTS))
    for i in range(POINTS):
        for j in range(POINTS):
            if i != j:
                share[:, i] *= away[:, j] / (i - j)
    return first[:, None] + np.arange(POINTS), share


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """part(x, quality) gives distinct keys and `width` numbers for each; all keys in order, and the sums over all rows (quality, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                k, v = part(matrix(some), some.column("quality").to_numpy())
                both = np.concatenate([keys, k])
                keys, at = np.unique(both, return_inverse=True)
                old, sums = sums, np.zeros((len(keys), width))
                sums[at[: len(old)]] = old
                sums[at[len(old) :]] += v
        yield pa.RecordBatch.from_arrays([pa.array((keys[:, None] * width + np.arange(width)).ravel()), pa.array(sums.ravel())], ["key", "v"])

    found = rows.mapInArrow(run, "key long, v double").groupBy("key").agg(F.sum("v").alias("v")).toArrow().sort_by("key")
    return found.column("key").to_numpy()[::width] // width, found.column("v").to_numpy().reshape(-1, width)


def by_point(s: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (twice the grid point's number and the label), and the sums of the rows of `of` by each point's share of them."""
    points, share = grid(s)
    keys, at = np.unique(2 * points + y[:, None], return_inverse=True)
    w = np.zeros((len(keys), len(s)))
    w[at.reshape(points.shape), np.arange(len(s))[:, None]] = share
    return keys, w @ of


def split(keys: np.ndarray, sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores of the grid points and the sums there, of bad rows and of good ones."""
    return [(keys[keys % 2 == y] // 2 * STEP, sums[keys % 2 == y]) for y in (0, 1)]


def kth(values: DataFrame, k: int) -> float:
    """The k-th smallest v, from 0: the range that holds it is cut into bins until it has one value."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        bins = values.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / (high - low) * BINS).alias("bin"))
        for _, n, low, high in bins.agg(F.count("*"), F.min("v"), F.max("v")).orderBy("bin").collect():  # noqa: B007
            if k < n:
                break
            k -= n
    return low


def fit(rows: DataFrame, l2: float = 1e-3, steps: int = 30) -> Model:
    """Bradley-Terry weights of all pairs of a good and a bad row (quality, x), by Newton's method. Where one label is missing, all scores are 0.5."""
    width = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(width)]
    n, good, *moments = rows.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0)), *[f(c) for f in (F.avg, F.stddev_pop) for c in x]).first()
    mean, scale = (np.array(moments[:width]), np.maximum(moments[width:], 1e-9)) if n else (np.zeros(width), np.ones(width))
    model = Model(mean, scale, np.zeros(width), 0.0, 1.0)
    if not 0 < good < n:
        return model
    pairs, move, least = good * (n - good), np.zeros(width), np.inf
    for _ in range(steps):
        new = Model(mean, scale, model.weights + move, 0.0, 1.0)
        (b, mass_b), (g, mass_g) = split(*summed(rows, lambda x, y, m=new: by_point(m.raw(x), y, np.ones((len(x), 1))), 1))
        worse = np.subtract.outer(b, g)  # by how much a bad point is over a good one
        loss = float((mass_b.T @ np.logaddexp(0, worse) @ mass_g).item() / pairs + l2 / 2 * new.weights @ new.weights)
        if loss > least + 1e-9:
            move = move / 2
            continue
        model, least = new, loss
        p = 1 / (1 + np.exp(-np.clip(worse, -500, 500)))
        curve = p * (1 - p)
        curves = [(b, curve @ mass_g[:, 0]), (g, mass_b[:, 0] @ curve)]

        def part(x: np.ndarray, y: np.ndarray, model=model, curves=curves) -> tuple[np.ndarray, np.ndarray]:
            """The rows of each point, and, with keys under all points, their products by the curve of all their pairs."""
            z, s, own = model.scaled(x), model.raw(x), np.zeros(len(x))
            points, share = grid(s)
            for label, (at, value) in enumerate(curves):
                some = y == label
                own[some] = (share[some] * value[np.searchsorted(at, points[some] * STEP)]).sum(1)
            keys, sums = by_point(s, y, z)
            return np.concatenate([np.arange(width) + LOWEST, keys]), np.concatenate([(z * own[:, None]).T @ z, sums])

        keys, sums = summed(rows, part, width)
        (_, of_b), (_, of_g) = split(keys[width:], sums[width:])
        cross = of_b.T @ curve @ of_g
        gradient = ((mass_b[:, 0] @ p) @ of_g - (p @ mass_g[:, 0]) @ of_b) / pairs - l2 * model.weights
        move = np.linalg.solve((sums[:width] - cross - cross.T) / pairs + l2 * np.eye(width), gradient)
        if np.abs(move).max() < 1e-8:
            model.weights = model.weights + move
            break
    values = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(b)))], ["v"]) for b in batches if b.num_rows), "v double")
    last = kth(values, n - good - 1)
    spread, below, above = values.agg(F.stddev_pop("v"), F.sum((F.col("v") <= last).cast("long")), F.min(F.when(F.col("v") > last, F.col("v")))).first()
    return Model(mean, scale, model.weights, (last + (last if below > n - good else above)) / 2, max(spread, 1e-9) / 4)


def document_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, data, at in texts(batch):
                x = features(data, at)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))


def train(store: Store, rows: DataFrame, labels: DataFrame) -> Model:
    """Fits on all labelled rows that are not held out. rows: document_features(); labels: doc_id, quality."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder() != 1).select("doc_id", "quality")
    return fit(store.write(known.join(rows, "doc_id").select("quality", "x"), "labelled"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1, and score no text by themselves. Null counts as
    empty, which has features of its own (all zero) and a score. A null doc_id is not held out and has no label. Null
    labels are left out; repeated rows count as often as they occur; without labels every score is 0.5. An empty table
    gives an empty result; other columns are ignored.
    """
    store = Store(docs.sparkSession, "quality")
    rows = store.write(document_features(docs), "features")
    model = train(store, rows.where(remainder() != 1), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(matrix(batch)))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Each row is judged by its own text, whatever other rows have its doc_id.

    Null counts as empty and is judged like any text; equal texts have equal scores, so that repeated rows stay or go
    together; a score of 0.5 stays. An empty table gives an empty result; all columns are kept.
    """
    model = train(Store(spark, "quality"), document_features(docs.where(remainder() != 1)), table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in texts(batch):
                yield batch.slice(i, j - i).filter(pa.array(model.scores(features(data, at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
