"""Line dedup by content-defined chunks of lines.

Texts are wrapped anew, whatever their line breaks: a line begins where the hash of two words that follow one another
chooses (two in five), and where that leaves more than LINE words together, at least hashes of GRAM words, so that equal
passages are wrapped alike wherever they stand and however they were wrapped. Only words that repeat with a short period have
neither; they are cut each LINE words. A rolling polynomial hash over the hashes of the last WIDTH lines chooses chunk boundaries: a chunk ends
where its value exceeds those of the lines beside it, so that boundaries move with the text; chunks have two lines at
least and LINES at most. Of equal chunks the first (doc_id, text, position) stays: a task matches its own chunks first, and
the first of each is dealt by hash to meet those of other tasks, so that a common chunk is one posting a task. Matches that
follow one another in both documents become one run. The words of the first occurrence, with AROUND words on both sides, are
brought to the later document's text, compared, and equal words around the run join it. Where runs that touch have MIN_WORDS
words together, they are cut out of the later document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, table
from .vectors import NOT_SPACE, binary_rows, flat, hash_spans, mix, slices, words

#: Words of a run that is cut out at least; words of runs that touch at least, without those around; bytes of a bucket; chunks that a task holds.
MIN_WORDS, ANCHOR, BUCKET, HELD = 40, 8, 8 << 20, 1 << 21
#: Most words of a line, lines of a rolling hash, most lines of a chunk.
LINE, WIDTH, LINES = 16, 3, 8
#: Words whose hash breaks lines without a chosen pair; words beside that it is compared with.
GRAM, BESIDE = 6, 4
#: Words around a run that are compared: as many as a chunk holds at most, so that the next boundary is among them. What is fetched begins and ends at multiples of SNAP words, so that many matches share it.
AROUND, SNAP = 128, 256
_POSTING = np.dtype([("chunk", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("pos", "<u4"), ("n", "<u2")])
_MATCH = np.dtype([("doc", "<i8"), ("th", "<i8"), ("kdoc", "<i8"), ("kth", "<i8"), ("pos", "<u4"), ("kpos", "<u4"), ("n", "<u2")])
_RANGE = np.dtype([("pos", "<u4"), ("kpos", "<u4"), ("n", "<u4")])
_NULL = np.iinfo(np.int64).max
_K = np.uint64(0x9E3779B97F4A7C15)


def _least(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of long lines, the words at which the hash of GRAM words is less than at the BESIDE words before and not more than at those behind: breaks that hang on the words alone."""
    gram = h.copy()
    for k in range(1, GRAM):
        gram[k:] += mix(h[:-k] + np.uint64(k))
    gram = mix(gram)
    at = np.repeat(begin + 1 - (np.cumsum(size - 1) - (size - 1)), size - 1) + np.arange((size - 1).sum())
    here, low = gram[at], np.ones(len(at), bool)
    for k in range(1, BESIDE + 1):
        low &= (here < gram[np.maximum(at - k, 0)]) & (here <= gram[np.minimum(at + k, len(h) - 1)])
    return at[low]


class Lines:
    """Lines of a slice of texts: the first word of each line, and the end; each line's hash; first: where each text's lines begin, and the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        start, end, whose = words(data, at, NOT_SPACE)
        n = len(start)
        #: Where each text's words begin, and the end.
        self.whose = whose
        if not n:
            self.word, self.hash, self.first = np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
            return
        h = hash_spans(data, start, end, 5)
        cut = np.ones(n, bool)
        pair = mix(h[:-1] * _K + h[1:])
        cut[1:] = pair < np.uint64(2 * (2**64 // 5))
        cut[whose[:-1][whose[1:] > whose[:-1]]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, n))
        if (size > LINE).any():
            begin = np.sort(np.concatenate([begin, _least(h, begin[size > LINE], size[size > LINE])]))
            size = np.diff(np.append(begin, n))
        if (size > LINE).any():  # words that repeat with a short period: any cut is like any other
            more = (size - 1) // LINE
            k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            begin = np.sort(np.concatenate([begin, np.repeat(begin, more) + (k + 1) * LINE]))
            size = np.diff(np.append(begin, n))
        self.word = np.append(begin, n)
        place = (np.arange(n) - np.repeat(begin, size)).astype(np.uint64)
        self.hash = mix(np.add.reduceat(mix(h + place * np.uint64(0xD6E8FEB86659FD93)), begin))
        self.first = np.searchsorted(begin, whose)


def chunks(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, number of lines, hash) of the chunks of all texts; a chunk never spans two texts. Chunks of one line (texts of one line, and what is left of a long chunk) are left out."""
    h, n = lines.hash, len(lines.hash)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = h.copy()
    for k in range(1, WIDTH):
        rolling[k:] = rolling[k:] + h[:-k] * np.uint64(int(_K) ** k & 2**64 - 1)
    rolling = mix(rolling)
    edge = np.zeros(n + 1, bool)
    edge[lines.first] = True
    peak = np.zeros(n + 1, bool)
    peak[2:n] = (rolling[1:-1] > rolling[:-2]) & (rolling[1:-1] > rolling[2:])
    # hashes of the first lines of a text would reach into the one before, and a first or last line alone is no chunk
    for k in range(1, WIDTH + 1):
        peak[np.minimum(lines.first + k, n)] = False
    peak[np.maximum(lines.first - 1, 0)] = False
    cut = np.flatnonzero(peak | edge)
    size = np.diff(cut)
    if (size > LINES).any():
        more = (size - 1) // LINES
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        cut = np.sort(np.concatenate([cut, np.repeat(cut[:-1], more) + (k + 1) * LINES]))
    a, b = cut[:-1], cut[1:]
    a, b = a[b - a >= 2], b[b - a >= 2]
    total = np.append(np.uint64(0), np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64))
    order = np.append(np.uint64(0), np.cumsum(h * (np.arange(n, dtype=np.uint64) + np.uint64(1)), dtype=np.uint64))
    plain = np.append(np.uint64(0), np.cumsum(h, dtype=np.uint64))
    # a hash of the lines in their order: sum h_i (i - a + 1), and the plain sum of other hashes
    with np.errstate(over="ignore"):
        inner = order[b] - order[a] - plain[b] * a.astype(np.uint64) + plain[a] * a.astype(np.uint64)
        value = mix(mix(inner + (b - a).astype(np.uint64)) ^ (total[b] - total[a]))
    return a, b - a, value


def _first_of(p: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For postings sorted by `order`: those that come first of their chunk, and for each other one the first that it matches, as (first, later)."""
    chunk, n = p["chunk"][order], p["n"][order]
    new = np.ones(len(order), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (n[1:] != n[:-1])
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff(np.append(head, len(order))))
    later = np.flatnonzero(~new)
    return order[head], np.stack([order[first[later]], order[later]])


def _matches(p: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    k, x = p[pairs[0]], p[pairs[1]]
    out = np.empty(len(x), _MATCH)
    for c in ("doc", "th", "pos", "n"):
        out[c] = x[c]
    for c in ("doc", "th", "pos"):
        out["k" + c] = k[c]
    # rows with one doc_id and text are one document
    return out[(out["doc"] != out["kdoc"]) | (out["th"] != out["kth"]) | (out["pos"] != out["kpos"])]


def _deal(rows: np.ndarray, key: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """rows by key & (parts - 1): the parts that have some, and their bytes."""
    part = (key & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, cut = rows[order], np.searchsorted(part[order], np.arange(parts + 1))
    full = [b for b in range(parts) if cut[b] < cut[b + 1]]
    return full, [rows[cut[b] : cut[b + 1]].tobytes() for b in full]


def _documents(m: np.ndarray) -> np.ndarray:
    return mix(m["doc"].view(np.uint64) ^ mix(m["th"].view(np.uint64)))


def postings(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob, found) of docs (doc_id, text, th): for each bucket the postings of what a task holds, the first of a chunk each; and the matches among these, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            p = np.concatenate(held)
            order = np.lexsort([p["pos"], p["th"], p["doc"], p["n"], p["chunk"]])
            first, pairs = _first_of(p, order)
            found = _matches(p, pairs)
            own = p[first]
            full, blobs = _deal(own, own["chunk"], buckets)
            parts, matched = _deal(found, _documents(found), buckets)
            kinds = [pa.array(full + parts, pa.int32()), binary_rows(blobs + [None] * len(parts)), binary_rows([None] * len(full) + matched)]
            return pa.RecordBatch.from_arrays(kinds, ["bucket", "blob", "found"])

        for batch in batches:
            ids, hashes = batch.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy(False), batch.column("th").to_numpy(False)
            data, at = flat(batch.column("text"))
            for i, j in slices(at):
                lines = Lines(data[at[i] : at[j]], at[i : j + 1] - at[i])
                first, n, value = chunks(lines)
                doc = np.searchsorted(lines.first, first, "right") - 1
                p = np.empty(len(first), _POSTING)
                p["chunk"], p["doc"], p["th"], p["pos"], p["n"] = value, ids[i:j][doc], hashes[i:j][doc], lines.word[first] - lines.whose[doc], lines.word[first + n] - lines.word[first]
                held.append(p)
                size += len(p)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "bucket int, blob binary, found binary")


def matches(posted: DataFrame, buckets: int) -> DataFrame:
    """(part, blob): matches of all chunks with their firsts, dealt by document."""

    def bucket(t: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(b.as_buffer(), _POSTING) for b in t.column("blob") if b.is_valid] or [np.zeros(0, _POSTING)])
        found = [np.frombuffer(b.as_buffer(), _MATCH) for b in t.column("found") if b.is_valid]
        if len(p):
            found.append(_matches(p, _first_of(p, np.lexsort([p["pos"], p["th"], p["doc"], p["n"], p["chunk"]]))[1]))
        m = np.concatenate(found)
        parts, blobs = _deal(m, _documents(m), buckets)
        return pa.table({"part": pa.array(parts, pa.int32()), "blob": binary_rows(blobs)})

    return posted.groupBy("bucket").applyInArrow(bucket, "part int, blob binary")


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches that follow one another in both documents, as one each: n words from pos are those from kpos. The second value numbers runs of one document that touch."""
    shift = m["pos"].astype(np.int64) - m["kpos"]
    order = np.lexsort([m["pos"], shift, m["kth"], m["kdoc"], m["th"], m["doc"]])
    m, shift = m[order], shift[order]
    same = np.ones(len(m) - 1, bool)
    for c in ("doc", "th", "kdoc", "kth"):
        same &= m[c][1:] == m[c][:-1]
    same &= (shift[1:] == shift[:-1]) & (m["pos"][1:] <= m["pos"][:-1] + m["n"][:-1])
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(m)) - 1
    out = np.zeros(len(first), np.dtype([*_MATCH.descr[:-1], ("n", "<u4")]))
    for c in ("doc", "th", "kdoc", "kth", "pos", "kpos"):
        out[c] = m[c][first]
    out["n"] = m["pos"][last] + m["n"][last] - out["pos"]
    out = out[np.lexsort([out["pos"], out["th"], out["doc"]])]
    # islands: the farthest end so far, within a document
    new = np.append(True, (out["doc"][1:] != out["doc"][:-1]) | (out["th"][1:] != out["th"][:-1]))
    end = out["pos"].astype(np.int64) + out["n"]
    lift = np.cumsum(new) << 33
    reach = np.maximum.accumulate(end + lift) - lift
    apart = new.copy()
    apart[1:] |= out["pos"][1:] > reach[:-1]
    return out, np.cumsum(apart) - 1


def pairs_of(matched: DataFrame) -> DataFrame:
    """All runs of two documents as one row: `ranges` (pos, kpos, n) and the words to fetch of the first, [klo, khi). Runs that touch and have fewer than ANCHOR words together are common words, no passage."""

    def part(t: pa.Table) -> pa.Table:
        m = np.concatenate([np.frombuffer(b.as_buffer(), _MATCH) for b in t.column("blob")])
        out, island = runs(m)
        out = out[np.bincount(island, out["n"])[island] >= ANCHOR]
        out = out[np.lexsort([out["pos"], out["kth"], out["kdoc"], out["th"], out["doc"]])]
        new = np.zeros(len(out), bool)
        new[:1] = True
        for c in ("doc", "th", "kdoc", "kth"):
            new[1:] |= out[c][1:] != out[c][:-1]
        first = np.flatnonzero(new)
        k = out["kpos"].astype(np.int64)
        lo = np.maximum(0, np.minimum.reduceat(k, first) - AROUND) // SNAP * SNAP if len(first) else k
        hi = -(-(np.maximum.reduceat(k + out["n"], first) + AROUND) // SNAP) * SNAP if len(first) else k
        packed = np.empty(len(out), _RANGE)
        for c in ("pos", "kpos", "n"):
            packed[c] = out[c]
        ranges = [packed[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(out))[: len(first)], strict=True)]
        return pa.table({**{c: out[c][first] for c in ("doc", "th", "kdoc", "kth")}, "klo": lo, "khi": hi, "ranges": binary_rows(ranges)})

    return matched.groupBy("part").applyInArrow(part, "doc long, th long, kdoc long, kth long, klo long, khi long, ranges binary")


def _packed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, and _z (the text compressed, null for null), _doc and _th: docs are (keep, _text, _id, _th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [packer.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("_text")]
            cols = [batch.column(c) for c in keep] + [binary_rows(z), batch.column("_id").cast(pa.int64()).fill_null(_NULL), batch.column("_th")]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "_z", "_doc", "_th"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(run, ", ".join([*fields, "_z binary", "_doc long not null", "_th long not null"]))


def pieces(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted range of words (kdoc, kth, klo, khi) those words, joined by spaces and compressed, once. Ranges end with the text.

    All columns of packed are taken along: so the shuffle is the one that brings the texts their passages, and is made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, unpacker, before = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), None
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                out = []
                for r in batch.to_pylist():
                    if (r["_doc"], r["_th"]) == before or r["_z"] is None:
                        continue
                    before = (r["_doc"], r["_th"])
                    text = unpacker.decompress(r["_z"]).split()
                    out += [(*before, x["klo"], x["khi"], packer.compress(b" ".join(text[x["klo"] : x["khi"]]))) for x in r["wanted"]]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["kdoc", "kth", "klo", "khi", "kz"])

    lists = wanted.groupBy("kdoc", "kth").agg(F.collect_set(F.struct("klo", "khi")).alias("wanted"))
    joined = packed.join(lists, [F.col("_doc") == F.col("kdoc"), F.col("_th") == F.col("kth")])
    return joined.mapInArrow(run, "kdoc long, kth long, klo long, khi long, kz binary").dropDuplicates(["kdoc", "kth", "klo", "khi"])


def firsts(docs: DataFrame, packed: DataFrame, store: Store) -> DataFrame:
    """(doc, th, found): for each document with repeated passages the runs and the words of their first occurrences. docs: doc_id, text, th; packed: as _packed() gives them."""
    # bytes of the texts; a posting for seven words
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = min(1 << max(6, (size // BUCKET).bit_length()), 1 << 16)
    pair = store.write(pairs_of(matches(postings(docs, buckets), buckets)), "pairs")
    keys = ["kdoc", "kth", "klo", "khi"]
    piece = pieces(packed, pair.select(keys).distinct())
    both = pair.join(piece, keys).withColumn("own", (F.col("doc") == F.col("kdoc")) & (F.col("th") == F.col("kth")))
    return both.groupBy("doc", "th").agg(F.collect_list(F.struct("ranges", "klo", "kz", "own")).alias("found"))


def _period(text: list[bytes], p: int, n: int) -> int:
    """The shortest period of n words from p, if they hold it twice at least and it is no longer than a line; else 0."""
    for d in range(1, min(LINE, n // 2) + 1):
        if text[p] == text[p + d] and text[p : p + n - d] == text[p + d : p + n]:
            return d
    return 0


def repeated(text: list[bytes], found: list[dict], unzip: zstandard.ZstdDecompressor) -> np.ndarray:
    """Which words stand in an earlier place too: runs whose words are equal, with the equal words around them. Within one text a span ends where its first occurrence begins or ends.

    A run of equal lines goes on as far as its period does: how many lines the first occurrence has is no difference.
    """
    mark = np.zeros(len(text) + 1, np.int64)
    for f in found:
        first = unzip.decompress(f["kz"]).split()
        for p, kp, n in np.frombuffer(f["ranges"], _RANGE).tolist():
            q = kp - f["klo"]
            if p + n > len(text) or text[p : p + n] != first[q : q + n] or q + n > len(first):
                continue
            lo, hi = 0, n
            room = p - kp if f["own"] else len(text) + len(first)
            while lo < min(p, q) and lo + hi < room and text[p - lo - 1] == first[q - lo - 1]:
                lo += 1
            while p + hi < len(text) and q + hi < len(first) and lo + hi < room and text[p + hi] == first[q + hi]:
                hi += 1
            if not f["own"] and (d := _period(text, p, n)):
                while p - lo > 0 and text[p - lo - 1] == text[p - lo - 1 + d]:
                    lo += 1
                while p + hi < len(text) and text[p + hi] == text[p + hi - d]:
                    hi += 1
            mark[p - lo] += 1
            mark[p + hi] -= 1
    return np.cumsum(mark)[:-1] > 0


def _cut(raw: bytes, inside: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Bytes [a, b) of the spans with min_words words, up to the next word."""
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    a, b = a[b - a >= min_words], b[b - a >= min_words]
    if not len(a):
        return []
    data = np.frombuffer(raw, np.uint8)
    start = np.append(words(data, np.array([0, len(data)]), NOT_SPACE)[0], len(raw))
    return list(zip(start[a].tolist(), start[b].tolist(), strict=True))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` cut, and removed_lines (of the passages that went, as wrapped on their own), removed_bytes.

    Of a passage that repeats, the occurrence with the smallest doc_id, then of the smallest hash of the text, then the first
    in the text, stays; a null doc_id comes last. Null and blank texts have no lines and stay as they are. Rows with one doc_id
    and text are one document and are cut alike. What stays of a text is joined as it stands. An empty table gives an empty
    result. Other columns are kept, whatever their names; one with the name of an added column is replaced.
    """
    docs = docs.drop("removed_lines", "removed_bytes")
    store = Store(docs.sparkSession, "line_dedup")
    # other columns go by number, so that none can clash
    names = docs.columns
    rest = [c for c in names if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.col("text").cast("binary").alias("_text"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    keep = [f"c{k}" for k in range(len(rest))]
    packed = _packed(rows, keep)
    found = firsts(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), packed, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                text, counts, gone, at = [], [], [], []
                for z, seen in zip(batch.column("_z").to_pylist(), batch.column("found").to_pylist(), strict=True):
                    raw = unzip.decompress(z) if z is not None else None
                    spans = _cut(raw, repeated(raw.split(), seen, unzip), min_words) if seen and raw is not None else []
                    if spans:
                        edges = [0, *[x for s in spans for x in s], len(raw)]
                        text.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
                        gone += [raw[a:b] for a, b in spans]
                    else:
                        text.append(None if raw is None else raw.decode())
                    at.append(len(gone))
                    counts.append(sum(b - a for a, b in spans))
                own = Lines(np.frombuffer(b"".join(gone), np.uint8), np.append(0, np.cumsum([len(g) for g in gone])).astype(np.int64)).first
                lines = np.diff(np.append(0, own[at])) if gone else np.zeros(batch.num_rows, np.int64)
                cols = [batch.column(c) for c in keep] + [pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "_text", "_lines", "_bytes"])

    joined = packed.join(found, [F.col("_doc") == F.col("doc"), F.col("_th") == F.col("th")], "left").drop("doc", "th", "_doc", "_th")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    out = joined.mapInArrow(run, ", ".join([*fields, "_text string, _lines long, _bytes long"]))
    return out.select(*[F.col("_text" if c == "text" else f"c{rest.index(c)}").alias(c) for c in names], F.col("_lines").alias("removed_lines"), F.col("_bytes").alias("removed_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one of which nothing is left but white space goes, n_chars, where docs have it, is counted anew. Nulls, ties, repeated rows and empty tables: see line_dedup."""
    cut = line_dedup(docs)
    left = cut.where("removed_lines = 0 or text rlike '[^ \\\\t-\\\\r]'")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)
