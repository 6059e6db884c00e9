"""Packing: an exact round trip of every document's ids, and the cases of odd input."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import packing, tokens, vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, extra int"


def check(docs, window=2048):
    """Pieces put together again are the tokenizer's ids; sequences are gapless and not too long."""
    rows = packing.packed(docs, window, with_ids=True).collect()
    texts = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect())
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append([*tokens._tokenizer(None).encode(t, add_special_tokens=False).ids, 1])
    got, seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        got.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got.keys() == want.keys()
    for d, parts in got.items():
        if len(want[d]) == 1:
            parts.sort()
            assert [p[0] for p in parts] == np.cumsum([0, *[len(p[1]) for p in parts[:-1]]]).tolist()
            assert sum((p[1] for p in parts), []) == want[d][0]
            assert {p[2] for p in parts} == {len(want[d][0])}
        else:
            assert sorted(sum((p[1] for p in parts), [])) == sorted(sum(want[d], []))
    for parts in seq.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts[:-1]]]).tolist()
        assert sum(p[1] for p in parts) <= window
    return rows, seq


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows, seq = check(docs)
    used = sum(r["length"] for r in rows)
    assert used > 0.98 * 2048 * len(seq)


def test_odd_rows(spark):
    text = "the one  and\nother  one’s   x"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, text * 90, 1), (3, text * 90, 1), (None, "a", 1), (4, "word " * 3000, 2), (5, " \t ", 1), (6, "<|endoftext|>", 0)], SCHEMA)
    check(docs, 64)


def _windows(rows):
    """The (doc_id, start, length) of each sequence."""
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"]))
    return sorted(sorted(v) for v in out.values())


def test_windows_hang_on_the_texts_alone(spark, monkeypatch):
    """Several shards: the same windows however the input is dealt, with more alike documents than chance, and most best neighbours in reach."""
    monkeypatch.setattr(packing, "SHARD", 128)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, two = ([r for r in packing.packed(docs.repartition(n), with_ids=True).collect()] for n in (2, 7))
    assert _windows(one) == _windows(two)
    assert len({r["sequence_id"] >> 32 for r in one}) >= 7

    sets, shard_of, seq = {}, {}, {}
    for r in one:
        if r["length"] < 2048:
            sets[r["doc_id"]] = sets.get(r["doc_id"], set()) | set(np.frombuffer(r["ids"], "<u2").tolist())
            shard_of[r["doc_id"]] = r["sequence_id"] >> 32
            seq.setdefault(r["sequence_id"], set()).add(r["doc_id"])
    count = np.zeros(1 << 16)
    for s in sets.values():
        count[list(s)] += 1
    idf = np.log1p((len(sets) - count + 0.5) / (count + 0.5))
    like = lambda a, b: idf[list(sets[a] & sets[b])].sum() / idf[list(sets[a] | sets[b])].sum()
    rng, ids = np.random.default_rng(1), sorted(sets)
    together = [like(a, b) for s in seq.values() for a, b in zip(sorted(s), sorted(s)[1:], strict=False)]
    chance = [like(*rng.choice(ids, 2, replace=False)) for _ in range(len(together))]
    assert np.mean(together) > 1.5 * np.mean(chance)
    # of pairs of near copies, which are each other's best neighbours, nine of ten share a shard
    near = [(a, b) for k, a in enumerate(ids[:400]) for b in ids[k + 1 :] if len(sets[a] & sets[b]) > 0.8 * len(sets[a] | sets[b]) and len(sets[a]) > 20]
    assert len(near) > 20 and sum(abs(shard_of[a] - shard_of[b]) <= 0 for a, b in near) >= 0.8 * len(near)


def test_copies_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    docs = spark.createDataFrame([(None if k % 2 else 7, "one two three", 1) for k in range(1000)], SCHEMA).repartition(3)
    rows, seq = check(docs)
    size = {}
    for r in rows:
        size[r["sequence_id"] >> 32] = size.get(r["sequence_id"] >> 32, 0) + 1
    assert len(size) >= 15 and max(size.values()) <= 120


def test_wide_vocabularies():
    assert packing._width(50_257) == "<u2" and packing._width(1 << 16) == "<u2" and packing._width((1 << 16) + 1) == "<u4"


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_finds_the_like():
    ids = [np.array(x) for x in ([1, 2, 3, 4], [9, 8, 7], [1, 2, 3, 9], [20, 21])]
    df = np.zeros(1 << 16, np.int64)
    for x in ids:
        df[x] += 1
    s = packing.Index(ids, df, 4, 3.25).scores(0)
    assert np.argsort(-s)[:2].tolist() == [0, 2] and s[3] == 0


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a b", "a  b", "\n a \n", "don't  can't", "x　 y", "\x1c a b", "é è 12 34, ok"])
def test_ids(text):
    data, at = vectors.flat(pa.array([text, "q w", text]))
    ids, begin = tokens.encode(data, at)
    want = tokens._tokenizer(None).encode(text, add_special_tokens=False).ids
    assert ids[begin[0] : begin[1]].tolist() == want and ids[begin[2] : begin[3]].tolist() == want


def _random_texts(seed, n=300):
    """Texts of the cases that the pre-tokenizer tells apart, with white space alone, in runs and at the ends."""
    rng = np.random.default_rng(seed)
    parts = ["word", "the", " ", " ", " ", "  ", "\n", "\t", "\r\n", "'s", "don't", "'", "12", ",", ".", "\n\n ", "é", "ß日", "<|endoftext|>", "\u00a0", "\x1c", "a" * 40]
    weight = np.array([*[6.0] * 19, 0.1, 0.1, 1])
    return ["".join(rng.choice(parts, rng.integers(0, 40), p=weight / weight.sum())) for _ in range(n)]


@pytest.mark.parametrize("memory", [1 << 20, 50])
def test_ids_of_later_batches(monkeypatch, memory):
    monkeypatch.setattr(tokens, "MEMORY", memory)
    known = tokens.Known()
    for seed in (1, 2, 1):
        texts = _random_texts(seed)
        ids, begin = tokens.encode(*vectors.flat(pa.array(texts)), known=known)
        for t, a, b in zip(texts, begin[:-1], begin[1:], strict=True):
            assert ids[a:b].tolist() == tokens._tokenizer(None).encode(t, add_special_tokens=False).ids, t


def test_cuts_are_encoded_once_a_task(monkeypatch):
    import tiktoken

    given = []
    for name in ("encode_to_numpy", "encode_ordinary"):
        f = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, f=f, **kw: given.append(text) or f(self, text, **kw))
    batch, known = vectors.flat(pa.array(["some words: one two", "three and  more of them"])), tokens.Known()
    first = tokens.encode(*batch, known=known)
    assert given
    given.clear()
    again = tokens.encode(*batch, known=known)
    assert not given and all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))


def test_postings_of_used_remainders_are_dropped():
    """The windows are those of scores over all postings, which shrink with the remainders left."""
    rng = np.random.default_rng(3)
    ids = [np.minimum(rng.zipf(1.3, size), 5000) for size in rng.integers(1, 500, 400)]
    df = np.zeros(5001, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    mean, length = np.mean([len(x) for x in ids]), np.array([len(x) for x in ids])
    whole, index = (packing.Index(ids, df, len(ids), mean) for _ in range(2))
    want = list(packing.fill(length, lambda k, used: whole.scores(k), 2048))
    n = len(index.doc)
    assert list(packing.fill(length, index.scores, 2048)) == want and sum(size for w in want for _, _, size in w) == length.sum()
    assert len(index.doc) < n / 4 and len(whole.doc) == n
