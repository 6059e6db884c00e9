"""Merkle manifest, vector codes and SentencePiece ids: SQL on given tables, odd rows against plain Python and the library."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, piece_bpe, vector_codes

SF = "/root/testdata/sf0.01"


def in_sql(module, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    return con.execute(module.SQL).fetchall()


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, arity=8):
    """The root, and for each node the siblings before and after on its way."""
    ways, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + arity, len(nodes))) for k in range(0, len(nodes), arity)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    ways[leaf].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, below = [digest(*(nodes[k] for k in run)) for run in runs], [[x for k in run for x in below[k]] for run in runs]
    return nodes[0], ways


def manifest_of(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        leaf = leaf_of((doc_id, source, lang, n_chars, text))
        third = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf, leaf_of((doc_id, source, lang, n_chars, low)) if third else leaf, doc_id))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[1] for r in sorted(groups[g], key=lambda r: r[:2])]) for g in langs}
    if not langs:
        return Counter()
    root, tops = tree([trees[g][0] for g in langs])
    out = Counter()
    for g, top in zip(langs, tops, strict=True):
        for (_, leaf, changed, doc_id), way in zip(sorted(groups[g], key=lambda r: r[:2]), trees[g][1], strict=True):
            h = changed
            for before, after in way + top:
                h = digest(before, h, after)
            out[doc_id, leaf, trees[g][0], root, digest(*(b + a for b, a in way + top)), h, h == root] += 1
    return out


def manifest_rows(spark, tmp_path, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        docs = docs.withColumns({c: F.lit(7) for c in ("group", "id", "pos", "run", "slots", "word", "bit", "n", "digest", "root")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(map(tuple, merkle.query(spark, str(tmp_path)).collect()))


def test_manifest_like_sql(spark):
    got = merkle.query(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(in_sql(merkle, "documents"))
    assert 0.5 < got.where("verified").count() / got.count() < 0.8


def test_manifest_odd_rows(spark, tmp_path, monkeypatch):
    """Null and repeated ids and rows, ids far apart and negative, one lone language, runs of 1, 8, 9 and 65, texts beyond ASCII."""
    monkeypatch.setattr(merkle, "COPIES", 4)
    rnd = random.Random(3)
    rows = [(i, "s", lang, i, f"Text {i}") for lang, n in (("a", 1), ("b", 8), ("c", 9), ("d", 65), ("é", 70), ("", 2), (None, 20)) for i in range(n)]
    rows += [(rnd.choice([-1, 1]) * rnd.randrange(2**62), None, "far", None, "X" * 50) for _ in range(200)] + [(2**63 - 1, "s", "far", 1, "ÄB"), (-(2**63), "s", "far", 1, "z")]
    rows += [(None, "s", "d", k, "no id") for k in range(5)] + [(5, "s", "d", 5, "Other Text")] * 11 + [(5, "s", "d", 5, None)] * 3 + [(None, None, None, None, None)] * 9
    rnd.shuffle(rows)
    assert manifest_rows(spark, tmp_path, rows) == manifest_of(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", None, 1, "Only")], [(None, None, "x", None, "")] * 2], ids=["empty", "one", "equal"])
def test_manifest_few_rows(spark, tmp_path, rows):
    assert manifest_rows(spark, tmp_path, rows) == manifest_of(rows)


def test_directory_has_levels(spark, monkeypatch):
    """With 16 words below an entry."""
    monkeypatch.setattr(merkle, "FAN", 4)
    rnd = random.Random(4)
    ids = [("g" + str(k % 2), x) for k, x in enumerate([rnd.randrange(-3000, 3000) for _ in range(300)] + [rnd.randrange(-(2**24), 2**24) for _ in range(20)])]
    store = merkle.Store(spark, "test")
    got = merkle.places(store, spark.createDataFrame([(g, x, str(k)) for k, (g, x) in enumerate(ids)], "group string, id long, digest string"), ["digest"]).collect()
    for g in ("g0", "g1"):
        own = sorted((r["pos"], r["id"], r["digest"]) for r in got if r["group"] == g)
        assert [r[0] for r in own] == list(range(len(own))) and [r[1:] for r in own] == sorted(r[1:] for r in own)


# Vector codes


def coded_of(rows, parts=16, entries=64):
    """Codes by comparing everything with everything."""
    kept = [(i, [math.floor(256 * x) for x in v], lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, *_ in kept), default=0) // parts) * parts
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][3]))[:entries]
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab, _ in kept]
    first = [kept[k] for k in first]
    d = width // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        found = [[nearest(v, p)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in set(found[p]):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found[p], strict=True) if f == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, label = [], Counter()
    for i, v, lab in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), lab))
        label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, label[lab], sha) for i, c, e, lab in out)


def test_codes_like_sql(spark):
    assert Counter(map(tuple, vector_codes.query(spark, SF).collect())) == Counter(in_sql(vector_codes, "embeddings"))


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_codes_odd_rows(spark, tmp_path, n):
    """Nulls, NaN, infinities, short and empty vectors, repeated ids and vectors, no id, no label, clusters and ties, 20 components."""
    rnd = random.Random(n)
    centres = [[rnd.uniform(-1, 1) for _ in range(20)] for _ in range(5)]
    rows = [(k // 2, [float(np.float32(x + rnd.choice([0, 0, 0.01, 0.3]))) for x in rnd.choice(centres)], rnd.choice([None, 1, 2])) for k in range(n)]
    if n > 1:
        rows += [(None, rows[0][1], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan")] * 20, None), (6, [float("inf")] * 20, 2), (7, [0.5, -0.001], 2), (8, [], None), rows[1], rows[1]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("vector", "codes", "error", "part", "entry")})
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(map(tuple, vector_codes.query(spark, str(tmp_path)).collect())) == coded_of(rows)


def test_cover_tree():
    """Every point is in one leaf, children cover their points within half the radius and their centres are that far apart; codes and sums equal those of all distances, with far fewer comparisons where points cluster."""
    rng = np.random.default_rng(2)
    points = (rng.integers(-300, 300, (12, 4))[rng.integers(0, 12, 3000)] + rng.integers(-3, 4, (3000, 4))).astype(np.int64)
    order, nodes = vector_codes.cover_tree(points)
    assert sorted(order) == list(range(3000))
    for n in nodes[nodes["children"] > 0]:
        kids = nodes[n["child"] : n["child"] + n["children"]]
        assert kids["start"][0] == n["start"] and kids["end"][-1] == n["end"] and (kids["start"][1:] == kids["end"][:-1]).all() and (kids["radius"] <= n["radius"] / 2).all()
        c = points[kids["centre"]]
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
        assert (d[~np.eye(len(c), dtype=bool)] > n["radius"] / 2).all()
    for entries in (points[:64], points[:1], np.repeat(points[:5], 3, 0)):
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (vector_codes.codes(points, order, nodes, entries) == want).all()
        total, count = vector_codes.sums(points, order, nodes, entries)
        assert (count == np.bincount(want, minlength=len(entries))).all()
        assert (total == np.stack([points[want == k].sum(0) for k in range(len(entries))])).all()
    far = rng.integers(-300, 300, (12, 4)).astype(np.int64)
    assert len(vector_codes.assign(points, order, nodes, far)[2]) < 300


def test_large_components_are_held(spark):
    rows, books = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], "vec_id long, embedding array<float>, label int"))
    assert [r["error"] for r in rows.collect()] == [0, 0] and books[0].tolist() == [[1 << 24], [-(1 << 24)]]


# SentencePiece


@pytest.fixture(scope="module")
def own():
    return piece_bpe.encoder()


def test_pieces_like_library_on_given_texts(spark, own):
    rows = piece_bpe.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.model.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.model.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("letters", ["ab ", "aaab", " ▁", "the in er on ", "中文字 a", "éàü\n\t<s></s><0x41>", "0123456789 .,", "🙂👍 \u0000­", "　  x"])
def test_pieces_like_library_on_random_texts(own, letters):
    rnd = random.Random(letters)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(400)]
    ids, at = own.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.model.encode(texts)


def test_pieces_side_by_side(own):
    """Pieces in random rows, where the longest match is often wrong: some positions fail and are taken back."""
    rnd, pieces = random.Random(8), list(own.score)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(9))) for _ in range(4000)]
    ids, at = own.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.model.encode(texts)


def test_memories_are_emptied(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMORY", 5)
    small = piece_bpe.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["some words that are cut and kept", "other words then", ""] * 3
    ids, at = small.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == small.model.encode(texts) and len(small.cuts) <= 5 and len(small.pairs) <= 5


def test_pieces_odd_rows(spark, own):
    """Null, empty and long texts, repeated rows, columns of the same names, no begin and end; and back again."""
    rows = [(1, None), (2, ""), (2, ""), (None, "x" * 50_000), (3, "long " * 30_000), (4, " \n▁ two  spaces ")]
    docs = spark.createDataFrame([(*r, 1, "old") for r in rows], "doc_id long, text string, n_tokens int, decoded string")
    got = piece_bpe.encode(docs, begin=False)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in got.collect():
        want = own.model.encode(r["text"] or "", add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == own.model.decode(want)
    back = piece_bpe.decode(got.select("doc_id", "ids", F.col("decoded").alias("was")))
    assert back.count() == 6 and back.where("decoded <> was").count() == 0
    assert piece_bpe.encode(docs.limit(0)).count() == 0
