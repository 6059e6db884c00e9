"""Each stage of the pipeline against brute force on what its predecessor kept."""

from __future__ import annotations

import itertools

import corpus_pipeline
import pyarrow as pa
from lodestone.llm import decontamination, jaccard_join, quality, tokens
from lodestone.llm.shared import Store, table
from pyspark.sql import functions as F

from .test_contracts import jaccard, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    store, docs = Store(spark, "test"), table(spark, SF, "documents")
    kept, frames = [{r["doc_id"]: r["text"] for r in docs.collect()}], [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(store.write(stage(spark, frames[-1], SF), f"s{k}"))
        if k < 4:
            assert frames[-1].columns == docs.columns
            kept.append({r["doc_id"]: r["text"] for r in frames[-1].collect()})
    rejected = {r["doc_id"] for r in quality.quality_scores(docs, table(spark, SF, "labels")).filter("predicted = 0").collect()}
    assert kept[1].keys() == kept[0].keys() - rejected and rejected

    assert kept[2].keys() <= kept[1].keys()
    seen = set()
    for _, text in sorted(kept[2].items()):
        w = text.split()
        runs = {tuple(w[i : i + 60]) for i in range(len(w) - 59)}
        assert not runs & seen
        seen |= runs

    sets = {i: shingles(t) for i, t in kept[2].items()}
    groups = {i: i for i in sets}

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.75 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.75:
            x, y = find(a), find(b)
            groups[max(x, y)] = min(x, y)
    assert kept[3].keys() == {i for i in sets if find(i) == i}

    items = [" ".join(r["text"].lower().split()) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in " ".join(t.lower().split()) for t in kept[4].values() for i in items)
    clean = {d for d, t in kept[3].items() if not any(shingles(t) & shingles(i) for i in items)}
    assert clean <= kept[4].keys()

    pieces = frames[5].collect()
    size = {d: len(tokens._tokenizer(None).encode(t, add_special_tokens=False).ids) + 1 for d, t in kept[4].items()}
    got = dict.fromkeys(size, 0)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == size


def test_stages_judge_rows_without_an_id_by_their_text(spark):
    """Clean texts stay beside a rejected, a repeated and a contaminated one under the same null or repeated doc_id."""
    docs = table(spark, SF, "documents")
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, table(spark, SF, "labels")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    best, worst = max(scores, key=scores.get), min(scores, key=scores.get)
    assert scores[worst] < 0.5 <= scores[best]
    item = table(spark, SF, "benchmark").first()["text"]
    words = lambda p: " ".join(f"{p}{i}" for i in range(80))
    cases = [(quality.stage, texts[worst], texts[best], []), (jaccard_join.stage, words("c"), words("d"), [(1, words("c"))]), (decontamination.stage, item, words("e"), [])]
    for stage, bad, clean, more in cases:
        for i in (None, 1 << 40):
            rows = [*more, (i, bad), (i, clean), (i, None)]
            frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
            got = [(r["doc_id"], r["text"]) for r in stage(spark, docs.unionByName(frame) if stage is quality.stage else frame, SF).collect()]
            assert (i, clean) in got and (i, bad) not in got and all(r in got for r in more)


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


NAMES = ["digest", "node", "best", "stays", "count", "doc", "th", "spans", "_z", "_null", "found", "c0", "x", "shard", "n", "lang", "source"]


def _odd(spark, rows):
    fields = ", ".join(["doc_id long", "text string", "n_chars long", *[f"`{n}` string" for n in NAMES]])
    return spark.createDataFrame([(d, t, 1, *[f"{k}.{n}" for n in NAMES]) for k, (d, t) in enumerate(rows)], fields)


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names are used within: each stage keeps the columns and all rows that it has no reason to drop."""
    plain = " ".join(f"clean{i}" for i in range(60))
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, plain), (4, plain), (None, plain), (5, long), (None, "short one"), (None, "short two")]
    docs = _odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert all(got.count(r) == rows.count(r) for r in rows if r[1] is None or len(r[1]) < 20), name
        assert (4, plain) in got and (5, long) in got, name
        for r in out.collect():
            assert all(r[n].endswith(f".{n}") and r[n].split(".")[0] == r["digest"].split(".")[0] for n in NAMES), name
    kept = quality.stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == len(rows)


def test_stages_take_empty_tables(spark):
    docs = _odd(spark, [])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0


def test_stages_take_texts_in_small_batches(spark):
    conf, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    docs = spark.range(3000).select("id", F.lit("a").alias("text")).coalesce(1)
    try:
        for rows in (10_000, 0, 500):
            spark.conf.set(conf, rows)
            corpus_pipeline.STAGES[0][1](spark, table(spark, SF, "documents"), SF)
            found = docs.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long")
            sizes.append(found.agg(F.max("n")).first()[0])
    finally:
        spark.conf.unset(conf)
    assert sizes == [1000, 1000, 500]
