"""Names by edit distance and trigrams, and pairs of hot events: against brute force, and how much they join."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(len(text) + 1)
        text = rnd.choice([text[:i] + rnd.choice("abé") + text[i:], text[:i] + text[i + 1 :], text[:i] + rnd.choice("abé") + text[i + 1 :]])
    return text


@pytest.mark.parametrize("short", [0, 3, 8, 24])
@pytest.mark.parametrize("most", [1, 2])
def test_nearest_name_by_segments_and_deletions(spark, monkeypatch, short, most):
    """Around every border between the two ways, with texts of 0 to 14 characters."""
    monkeypatch.setattr(R, "SHORT", short)
    rnd = random.Random(short * 10 + most)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(15))) for _ in range(60)]
    names = [edited(rnd, rnd.choice(words), rnd.randrange(4)) for _ in range(80)]
    got = R.nearest_name(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name", spark.createDataFrame([(w,) for w in [*words, None]], "word string"), "word", most)
    want = {n: min((distance(n, w), w) for w in words) for n in names}
    assert {r["name"]: (r["distance"], r["word"]) for r in got.collect()} == {n: m for n, m in want.items() if m[0] <= most}


def test_long_names_cost_as_many_rows_as_others(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh") for _ in range(2000))
    names = spark.createDataFrame([(edited(rnd, text, 2),)], "name string")
    words = spark.createDataFrame([(text,), (text[:-3],), ("x" * 2000,)], "word string")
    assert [(r["word"] == text, r["distance"] <= 2) for r in R.nearest_name(names, "name", words, "word").collect()] == [(True, True)]
    assert R.close_pairs(names, words, 2).count() <= 2


def grams(text):
    t = f"  {text.lower()} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.8])
def test_trigrams_like_brute_force(spark, least):
    rnd = random.Random(7)
    names = [edited(rnd, "common beginning of all " + "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randrange(20))), 1) for _ in range(80)] + ["", "a", "Ab"]
    queries = [edited(rnd, rnd.choice(names), 3) for _ in range(30)] + ["", "zzz"]
    df = lambda rows, c: spark.createDataFrame([(r,) for r in [*rows, None]], f"{c} string")
    score = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = set()
    for q in set(queries):
        best = sorted((-score(q, n), n) for n in set(names) if score(q, n) > least)[:5]
        want |= {(q, n, round(-s, 9)) for s, n in best}
    assert {(r["query"], r["name"], round(r["similarity"], 9)) for r in R.similar_by_trigram(df(names, "n"), "n", df(queries, "q"), "q", least).collect()} == want


def test_common_trigrams_make_no_candidates(spark):
    """All names begin alike; a query is compared with those that share something rare."""
    names = spark.createDataFrame([(f"customer number {i:05}",) for i in range(0, 20000, 7)], "n string")
    queries = spark.createDataFrame([(f"customer number {i:05}",) for i in range(0, 20000, 700)], "q string")
    n = R.trigram_candidates(names, "n", queries, "q", 0.85).count()
    assert n < 0.1 * names.count() * queries.count()


@pytest.mark.parametrize("members", [3, 1024])
def test_pairs_of_events_in_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(R, "MEMBERS", members)
    rnd = random.Random(1)
    rows = [(0, m) for m in range(25)] + [(e, rnd.randrange(40)) for e in range(1, 30) for _ in range(4)] + [(1, None), (None, 1), (0, 3)]
    got = R.coparticipants(spark.createDataFrame(rows, "event int, member int"), "member", "event").collect()
    by = {}
    for e, m in rows:
        if e is not None and m is not None:
            by.setdefault(e, set()).add(m)
    assert sorted(map(tuple, got)) == sorted({p for s in by.values() for p in itertools.permutations(s, 2)})


def test_no_task_has_more_than_a_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "MEMBERS", 50)
    bridge = spark.createDataFrame([(1, m) for m in range(1000)], "event int, member int")
    pairs = R.coparticipants(bridge, "member", "event")
    assert pairs.count() == 999_000
    plan = pairs._jdf.queryExecution().toString()
    assert "low" in plan and "high" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
