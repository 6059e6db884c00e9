"""Trees by pointer doubling and ranks by ranges."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import graph as G
from lodestone.operators import relational as R


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    cuts, cut = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df, s: (cuts.append(1), cut(df, s))[1])
    chain = spark.range(5001).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    rows = G.tree_walk(chain, "id", "parent").collect()
    assert {(r["id"], r["depth"]) for r in rows} == {(i, i) for i in range(5001)} and len(cuts) <= 14


def test_paths_of_random_trees(spark):
    """Several roots, a node whose parent is missing and what hangs below it, a root with many children."""
    rnd = random.Random(3)
    rows = [(i, None if i % 50 == 0 else 0 if i % 3 == 0 else rnd.randrange(i), f"n{i}") for i in range(200)] + [(900, 899, "lost"), (901, 900, "lost too")]
    of = {i: (p, n) for i, p, n in rows}

    def path(i):
        p, n = of[i]
        return f"/{n}" if p is None else path(p) + f"/{n}"

    got = {r["id"]: (r["path"], r["depth"]) for r in G.tree_paths(spark.createDataFrame(rows, "id long, parent long, name string"), "id", "parent", "name").collect()}
    assert got == {i: (path(i), path(i).count("/") - 1) for i in range(200)}


@pytest.mark.parametrize("rows, most", [([(1, 2), (2, 3), (3, 1), (4, None)], 100), ([(1, 1)], 100), ([(i, i - 1 if i else None) for i in range(12)], 10)])
def test_cycles_and_paths_that_are_too_long(spark, rows, most):
    with pytest.raises(ValueError, match="a path of more than"):
        G.tree_walk(spark.createDataFrame(rows, "id long, parent long"), "id", "parent", most)


def test_ranks_without_a_common_window(spark):
    """A third of all rows has one score; null scores come last."""
    rnd = random.Random(2)
    rows = [(i, 7.0 if i % 3 == 0 else rnd.choice([None, 1.0, 2.5, float(i)])) for i in range(3000)]
    got = {r["id"]: r["rank"] for r in R.ranked(spark.createDataFrame(rows, "id long, score double"), "score", "id").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}
    assert R.ranked(spark.createDataFrame([], "id long, score double"), "score", "id").count() == 0
