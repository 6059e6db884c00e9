"""Tables that last over upserts, and the status stream: one batch or many, late events, retries and batches that broke off."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources.buckets import KEEP, BucketTable
from lodestone.streaming import status

SCHEMA = "k long, v string, no long"


def files(path):
    return {(p, f) for p, _, names in os.walk(path) for f in names if f.startswith("part-")}


def table_of(spark, path, buckets=8):
    return BucketTable(spark, f"file://{path}", spark.createDataFrame([], SCHEMA).schema, ["k"], ["no"], buckets)


def content(table):
    return {r["k"]: (r["v"], r["no"]) for r in table.read().collect()}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    table, make = table_of(spark, tmp_path), lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert content(table) == {}
    assert len(table.apply(make([(k, "a", 0) for k in range(100)]), 0)) == 8
    before = files(tmp_path / "data")
    written = table.apply(make([(7, "b", 1), (7, "c", 2), (7, "old", -1)]), 1)
    assert len(written) == 1 and {p.split("bucket=")[1].split("/")[0] for p, _ in files(tmp_path / "data") - before} == {str(written[0])}
    assert before < files(tmp_path / "data")
    assert content(table) == {k: ("c", 2) if k == 7 else ("a", 0) for k in range(100)}
    assert table.apply(make([(8, "x", 9)]), 1) == [] and content(table)[8] == ("a", 0)  # batch 1 is in already
    assert table.apply(make([]), 2) == [] and table.apply(make([(8, "y", 1)]), 2) == []


def test_old_versions_go(spark, tmp_path):
    table = table_of(spark, tmp_path, 2)
    for no in range(3 * KEEP):
        table.apply(spark.createDataFrame([(k, str(no), no) for k in range(20)], SCHEMA), no)
    assert content(table) == {k: (str(3 * KEEP - 1), 3 * KEEP - 1) for k in range(20)}
    assert len({p for p, _ in files(tmp_path / "data")}) == 4 and len({p for p, _ in files(tmp_path / "manifest")}) == KEEP


def test_a_batch_that_broke_off_starts_anew(spark, tmp_path, monkeypatch):
    """The data of a batch is there, its manifest isn't: readers see the table before it, and the retry puts it in once."""
    table = table_of(spark, tmp_path)
    table.apply(spark.createDataFrame([(k, "a", 0) for k in range(30)], SCHEMA), 0)
    change = spark.createDataFrame([(k, "b", 1) for k in range(0, 30, 2)], SCHEMA)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: 1 / 0)  # the manifest is made by it
    with pytest.raises(ZeroDivisionError):
        table.apply(change, 1)
    monkeypatch.undo()
    assert set(content(table).values()) == {("a", 0)}
    assert table.apply(change, 1) and content(table) == {k: ("b", 1) if k % 2 == 0 else ("a", 0) for k in range(30)}


EVENT = "user_id long, status string, ts timestamp, event_id long"
START = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, late):
    for no, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{no:03}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    query, table = status.run_status(stream, f"file://{tmp_path}/c", f"file://{tmp_path}/t", late=late, buckets=4)
    query.awaitTermination()
    return {r["user_id"]: (r["status"], r["event_id"], r["stale"]) for r in table.read().collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_status_stream_in_one_batch_and_in_many(spark, tmp_path, parts):
    """Events out of order; the clock's tick brings the watermark to the reference time."""
    rnd = random.Random(6)
    events = [(rnd.randrange(12), rnd.choice(["pending", "processing", "completed", "failed"]), START + datetime.timedelta(minutes=rnd.randrange(600)), i) for i in range(80)]
    now = START + datetime.timedelta(minutes=600)
    tick = (99, "completed", now + datetime.timedelta(days=1), 1000)
    got = run(spark, tmp_path, [events[k::parts] for k in range(parts)] + [[tick]], "1 day")
    last = {}
    for user, kind, ts, i in events:
        last[user] = max(last.get(user, (datetime.datetime.min, -1, "")), (ts, i, kind))
    want = {u: (kind, i, kind != "completed" and ts < now - datetime.timedelta(hours=2)) for u, (ts, i, kind) in last.items()}
    assert {u: v for u, v in got.items() if u != 99} == want and {v[2] for v in want.values()} == {True, False}


def test_stale_items_become_current_again(spark, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    got = run(spark, tmp_path, [[(1, "pending", at(0), 1), (2, "pending", at(0), 2)], [(9, "completed", at(6), 3)], [(1, "processing", at(5.5), 4)], [(9, "completed", at(6.5), 5)]], "1 hour")
    assert got[1] == ("processing", 4, False) and got[2] == ("pending", 2, True)
