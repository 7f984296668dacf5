"""The guard as a segmented scan and the settling mark, against going through one after another."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge, settle


def guarded_one_by_one(events, stored):
    """(key, arrival, op, lsn, v) and stored key -> (lsn, deleted, v): what a guarded table holds, and the arrivals it took."""
    table, taken = dict(stored), set()
    for key, arrival, op, lsn, v in sorted(events, key=lambda e: e[1]):
        old = table.get(key)
        if op == "d":
            if old and lsn > old[0]:
                table[key] = (lsn, True, old[2])
                taken.add((key, arrival))
        elif old is None or lsn > old[0]:
            table[key] = (lsn, False, v)
            taken.add((key, arrival))
    return table, taken


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("span", [None, 1, 7, 64, 1 << 16])
def test_segments_same_as_one_by_one(spark, seed, span):
    r = random.Random(seed)
    arrivals = r.sample(range(2000), 600)
    events = [(0 if i % 3 == 0 else r.randrange(1, 40), arrivals[i], r.choice("cuud"), r.randrange(1, 500), i) for i in range(600)]
    stored = {k: (r.randrange(1, 300), r.random() < 0.5, -k) for k in range(0, 40, 4)}
    want, taken = guarded_one_by_one(events, stored)
    df = spark.createDataFrame(events, "k int, arrival long, op string, lsn long, v int")
    old = spark.createDataFrame([(k, v, gone, lsn) for k, (lsn, gone, v) in stored.items()], "k int, v int, deleted boolean, source_lsn long")
    got = {r["k"]: (r["source_lsn"], r["deleted"], r["v"]) for r in merge.guarded(df, "k", ["v"], old, span).collect()}
    assert got == want
    assert {(r["k"], r["arrival"]) for r in merge.applied(df, "k", old, span).collect()} == taken


def test_a_hot_key_is_shared_by_tasks(spark):
    """One key in a third of all events: what is sorted together, and what a task of sixteen reads."""
    e = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("k"), F.col("id").alias("arrival"), F.floor(F.col("id") / 1000).alias("segment"))
    groups = e.groupBy("k", "segment").count().agg(F.max("count")).first()[0]
    assert groups <= 1000
    tasks = sorted(r["count"] for r in e.repartition(16, "k", "segment").groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 3 * tasks[len(tasks) // 2]
    alone = sorted(r["count"] for r in e.repartition(16, "k").groupBy(F.spark_partition_id()).count().collect())
    assert alone[-1] > 5 * alone[len(alone) // 2]  # the same without segments


def reads_one_by_one(seen, horizon):
    """position -> (batch it is read in, late), going through the batches with the set of positions."""
    out, visible, shown, void, mark = {}, set(), {}, set(), 0
    for batch in range(max(seen.values()) + (horizon or 0) + 1):
        fresh = {p for p, b in seen.items() if b == batch}
        for p in fresh & void:
            out[p] = (batch, True)
        visible |= fresh
        for p in range(1, max(visible, default=0)):
            shown.setdefault(p, batch)
        void |= {p for p, b in shown.items() if p not in visible and horizon is not None and batch >= b + horizon}
        while mark + 1 in visible or mark + 1 in void:
            mark += 1
            if mark in visible and mark not in out:
                out[mark] = (batch, False)
    return out


@pytest.mark.parametrize("horizon", [None, 0, 2, 5])
@pytest.mark.parametrize("span", [2, 9, 1 << 16])
def test_each_position_is_read_once(spark, horizon, span):
    r = random.Random(str((horizon, span)))
    positions = [p for p in range(1, 200) if r.random() > (0.05 if horizon is not None else 0.005)]
    seen = {p: (p + r.randrange(0, r.choice([3, 60]))) // 10 for p in positions}
    df = spark.createDataFrame([*seen.items(), *[(p, b + 1) for p, b in list(seen.items())[::7]]], "position long, batch long")
    want = reads_one_by_one(seen, horizon)
    rows = settle.read_in(df, horizon=horizon, span=span).collect()
    got = {r["position"]: (r["read_in"], r["late"]) for r in rows if r["read_in"] is not None}
    assert got == want and len(rows) == len(seen)


def test_marks_follow_holes_batch_by_batch(spark):
    r = random.Random(4)
    seen = {p: (p + r.randrange(0, 40)) // 12 for p in range(1, 150)}
    df = spark.createDataFrame(list(seen.items()), "position long, batch long")
    want = {r["batch"]: (r["mark"], r["holes"]) for r in settle.marks(df, span=8).collect()}
    holes, top = spark.createDataFrame([], "lo long, hi long"), 0
    for batch in sorted(set(seen.values())):
        fresh = df.filter(F.col("batch") == batch)
        again = df.filter(F.col("batch") < batch).limit(5)  # what is read again changes nothing
        cut, top = settle.advance(holes, top, fresh.unionByName(again))
        rows = cut.collect()
        holes = spark.createDataFrame(rows, "lo long, hi long") if rows else spark.createDataFrame([], "lo long, hi long")
        assert (settle.mark_of(holes, top), sum(r["hi"] - r["lo"] + 1 for r in rows)) == want[batch]
    assert settle.advance(holes, top, df.filter("batch < 0"))[1] == top


def test_empty_and_late_positions(spark):
    empty = spark.createDataFrame([], "position long, batch long")
    assert settle.read_in(empty).count() == 0 and settle.marks(empty).count() == 0
    df = spark.createDataFrame([(1, 0), (3, 0), (2, 9), (4, 1)], "position long, batch long")
    got = {r["position"]: (r["read_in"], r["late"]) for r in settle.read_in(df, horizon=2).collect()}
    assert got == {1: (0, False), 3: (2, False), 4: (2, False), 2: (9, True)}
    assert {r["position"]: r["read_in"] for r in settle.read_in(df).collect()} == {1: 0, 2: 9, 3: 9, 4: 9}
