"""The reader by positions, the two-phase writer and state by key, on files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources.positions import PositionReader, PositionSource, SlotLost, read_json
from tidemark.streaming import state, twophase
from tidemark.streaming.twophase import TwoPhaseTable, committed


@pytest.fixture
def sources(spark):
    spark.dataSource.register(PositionSource)
    spark.dataSource.register(TwoPhaseTable)
    state.with_rocksdb(spark)
    return spark


def reading(spark, tmp_path, **options):
    return spark.readStream.format("tidemark_positions").options(path=f"{tmp_path}/log", position="id", slot=f"{tmp_path}/slot.json", **options).load()


def until_done(df, tmp_path, query="q", **options):
    q = df.writeStream.format("tidemark_table").options(path=f"{tmp_path}/table", query=query, **options).option("checkpointLocation", f"{tmp_path}/progress").start()
    try:
        q.processAllAvailable()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def test_each_row_once_over_restarts_in_bounded_batches(sources, tmp_path):
    spark = sources
    spark.range(0, 1000, 1, 3).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/log")
    counts = until_done(reading(spark, tmp_path, rows="300", ranges="3", upto="449"), tmp_path, position="id")
    assert counts == [300, 150]
    assert until_done(reading(spark, tmp_path, rows="300"), tmp_path, position="id") == [300, 250]
    spark.range(1000, 1100).withColumn("v", F.col("id") * 2).write.mode("append").parquet(f"{tmp_path}/log")
    assert until_done(reading(spark, tmp_path, rows="300"), tmp_path, position="id") == [100]
    rows = committed(spark, f"{tmp_path}/table", "id long, v long")
    assert sorted(r["id"] for r in rows.collect()) == list(range(1100)) and rows.filter("v <> id * 2").count() == 0
    assert twophase.position(f"{tmp_path}/table", "q") == 1099 and twophase.position(f"{tmp_path}/table", "other") is None
    slot = read_json(f"{tmp_path}/slot.json")
    assert slot["planned"] == 1100 and slot["confirmed"] >= 1000
    assert len(twophase.commits(f"{tmp_path}/table")) == 5


def test_a_lost_slot_is_an_error(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/log")
    reader = PositionReader({"path": f"{tmp_path}/log", "position": "id", "slot": f"{tmp_path}/slot.json", "rows": "10"})
    assert reader.latestOffset() == {"position": 10} and [(p.lo, p.hi) for p in reader.partitions({"position": 0}, {"position": 10})] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert reader.latestOffset() == {"position": 20}
    with pytest.raises(SlotLost):
        reader.partitions({"position": 50}, {"position": 20})
    empty = spark.range(0)
    empty.write.parquet(f"{tmp_path}/none")
    assert PositionReader({"path": f"{tmp_path}/none", "position": "id", "slot": f"{tmp_path}/s.json"}).latestOffset() == {"position": 0}


def test_an_epoch_counts_once_and_a_failed_task_leaves_nothing_to_see(sources, tmp_path):
    spark = sources
    table = f"{tmp_path}/table"

    def write(df, epoch, query="load"):
        df.write.format("tidemark_table").options(path=table, query=query, epoch=epoch, position="id").mode("append").save()

    see = lambda: sorted(r["id"] for r in committed(spark, table, "id long").collect())
    assert see() == []
    write(spark.range(5), 0)
    write(spark.range(5), 0)  # again
    assert see() == [0, 1, 2, 3, 4]
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        write(broken, 1)
    assert see() == [0, 1, 2, 3, 4] and twophase.position(table, "load") == 4
    write(spark.range(50, 52), 1)
    write(spark.range(60, 61), 0, "maintenance")  # epochs of its own
    assert see() == [0, 1, 2, 3, 4, 50, 51, 60] and twophase.position(table, "load") == 51
    write(spark.range(0), 2)
    assert len(twophase.commits(table)) == 4 and twophase.position(table, "load") == 51
    assert json.loads((tmp_path / "table/commits/load/000000000001.json").read_text())["rows"] == 2


def test_guard_as_state_same_as_one_by_one(sources, tmp_path):
    from test_scan import guarded_one_by_one

    spark = sources
    import random

    r = random.Random(8)
    events = [(r.randrange(12), i, r.choice("cuud"), r.randrange(1, 300), i) for i in range(400)]
    stored = {k: (40, False, -k) for k in range(0, 12, 3)}
    want, taken = guarded_one_by_one(events, stored)
    spark.createDataFrame(events, "k int, id long, op string, lsn long, v int").coalesce(1).write.parquet(f"{tmp_path}/log")
    old = spark.createDataFrame([(k, v, lsn) for k, (lsn, _, v) in stored.items()], "k int, v int, source_lsn long")
    for upto in (149, 400):
        source = reading(spark, tmp_path, rows="150", upto=str(upto)).withColumnRenamed("id", "arrival")
        until_done(state.guarded_stream(source, "k", {"v": "int"}, old), tmp_path)
    rows = committed(spark, f"{tmp_path}/table", "k int, arrival long, v int, deleted boolean, source_lsn long").collect()
    assert {(x["k"], x["arrival"]) for x in rows} == taken
    last = {}
    for x in sorted(rows, key=lambda x: x["arrival"]):
        last[x["k"]] = (x["source_lsn"], x["deleted"], x["v"])
    assert stored | last == want


def test_idle_keys_close_their_batch(sources, tmp_path):
    """b has two events and then none: its batch is closed by the time that a's events tell."""
    spark = sources
    rows = [("a", 0, 0.0), ("b", 1, 0.05), ("a", 2, 0.1), ("b", 3, 0.15), ("a", 4, 0.19), ("a", 5, 0.3), ("a", 6, 0.31), ("a", 7, 0.32), ("a", 8, 9.0), ("a", 9, 30.0)]
    spark.createDataFrame(rows, "k string, id long, s double").select("k", "id", F.timestamp_micros((F.col("s") * 1e6 + 1e12).cast("long")).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/log")
    source = reading(spark, tmp_path, rows="4").withColumnRenamed("id", "position")
    until_done(state.batches(source, "k", 3, 0.2), tmp_path)
    got = {(r["k"], r["batch"]): (r["n"], r["lo"], r["hi"]) for r in committed(spark, f"{tmp_path}/table", "k string, batch long, n long, lo long, hi long").collect()}
    assert got == {("a", 0): (3, 0, 4), ("a", 1): (3, 5, 7), ("b", 0): (2, 1, 3), ("a", 2): (1, 8, 8)}


def test_a_backlog_is_read_by_larger_batches(sources, tmp_path):
    spark = sources
    spark.range(1000).write.parquet(f"{tmp_path}/log")
    assert until_done(reading(spark, tmp_path, rows="10", backlog="500"), tmp_path, position="id") == [10, 80, 500, 410]
    rows = committed(spark, f"{tmp_path}/table", "id long")
    assert sorted(r["id"] for r in rows.collect()) == list(range(1000))
    reader = PositionReader({"path": f"{tmp_path}/log", "position": "id", "slot": f"{tmp_path}/s.json", "rows": "10", "backlog": "500", "upto": "49"})
    ends = [0]
    for _ in range(3):  # a batch that is not full brings the size back
        ends.append(reader.latestOffset()["position"])
        reader.partitions({"position": ends[-2]}, {"position": ends[-1]})
    assert ends == [0, 10, 50, 50] and reader.size == 10


@pytest.mark.parametrize("most,wait", [(1, 3), (4, 3), (20, 50), (7, 1000)])
def test_batches_same_as_one_by_one_and_a_timer_for_the_open_one_alone(most, wait):
    import random

    import pandas as pd

    class Handle:
        def __init__(self):
            self.held, self.timers = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.held

        def update(self, value):
            assert all(type(v) is int for v in value)
            self.held = value

        def registerTimer(self, at):
            self.timers.append(at)

    r = random.Random(most)
    us = [0]
    for _ in range(499):
        us.append(us[-1] + r.choice([0, 0, 1, 2, 60]) * 1_000_000)
    want, i = [], 0
    while i < 500:
        j = i + 1
        while j < 500 and j < i + most and us[j] - us[i] < wait * 1_000_000:
            j += 1
        want.append((len(want), j - i, i, j - 1))
        i = j
    handle, got, calls = Handle(), [], 0
    p = state.Batches("k", most, wait)
    p.init(handle)
    for lo in range(0, 500, 90):
        rows = pd.DataFrame({"k": "a", "position": range(lo, min(500, lo + 90)), "us": us[lo : lo + 90]})[::-1]  # out of order, in two frames
        for frame in p.handleInputRows(("a",), iter([rows[:40], rows[40:]]), None):
            got += list(frame[["batch", "n", "lo", "hi"]].itertuples(index=False, name=None))
        calls += 1
    assert len(handle.timers) <= calls
    if handle.held[1]:
        got.append(tuple(handle.held[:4]))
    assert got == want
