"""The stream end to end on files: capture, restart, gaps, replay, hidden fields, reconciliation, quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.verdict import verdict_of
from tidemark.operators import diff, guard, quarantine, reconcile
from tidemark.schemas import DEAD_LETTER, SPECS, registry
from tidemark.streaming.apply import Applier, Halted, start, with_retry
from tidemark.streaming.metrics import Meters, SkewProbe
from tidemark.streaming.outbox import Outbox, Worker, poll_wait, run
from tidemark.streaming.store import Store

COMPUTER = {"brand": "Norrland", "model": "Slate 9", "cpu": "Heron 4", "ram_gb": "24", "price_usd": "1234.56"}


def event(table, op, lsn, after=None, before=None, wrap=False):
    e = {"before": before, "after": after, "source": {"table": table, "lsn": lsn, "ts_ms": 1700000000000 + lsn}, "op": op}
    return json.dumps({"payload": e} if wrap else e)


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def go(spark, tmp_path, applier):
    q = start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", applier)
    q.awaitTermination()
    return q


def test_golden_row_and_lifecycle(spark, tmp_path, store):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.txt", [event("computer", "c", 1, {"id": "7", **COMPUTER}), "", event("note", "c", 2, {"id": "1"}), event("cdc_heartbeat", "u", 3, {"id": "1"}), event("computer", "t", 4)])
    applier = Applier(store, audited="computer", least_failures=10)
    go(spark, tmp_path, applier)
    row = store.read("computer").collect()[0]
    assert (row["full_name"], row["spec"], int(row["price_krw"]), row["deleted"], row["source_lsn"]) == ("Norrland Slate 9", "Heron 4 / 24GB", 1666656, False, 1)
    assert store.manifest()["position"] == 3  # skipped tables move progress too
    write(tmp_path / "in", "2.txt", [event("computer", "u", 8, {"id": "7", **COMPUTER, "ram_gb": "64"}, {"id": "7", **COMPUTER}, wrap=True), event("computer", "u", 9, {"id": "7", **COMPUTER, "ram_gb": "x"}), "{broken"])
    go(spark, tmp_path, applier)
    assert store.read("computer").first()["spec"] == "Heron 4 / 64GB"
    letters = {r["failure_type"]: r for r in store.read("cdc_dead_letter").collect()}
    assert set(letters) == {"data", "unparsable"} and letters["data"]["failure_message"] == "bad:ram_gb" and letters["unparsable"]["source_table"] == "unknown"
    audits = {r["source_lsn"]: r for r in store.read("cdc_change_audit").collect()}
    assert audits[8]["changed_fields"] == "ram_gb" and json.loads(audits[8]["after_values"]) == {"ram_gb": "64"}
    assert audits[9]["identifiable"] is False
    write(tmp_path / "in", "3.txt", [event("computer", "d", 10, None, {"id": "7"}), event("computer", "d", 11, None, {"id": "99"})])
    go(spark, tmp_path, applier)
    rows = store.read("computer").collect()
    assert len(rows) == 1 and rows[0]["deleted"] and rows[0]["spec"] == "Heron 4 / 64GB"


def test_restart_loses_and_repeats_nothing(spark, tmp_path, store):
    (tmp_path / "in").mkdir()
    car = {"name": "n", "brand": "b", "price": "10.50", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00+09:00"}
    write(tmp_path / "in", "1.txt", [event("car", "c", i, {"id": str(i), **car}) for i in range(1, 501)])
    go(spark, tmp_path, Applier(store))
    write(tmp_path / "in", "2.txt", [event("car", "c", i, {"id": str(i), **car}) for i in range(501, 1001)] + [event("car", "d", 1001, None, {"id": "3"})])
    go(spark, tmp_path, Applier(store))
    assert store.read("car").count() == 999
    batch = store.manifest()["batch"]
    lines = spark.createDataFrame([(event("car", "d", 2000, None, {"id": "5"}),)], "value string")
    Applier(store)(lines, batch)  # a batch that is committed is skipped
    assert store.read("car").count() == 999
    assert store.prune(1) is not None and store.read("car").count() == 999


GRADE = {"id": "1", "code": "A", "name": "a", "discount_rate": "1.50", "created_at": "2024-01-01T00:00:00Z"}
CAR = {"id": "1", "name": "n", "brand": "b", "price": "1.00", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z"}


def lines_of(spark, *events):
    return spark.createDataFrame([(e,) for e in events], "value string").coalesce(1)


def test_one_bad_row_among_equal_positions_is_alone_quarantined(spark, store):
    good = [event("grade", "r", 0, {**GRADE, "id": str(i)}) for i in range(9)]
    Applier(store)(lines_of(spark, *good[:4], event("grade", "r", 0, {**GRADE, "id": "x"}), *good[4:]), 0)
    assert store.read("grade").count() == 9 and [r["failure_message"] for r in store.read("cdc_dead_letter").collect()] == ["bad:id"]


def test_a_halt_is_not_tried_again(spark, store, monkeypatch):
    calls = []
    real = Applier.apply
    monkeypatch.setattr(Applier, "apply", lambda self, *a: (calls.append(1), real(self, *a))[1])
    applier = Applier(store)
    with pytest.raises(Halted):
        applier(lines_of(spark, event("grade", "u", 1, {"id": "x"}), event("grade", "u", 2, {"id": "y"})), 0)
    assert len(calls) == 1 and verdict_of(Halted("x")) == "HALT" and applier.meters.get("halts_total", reason="Halted") == 1


def test_unlisted_states_fall_back_to_the_kind_of_error():
    class Odd(ValueError):
        def getSqlState(self):
            return "XX000"

    class Plain(Exception):
        def getSqlState(self):
            return "XX000"

    assert verdict_of(Odd()) == "DEAD_LETTER" and verdict_of(Plain()) == "RETRY"


def test_letters_of_equal_text_are_their_own_and_the_oldest_goes_first(spark, store):
    applier = Applier(store, least_failures=99)
    applier(lines_of(spark, "{broken", "{broken", event("grade", "u", 5, {**GRADE, "discount_rate": "x"})), 0)
    applier(lines_of(spark, event("grade", "u", 6, {**GRADE, "discount_rate": "y"}), "{broken"), 1)
    letters = store.read("cdc_dead_letter").orderBy("id").collect()
    assert [r["id"] for r in letters] == [1, 2, 3, 4, 5] and [r["failure_type"] for r in letters] == ["unparsable", "unparsable", "data", "data", "unparsable"]
    asked = store.read("cdc_dead_letter").withColumn("status", F.lit("RETRY_REQUESTED"))
    store.commit(2, None, {"cdc_dead_letter": asked})
    assert [r["id"] for r in quarantine.claim(store.read("cdc_dead_letter"), 2).collect()] == [1, 2]
    assert applier.reprocess(2) == {"claimed": 2, "resolved": 0}
    after = store.read("cdc_dead_letter").orderBy("id").collect()
    assert [(r["id"], r["status"], r["attempts"]) for r in after[:3]] == [(1, "PENDING", 2), (2, "PENDING", 2), (3, "RETRY_REQUESTED", 1)] and len(after) == 5
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    assert quarantine.settled(store.read("cdc_dead_letter"), ids, ids.limit(0), "2024-01-01 00:00:00").count() == 5


def test_unguarded_tables_take_the_last_arrival_guarded_ones_the_highest_position(spark, store):
    Applier(store)(lines_of(spark, event("car", "u", 9, {**CAR, "name": "high"}), event("car", "u", 4, {**CAR, "name": "last"}), event("grade", "u", 9, {**GRADE, "name": "high"}), event("grade", "u", 4, {**GRADE, "name": "last"}), event("grade", "u", 9, {**GRADE, "name": "again"})), 0)
    assert store.read("car").first()["name"] == "last" and store.read("grade").first()["name"] == "high"


def test_only_touched_tables_and_buckets_are_written(spark, store):
    applier = Applier(store, buckets=8)
    applier(lines_of(spark, *[event("grade", "c", i, {**GRADE, "id": str(i)}) for i in range(1, 60)], event("car", "c", 60, CAR)), 0)
    before = store.manifest()["versions"]
    applier(lines_of(spark, event("grade", "u", 70, {**GRADE, "id": "7", "name": "new"})), 1)
    after = store.manifest()["versions"]
    assert after["car"] == before["car"] and sum(after["grade"][b] != before["grade"][b] for b in before["grade"]) == 1 and "cdc_dead_letter" not in after
    assert store.read("grade").count() == 59 and store.read("grade").filter("name = 'new'").count() == 1
    store.prune(0)
    assert store.read("grade").count() == 59 and store.read("car").count() == 1
    applier(lines_of(spark, event("car", "d", 71, None, {"id": "1"})), 2)
    assert store.read("car") is None or store.read("car").count() == 0


def test_appended_tables_are_compacted(spark, store):
    for n in range(4):
        store.commit(n, None, append={"log": spark.range(n, n + 1)})
    assert not store.compact("log", 4) and store.compact("log", 3) and len(store.paths("log")) == 1 and store.read("log").count() == 4


def test_a_gap_stops_the_start(spark, tmp_path, store):
    (tmp_path / "in").mkdir()
    checkpoints = spark.createDataFrame([("main", 100)], "pipeline string, last_applied long")
    slots = spark.createDataFrame([("main", 500)], "pipeline string, restart long")
    applier = Applier(store)
    with pytest.raises(guard.CaptureGap):
        start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", applier, checkpoints=checkpoints, slots=slots)
    assert applier.meters.get("capture_gap") == 1.0
    start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", applier, checkpoints=checkpoints, slots=slots, fail_on_gap=False).awaitTermination()
    start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", applier, checkpoints=checkpoints, slots=slots.withColumn("restart", F.lit(7).cast("long"))).awaitTermination()
    assert applier.meters.get("capture_gap") == 0.0


def test_outbox_cycles_restart_and_prune(spark, tmp_path, store):
    log = Outbox(Store(spark, f"file://{tmp_path}/source"))
    source = {
        "grade": spark.createDataFrame([(i, f"c{i}", "now", i / 4) for i in range(1, 6)], "id long, code string, name string, discount_rate double").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")),
        "car": spark.createDataFrame([(1, "car")], "id long, name string").select("id", "name", F.lit("b").alias("brand"), F.lit(1).cast("decimal(12,2)").alias("price"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")),
    }
    entries = [(1, "grade", 1, "c"), (2, "grade", 1, "u"), (3, "grade", 2, "c"), (4, "grade", 2, "d"), (5, "grade", 3, "c"), (6, "car", 1, "c"), (7, "grade", 9, "u"), (8, "grade", 3, "d"), (9, "grade", 3, "c"), (10, "car", 1, "d"), (11, "grade", 1, "d"), (12, "other", 1, "u")]
    log.append(spark.createDataFrame([(*e, 0) for e in entries], "seq long, table_name string, row_id long, op string, t long").withColumn("changed_at", F.timestamp_seconds("t")))

    def worker():
        return Worker(log, source.__getitem__, store, size=6, buckets=4)

    first = worker()
    assert first.run_once() == 4 and first.meters.get("outbox_pending") == 6 and log.rows().count() == 6
    assert {r["id"]: (r["deleted"], r["source_seq"]) for r in store.read("grade").collect()} == {1: (False, 6), 3: (False, 6)} and store.read("car").count() == 1
    log.append(spark.createDataFrame([(2, "grade", 1, "u", 0)], "seq long, table_name string, row_id long, op string, t long").withColumn("changed_at", F.timestamp_seconds("t")))  # as if a prune was lost
    second = worker()  # a restart goes on from the checkpoint
    assert second.run_once() == 4 and second.run_once() == 0 and log.rows().count() == 0 and log.store.read("sync_outbox").count() == 13
    log.vacuum()
    assert log.store.read("sync_outbox").count() == 0
    assert second.meters.get("outbox_pending") == 0
    assert {r["id"]: (r["deleted"], r["source_seq"]) for r in store.read("grade").collect()} == {1: (True, 12), 3: (False, 12)}
    assert (store.read("car") is None or store.read("car").count() == 0) and store.manifest()["position"] == 12


def test_a_backlog_in_few_commits_is_as_cycle_by_cycle(spark, tmp_path):
    import random

    from tidemark.streaming.outbox import catch_up

    r = random.Random(5)
    source = {
        "grade": spark.createDataFrame([(i, f"c{i}", "now", i / 4) for i in range(1, 30, 2)], "id long, code string, name string, discount_rate double").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")),
        "car": spark.createDataFrame([(i, "car") for i in range(1, 30, 2)], "id long, name string").select("id", "name", F.lit("b").alias("brand"), F.lit(1).cast("decimal(12,2)").alias("price"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at")),
    }
    entries = [(seq, r.choice(["grade", "car"]), r.randrange(30), r.choice("cud"), 0) for seq in range(1, 160, 2)]
    log = spark.createDataFrame(entries, "seq long, table_name string, row_id long, op string, t long").withColumn("changed_at", F.timestamp_seconds("t"))
    held, commits = [], []
    for name, go in (("one", lambda w: [None for _ in iter(w.run_once, 0)]), ("many", lambda w: catch_up(w, 4))):
        own, store = Outbox(Store(spark, f"file://{tmp_path}/{name}-log")), Store(spark, f"file://{tmp_path}/{name}")
        own.append(log)
        go(Worker(own, source.__getitem__, store, size=8, buckets=2))
        held.append({(t, x["id"]): (x["deleted"], x["source_seq"]) if t == "grade" else None for t in ("grade", "car") for x in store.read(t).collect()})
        commits.append(store.manifest()["version"] + 1)
        assert store.manifest()["position"] == 159
    assert held[0] == held[1] and any(v and v[0] for v in held[0].values())
    assert commits == [10, 3]


def test_the_loop_rests_only_when_nothing_waits_and_backs_off():
    class Fake:
        meters = Meters()
        results = iter([5, 5, 0, OSError("down"), OSError("down"), 3, 0])

        def run_once(self):
            x = next(self.results)
            if isinstance(x, Exception):
                raise x
            self.meters.cycle()
            return x

    fake, waits, turns = Fake(), [], iter([True] * 7 + [False])
    run(fake, lambda: next(turns), sleep=waits.append)
    assert waits == [0.2, 0.4, 0.8, 0.2]


def test_mass_failure_halts_and_commits_nothing(spark, store):
    bad = spark.createDataFrame([(event("grade", "u", i, {"id": "x"}),) for i in range(3)] + [(event("grade", "u", 9, {"id": "1", "code": "A", "name": "a", "discount_rate": "1.50", "created_at": "2024-01-01T00:00:00Z"}),)], "value string")
    with pytest.raises(Halted):
        Applier(store)(bad, 0)
    assert store.manifest()["batch"] == -1 and store.read("grade") is None


def test_letters_are_tried_again_only_when_asked(spark, store):
    good = {"id": "1", "code": "A", "name": "a", "discount_rate": "1.50", "created_at": "2024-01-01T00:00:00Z"}
    applier = Applier(store, least_failures=99)
    applier(spark.createDataFrame([(event("grade", "u", 1, {**good, "discount_rate": "oops"}),), (event("grade", "u", 2, {**good, "id": "2"}),)], "value string"), 0)
    assert applier.reprocess() == {"claimed": 0, "resolved": 0}
    letters = store.read("cdc_dead_letter")
    fixed = letters.withColumn("status", F.lit("RETRY_REQUESTED")).withColumn("payload", F.regexp_replace("payload", "oops", "2.25"))
    store.commit(None, None, {"cdc_dead_letter": fixed})
    assert applier.reprocess() == {"claimed": 1, "resolved": 1}
    assert {r["id"]: str(r["discount_rate"]) for r in store.read("grade").collect()} == {1: "2.25", 2: "1.50"}
    assert [r["status"] for r in store.read("cdc_dead_letter", DEAD_LETTER).collect()] == ["RESOLVED"]


def test_resync_restores_counts(spark, store):
    rows = spark.range(100).select("id", F.lit("c").alias("code"), F.lit("n").alias("name"), F.lit("1.00").cast("decimal(5,2)").alias("discount_rate"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    applier = Applier(store)
    applier.resync("grade", rows.filter("id < 50 or id = 99"), 10)
    applier.resync("grade", rows.filter("id < 99"), 20)
    got = store.read("grade")
    assert got.filter("not deleted").count() == 99 and [r["id"] for r in got.filter("deleted").collect()] == [99]


def test_gap_is_found_before_start(spark):
    c = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", None)], "pipeline string, last_applied long")
    s = spark.createDataFrame([("a", 100), ("b", 101), ("d", 5)], "pipeline string, restart long")
    found = {r[0]: r[3] for r in guard.check(c, s, fail=False)}
    assert found == {"b": "restart after last applied", "c": "slot missing"}
    with pytest.raises(guard.CaptureGap):
        guard.check(c, s)


def test_hidden_values(spark):
    big = "x" * 200_000
    rows = spark.createDataFrame([(1, {"id": "1", "p": diff.UNREADABLE, "n": "b"}, {"id": "1", "p": big, "n": "a"}), (2, {"id": "2", "n": "a"}, None)], "k int, after map<string,string>, before map<string,string>")
    out = {r["k"]: r for r in rows.select("k", diff.field_diff(F.col("before"), F.col("after")).alias("d"), diff.recovered(F.col("before"), F.col("after")).alias("r")).collect()}
    assert out[1]["d"]["changed"] == ["n"] and out[1]["d"]["unreadable"] == ["p"] and out[1]["r"]["p"] == big
    assert out[2]["d"]["identifiable"] is False and out[2]["d"]["changed"] == []


def test_checksum_sees_what_counts_miss(spark):
    a = spark.range(300).withColumn("amount", F.col("id") + 1000)
    b = a.withColumn("amount", F.when(F.col("id") == 0, 1001).otherwise(F.col("amount")))
    x, y, z = (reconcile.ordered_checksum(df, ["id", "amount"], "id").first() for df in (a, b, a.filter("id > 2")))
    assert x["n"] == y["n"] and x["checksum"] != y["checksum"] and z["n"] == 297


def test_retry_waits_twice_as_long_each_time():
    waits, calls = [], []

    def work():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        with_retry(work, sleep=waits.append)
    assert len(calls) == 4 and waits == [0.2, 0.4, 0.8]
    calls.clear()
    with pytest.raises(ValueError):
        with_retry(lambda: (calls.append(1), int("x")), sleep=waits.append)
    assert len(calls) == 1


def test_small_rules(spark):
    assert poll_wait(0) == 0.2 and poll_wait(20) == 12.8
    now = [0.0]
    m = Meters(lambda: now[0])
    m.failed("x"), m.failed("x")
    assert m.healthy() and m.get("capture_gap") == 0.0
    m.failed("Halted", halted=True)
    assert not m.healthy() and m.get("halts_total", reason="Halted") == 1
    m.cycle()
    now[0] = 61
    assert not m.healthy()
    m.time("lag_seconds", 2.0, table="car"), m.time("lag_seconds", 1.0, table="car")
    got = {(r["metric"], r["labels"].get("table")): r["value"] for r in m.samples(spark).collect()}
    assert got["lag_seconds_count", "car"] == 2 and got["lag_seconds_sum", "car"] == 3 and got["lag_seconds_max", "car"] == 2
    readings = iter([61.4, None])

    def read():
        x = next(readings)
        if x is None:
            raise OSError("down")
        return x

    probe = SkewProbe(read, m, lambda: now[0])
    assert probe() == pytest.approx(0.4) and probe() == pytest.approx(0.4) and m.get("skew_probe_errors_total") == 1
    assert not quarantine.must_halt(1, 2) and quarantine.must_halt(2, 3) and not quarantine.must_halt(1, 1, least=2)
    with pytest.raises(Exception) as e:
        spark.sql("select * from no_such_table").collect()
    assert verdict_of(e.value) == "HALT"
    with pytest.raises(ValueError):
        registry(SPECS["car"], SPECS["car"])


def test_empty_batch_moves_nothing(spark, store):
    Applier(store)(spark.createDataFrame([], "value string"), 0)
    assert store.manifest()["position"] is None and store.manifest()["batch"] == 0


def test_beats_come_while_nothing_changes(spark, tmp_path):
    from tidemark.streaming.metrics import heartbeat

    q = heartbeat(spark, 10).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="100 milliseconds").start(f"file://{tmp_path}/beats")
    for _ in range(60):
        if (q.lastProgress or {}).get("batchId", 0) >= 2:
            break
        q.awaitTermination(1)
    q.stop()
    rows = sorted(r["beat_at"].timestamp() for r in spark.read.parquet(f"file://{tmp_path}/beats").collect())
    assert len(rows) >= 2 and all(b - a == 10 for a, b in zip(rows, rows[1:], strict=False))


def test_pages_cover_each_row_once(spark):
    from tidemark.operators import chunks

    df = spark.range(0, 1000, 3).withColumn("point", F.lit(1))
    done = []
    total = chunks.chunked_update(df, "id", 100, {"point": F.col("point") + 1}, lambda page: done.extend(page.collect()))
    assert total == 334 and sorted(r["id"] for r in done) == list(range(0, 1000, 3)) and all(r["point"] == 2 for r in done)
    assert chunks.chunked_update(df, "id", 100, {}, lambda page: None, most=150) == 150


def test_progress_is_counted(spark, tmp_path, store):
    from tidemark.sources.changes import snapshot_tables, tables_with_prefix
    from tidemark.streaming.metrics import Progress, observed

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.txt", [event("grade", "d", i, None, {"id": str(i)}) for i in range(5)])
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        q = go(spark, tmp_path, Applier(store))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.values[str(q.id)]["rows"] == 5
    seen = observed(spark.createDataFrame([("u", 4), ("d", 9)], "op string, lsn long"))
    assert seen.count() == 2
    assert snapshot_tables(["car", "cdc_heartbeat"]) == ["car"]
    spark.range(1).createOrReplaceTempView("cdc_own")
    spark.range(1).createOrReplaceTempView("car_view")
    assert "car_view" in tables_with_prefix(spark) and "cdc_own" not in tables_with_prefix(spark)


def test_maintenance_between_batches_loses_nothing(spark, tmp_path, store):
    """Reprocessing, resync and compaction make commits of their own: the stream's next batch is still applied."""
    (tmp_path / "in").mkdir()
    grade = {"code": "A", "name": "a", "discount_rate": "1.50", "created_at": "2024-01-01T00:00:00Z"}
    applier = Applier(store, audited="grade", least_failures=99)
    source = spark.createDataFrame([(1, "A", "a", 1.5)], "id long, code string, name string, r double").select("id", "code", "name", F.col("r").cast("decimal(5,2)").alias("discount_rate"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    between = [lambda: applier.reprocess(), lambda: applier.resync("car", spark.createDataFrame([], "id long, name string, brand string, price decimal(12,2), created_at timestamp, updated_at timestamp"), 1), lambda: store.compact("cdc_change_audit", 0), lambda: applier.resync("grade", source.unionByName(source.withColumn("id", F.lit(2).cast("long"))), 2), lambda: store.prune()]
    for n, work in enumerate(between, 1):
        write(tmp_path / "in", f"{n}.txt", [event("grade", "c", 10 * n, {"id": str(n + 100), **grade})])
        go(spark, tmp_path, applier)
        assert store.manifest()["batch"] == n - 1
        work()
    write(tmp_path / "in", "9.txt", [event("grade", "c", 99, {"id": "199", **grade})])
    go(spark, tmp_path, applier)
    rows = {r["id"]: r["deleted"] for r in store.read("grade").collect()}
    assert {k for k in rows if k > 100} == {101, 102, 103, 104, 105, 199} and not rows[105] and not rows[199] and not rows[1]
    assert rows[101] and store.read("cdc_change_audit").count() == 0  # the resync found them gone; inserts are not audited
