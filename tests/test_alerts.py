"""Alert rules, as-of alignment and evaluation on a grid: made-up samples with known outcomes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import timeseries as S
from tidemark.plans import alerts

#: Samples a minute over four hours: (metric, labels, value as an expression of the minute m).
SAMPLES = (
    ("up", "{}", "if(m between 10 and 14, 0, 1)"), ("start_time", "{}", "if(m < 100, floor(m / 3), 33)"), ("capture_gap", "{}", "if(m between 50 and 60, 1, 0)"), ("checkpoint_lsn", "{}", "m * 1000 - if(m in (30, 31, 90), 100000, 0) + if(m between 180 and 200, 2e9, 0)"),
    ("slot_restart_lsn", "{}", "m * 900"), ("halts_total", '{"reason":"ratio"}', "if(m < 40, 0, if(m < 80, 2, 1))"), ("halts_total", '{"reason":"verdict"}', "if(m < 200, 0, 1)"), ("slot_active", "{}", "if(m between 20 and 25, 0, 1)"),
    ("wal_status", "{}", "if(m between 70 and 73, 2, if(m = 90, 3, 0))"), ("slot_lag_bytes", "{}", "if(m between 60 and 80, 6e8, 1000) * if(m between 75 and 79, 10, 1)"), ("lag_max_seconds", '{"table":"car"}', "if(m between 30 and 40, 9, 1)"),
    ("lag_max_seconds", '{"table":"grade"}', "if(m between 120 and 121, 9, 1)"), ("clock_skew_seconds", "{}", "if(m between 35 and 60, 0.9, 0.1)"), ("db_epoch", "{}", "1704067200 + m * 60 + if(m = 5 or m between 10 and 16, 2, 0)"),
    ("dlq_pending", "{}", "if(m between 85 and 95, 4, 0)"), ("orphan_rows", "{}", "if(m > 100, 1, 0)"), ("slot_confirmed_lsn", "{}", "if(m between 40 and 70, 40000, if(m >= 130, 130000, m * 1000))"),
    ("events_total", '{"table":"car"}', "if(m < 130, m * 50, 6500)"), ("events_total", '{"table":"grade"}', "if(m < 130, m, 130 + floor((m - 130) / 20))"), ("disk_available_bytes", "{}", "1e9 - m * 1e6"), ("wal_bytes_total", "{}", "if(m < 150, m * 3e7, 4.5e9 + m)"),
    ("source_rows", '{"table_name":"car"}', "100 + m"), ("target_rows", '{"table_name":"car"}', "100 + m - if(m between 20 and 45, 3, 0) - if(m between 60 and 75, 2, 0)"), ("source_rows", '{"table_name":"grade"}', "50"), ("target_rows", '{"table_name":"grade"}', "50 - if(m between 150 and 165, 1, 0)"),
    ("dlq_rows", '{"status":"PENDING","table_name":"car"}', "if(m between 20 and 45, 3, 0)"), ("dlq_rows", '{"status":"RESOLVED","table_name":"car"}', "7"), ("sometimes", "{}", "if(m between 100 and 110, null, 1)"),
)

START = "2024-01-01 00:00:00"


def minutes(spark, late=0):
    """Samples of all metrics, each metric so many seconds later than the one before."""
    rows = []
    for i, (n, k, v) in enumerate(SAMPLES):
        at = F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("m") * 60 + i * late % 60).cast("timestamp_ntz")
        off = f" + {i * late % 60}" if n == "db_epoch" else ""
        rows.append(F.struct(F.lit(n).alias("metric"), F.from_json(F.lit(k), "map<string,string>").alias("labels"), at.alias("ts"), F.expr(f"cast({v}{off} as double)").alias("value")))
    return spark.range(240).withColumnRenamed("id", "m").select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("value is not null")


def test_alert_rules_fire_once_or_twice(spark):
    rows = alerts.all_fired(minutes(spark)).collect()
    fired = {r["alert"] for r in rows}
    assert {"service_down", "restarts", "checkpoint_behind_slot", "checkpoint_ahead", "halts", "slot_lag_critical", "lag_over_goal", "lag_unverifiable", "slot_stuck", "idle_stuck", "db_clock_skew"} <= fired
    began = {(r["alert"], r["series"]): r["began"].strftime("%H:%M") for r in rows}
    assert began["checkpoint_behind_slot", "{}"] == "00:30" and began["db_clock_skew", "{}"] == "00:10" and began["idle_stuck", "{}"] == "02:39"
    assert ("lag_over_goal", '{"table":"grade"}') not in began


def test_the_same_rules_fire_when_no_two_exporters_share_an_instant(spark):
    same, apart = ({r["alert"] for r in alerts.all_fired(minutes(spark, late)).collect()} for late in (0, 7))
    assert same == apart


def test_checkpoint_two_seconds_from_the_slot(spark):
    """An hour far behind, scraped two seconds apart."""
    one = spark.range(240).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 15).cast("timestamp_ntz").alias("ts"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"))
    m = one.select(F.lit("checkpoint_lsn").alias("metric"), "labels", "ts", F.lit(10.0).alias("value")).unionByName(one.select(F.lit("slot_restart_lsn").alias("metric"), "labels", (F.col("ts") + F.make_dt_interval(secs=F.lit(2).cast("decimal(18,6)"))).alias("ts"), F.lit(1e9).alias("value")))
    rows = alerts.fired(m, next(r for r in alerts.RULES if r.name == "checkpoint_behind_slot")).collect()
    assert len(rows) == 1 and rows[0]["ended"] - rows[0]["began"] >= timedelta(minutes=59)


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, s double, value double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).cast("timestamp_ntz").alias("ts"), "value")


def seconds_of(ts):
    return (ts - datetime(1970, 1, 1)).total_seconds()


def test_asof_looks_back_five_minutes(spark):
    right = series(spark, [("a", 100.0, 1.0), ("a", 100.0, 3.0), ("a", 350.5, 2.0), ("a", 360.0, None), ("b", 0.0, 9.0)])
    left = series(spark, [("a", t, 0.0) for t in (99.9, 100.0, 350.4, 350.5, 399.0, 650.499999, 650.5, 10_000.0)] + [("b", 299.0, 0.0), ("c", 1.0, 0.0)]).withColumnRenamed("value", "own")
    got = {(r["k"], seconds_of(r["ts"])): r["value"] for r in S.asof(left, right, ["k"], 300).collect()}
    assert got == {("a", 100.0): 3.0, ("a", 350.4): 3.0, ("a", 350.5): 2.0, ("a", 399.0): 2.0, ("a", 650.499999): 2.0, ("b", 299.0): 9.0}


def test_grid_and_windows(spark):
    x = series(spark, [("a", 10.0, 1.0), ("a", 70.0, 5.0), ("a", 70.0, 4.0), ("a", 500.0, 2.0), ("b", 60.0, 7.0)])
    got = {(r["k"], int(seconds_of(r["ts"]))): r["value"] for r in S.evaluated(x, ["k"]).collect()}
    assert got == {("a", 60): 1.0} | {("a", t): 5.0 for t in (120, 180, 240, 300, 360)} | {("a", t): 2.0 for t in range(540, 800, 60)} | {("b", t): 7.0 for t in range(60, 360, 60)}
    over = {(r["k"], int(seconds_of(r["ts"]))): (r["increase"], r["changes"], r["delta"]) for r in S.over_window(x, ["k"], 480).collect()}
    assert over["a", 120] == (4.0, 2, 4.0) and over["a", 540] == (3.0, 2, -2.0) and ("b", 60) not in over and ("a", 600) not in over


def test_a_long_series_is_shared_by_tasks(spark):
    """One series of 20,000 samples: no group that is sorted together holds more than a few of its spans."""
    x = spark.range(20_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 15).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    out = S.asof(x.withColumnRenamed("value", "own"), x, ["k"], 300)
    assert out.count() == 20_000 and out.filter("own <> value").count() == 0
    assert "hashpartitioning(k" in out._jdf.queryExecution().toString() and "_span" in out._jdf.queryExecution().toString()


def test_samples_are_told_once_and_only_those_of_metrics_asked_for(spark):
    """What is made of one metric neither makes the samples of others nor offers a sample to instants that see a later one."""
    from conftest import SF

    from tidemark.queries_series import metrics

    one = metrics(spark, SF).filter("metric = 'up'")
    plan = S.evaluated(one, ["metric"])._jdf.queryExecution().optimizedPlan().toString()
    assert "slot_lag_bytes" not in plan and "Union" not in plan and "Aggregate" not in plan
    assert one.count() == metrics(spark, SF).filter("metric = 'start_time'").count() > 0


def test_grid_against_one_by_one_over_many_spans(spark):
    import random

    r = random.Random(3)
    rows = [("a", round(r.uniform(0, 60_000), 1), float(r.randrange(6))) for _ in range(900)] + [("b", 16 * 300.0 * n - d, n + d) for n in range(1, 6) for d in (0.0, 0.5, 299.0)]
    x = series(spark, rows)
    got = {(q["k"], int(seconds_of(q["ts"]))): q["value"] for q in S.evaluated(x, ["k"]).collect()}
    over = {(q["k"], int(seconds_of(q["ts"]))): (q["increase"], q["changes"], q["delta"]) for q in S.over_window(x.withColumn("w", F.lit(480)), ["k", "w"], F.col("w")).collect()}
    want, wide = {}, {}
    for k in "ab":
        own = sorted((s, v) for name, s, v in rows if name == k)
        for g in range(0, 61_000, 60):
            seen = [v for s, v in own if g - 300 < s <= g]
            if seen:
                want[k, g] = seen[-1]
            seen = [v for s, v in own if g - 480 < s <= g]
            if len(seen) > 1:
                steps = list(zip(seen, seen[1:], strict=False))
                wide[k, g] = (sum(b - a if b >= a else b for a, b in steps), sum(a != b for a, b in steps), seen[-1] - seen[0])
    assert got == want and over == wide
