"""Queries over series of samples: as-of alignment, evaluation on a grid, alert rules over metrics made from events.

Every user of the event table stands for a pipeline. Its n-th event makes samples at n * 100 seconds, a
second or more apart for each exporter and pipeline, so no two exporters share an instant; values come from
what the pipeline's events were.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeseries as S
from tidemark.plans import alerts
from tidemark.query_base import query, t

T0 = 1704067200
#: Of a pipeline's events: k its number, c and h the errors among the last five and three, s sign-ups, v views and clicks, e errors so far.
FACTS_SQL = """f as (select user_id, event_type, row_number() over w - 1 as k, count(*) filter (where event_type = 'error') over (w rows 4 preceding) as c, count(*) filter (where event_type = 'error') over (w rows 2 preceding) as h,
  count(*) filter (where event_type = 'signup') over w as s, count(*) filter (where event_type in ('view', 'click')) over w as v, count(*) filter (where event_type = 'error') over w as e from events window w as (partition by user_id order by event_id))"""
#: Metric, its labels beside the pipeline, by how many seconds its exporter comes later, value in the SQL of both sides (null: no sample).
EXPORTED = (
    ("up", "", 0, "case when c >= 3 then 0 else 1 end"), ("start_time", "", 0, "s"), ("capture_gap", "", 0, "case when h >= 2 then 1 else 0 end"),
    ("checkpoint_lsn", "", 3, "k * 1000000 + case when (floor(k / 12.0) + user_id) % 5 = 0 then 2000000000 else 0 end - case when c >= 3 then 5000000 else 0 end"),
    ("slot_restart_lsn", "", 37, "k * 1000000 - 1500000"), ("halts_total", "", 3, "floor(e / 8.0)"), ("slot_active", "", 37, "case when h >= 2 then 0 else 1 end"), ("wal_status", "", 37, "least(c, 3)"), ("slot_lag_bytes", "", 37, "c * c * 150000000"),
    ("lag_max_seconds", "", 3, "c * 2.0"), ("clock_skew_seconds", "", 11, "case when (floor(k / 9.0) + user_id) % 4 = 0 then 0.9 else 0.1 end"), ("db_epoch", "", 59, f"{T0 + 59} + k * 100 + user_id % 17 + case when (floor(k / 7.0) + user_id) % 6 = 0 then 2 else 0 end"),
    ("dlq_pending", "", 37, "greatest(c - 1, 0)"), ("orphan_rows", "", 61, "case when (floor(k / 20.0) + user_id) % 4 = 0 then 1 else 0 end"), ("slot_confirmed_lsn", "", 37, "case when (floor(k / 45.0) + user_id) % 3 = 0 then floor(k / 45.0) * 45 else k end * 1000000"),
    ("events_total", "car", 3, "case when (floor(k / 45.0) + user_id) % 2 = 0 then 0 else v * 90 end"), ("events_total", "grade", 3, "case when (floor(k / 45.0) + user_id) % 2 = 0 then 0 else e end"),
    ("disk_available_bytes", "", 71, "1000000000 - k * 1000000"), ("wal_bytes_total", "", 37, "v * 70000000"), ("sometimes", "", 5, "case when floor(k / 10.0) % 3 <> 0 then 1 end"),
)
METRICS_SQL = f"{FACTS_SQL}, x as (select * from (" + " union all ".join(
    f"""select '{n}' as metric, user_id::varchar as pipeline, '{{"pipeline":"' || user_id || '"{f',"table":"{table}"' if table else ''}}}' as series, timestamp '2024-01-01 00:00:00' + to_seconds(k * 100 + user_id % 17 + {later}) as ts, ({v})::double as value from f""" for n, table, later, v in EXPORTED
) + ") where value is not null)"
ON = ("pipeline",)


def facts(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    error = F.col("event_type") == "error"
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "events").select(
        "user_id", "event_type", (F.row_number().over(w) - 1).alias("k"), F.count_if(error).over(w.rowsBetween(-4, 0)).alias("c"), F.count_if(error).over(w.rowsBetween(-2, 0)).alias("h"),
        F.count_if(F.col("event_type") == "signup").over(so_far).alias("s"), F.count_if(F.col("event_type").isin("view", "click")).over(so_far).alias("v"), F.count_if(error).over(so_far).alias("e"),
    )


def _instant(later: int):
    return F.timestamp_seconds(F.lit(T0 + later) + F.col("k") * 100 + F.col("user_id") % 17).cast("timestamp_ntz")


def metrics(spark, d) -> DataFrame:
    """(metric, labels, ts, value) of all exporters.

    Each exporter is a branch of its own, so what asks for a few metrics makes the samples of those alone; the facts
    meet by user once for all.
    """
    events, out = facts(spark, d), None
    for n, table, later, v in EXPORTED:
        labels = [F.lit("pipeline"), F.col("user_id").cast("string")] + ([F.lit("table"), F.lit(table)] if table else [])
        value = F.expr(re.sub(r"/ (\d+)\.0", r"/ \1e0", v)).cast("double")  # doubles: decimals are divided digit by digit
        one = events.select(F.lit(n).alias("metric"), F.create_map(*labels).alias("labels"), _instant(later).alias("ts"), value.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.filter("value is not null")


def _grid_sql(own: str, by: str) -> str:
    """own (by, ts, value) at each minute, by an as-of join on a grid of each series; no sample older than five minutes."""
    grid = f"select {by}, unnest(range(epoch_us(min(ts)) // 60000000 * 60000000, epoch_us(max(ts)) + 300000000, 60000000)) as g from ({own}) group by {by}"
    on = " and ".join(f"g.{c.strip()} = s.{c.strip()}" for c in by.split(","))
    return f"select {', '.join(f'g.{c.strip()}' for c in by.split(','))}, make_timestamp(g.g) as ts, s.value from ({grid}) g asof join (select *, epoch_us(ts) as us from ({own})) s on {on} and g.g >= s.us where g.g - s.us < 300000000"


def _over_sql(own: str, by: str, seconds: int, what: str = "increase") -> str:
    """Increase, changes or delta of own over the time before each minute, from at least two samples."""
    value = {"increase": "sum(case when p is null then 0 when value >= p then value - p else value end)", "changes": "count(*) filter (where p <> value)", "delta": "max_by(value, us) - min_by(value, us)"}[what]
    on = " and ".join(f"g.{c.strip()} = s.{c.strip()}" for c in by.split(","))
    return f"""select {by}, make_timestamp(g) as ts, ({value})::double as value from (
  select {', '.join(f'g.{c.strip()}' for c in by.split(','))}, g.g, s.us, s.value, lag(s.value) over (partition by {', '.join(f'g.{c.strip()}' for c in by.split(','))}, g.g order by s.us) as p
  from (select {by}, unnest(range(epoch_us(min(ts)) // 60000000 * 60000000, epoch_us(max(ts)) + {seconds} * 1000000, 60000000)) as g from ({own}) group by {by}) g
  join (select *, epoch_us(ts) as us from ({own})) s on {on} and s.us <= g.g and s.us > g.g - {seconds} * 1000000) group by {by}, g having count(*) >= 2"""


def _compared_sql(r: alerts.Rule) -> str:
    """What a rule compares, as SQL: (series, pipeline, ts, value)."""
    def of(metric: str) -> str:
        own = f"select series, pipeline, ts, {'value - epoch_us(ts) / 1e6 as value' if r.make == 'since' else 'value'} from x where metric = '{metric}'"
        return _over_sql(own, "series, pipeline", r.window, r.make) if r.make in ("increase", "changes") else _grid_sql(own, "series, pipeline")

    if r.minus:
        return f"""select '{{"pipeline":"' || pipeline || '"}}' as series, pipeline, a.ts, a.v - b.v as value from (select pipeline, ts, max(value) as v from ({of(r.metric)}) group by all) a join (select pipeline, ts, max(value) as v from ({of(r.minus)}) group by all) b using (pipeline, ts)"""
    return f"select '' as series, pipeline, ts, sum(value) as value from ({of(r.metric)}) group by all" if r.total else of(r.metric)


def _held_sql(rows: str, labels: str) -> str:
    """Runs of rows (labels, ts, ok, hold) on which ok holds as long as hold, a minute apart at most."""
    return f"""select {labels}, min(ts) as began, max(ts) as ended from (select *, sum(case when not ok or not coalesce(was, false) or ts - was_at > interval '60 seconds' then 1 else 0 end) over (partition by {labels} order by ts rows unbounded preceding) as run
  from (select *, lag(ok) over (partition by {labels} order by ts) as was, lag(ts) over (partition by {labels} order by ts) as was_at from ({rows}))) where ok group by {labels}, run having epoch_us(max(ts)) - epoch_us(min(ts)) >= max(hold) * 1000000"""


def _rules_sql() -> str:
    parts = []
    for r in alerts.RULES:
        gate = f" and (pipeline, ts) in (select (pipeline, ts) from ({_compared_sql(r.gate)}) where {r.gate.test})" if r.gate else ""
        parts.append(f"select '{r.name}' as alert, series, ts, coalesce({r.test}, false){gate} as ok, {r.hold} as hold from ({_compared_sql(r)})")
    return f"with {METRICS_SQL} " + _held_sql(" union all ".join(parts), "alert, series")


# --- alignment ---------------------------------------------------------------------------------------

SERIES_SQL = """a as (select user_id, ts, value as v from events where event_type = 'click'),
b as (select user_id, ts + to_seconds(7 + user_id % 5) as ts, value from events where event_type = 'view')"""


def _clicks_and_views(spark, d):
    e = t(spark, d, "events")
    shift = F.make_dt_interval(secs=(F.lit(7) + F.col("user_id") % 5).cast("decimal(18,6)"))
    return e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("v")), e.filter("event_type = 'view'").select("user_id", (F.col("ts") + shift).alias("ts"), "value")


@query(f"with {SERIES_SQL} select a.user_id, a.ts, a.v, b.value, b.ts as value_at from a asof join b on a.user_id = b.user_id and a.ts >= b.ts where a.ts - b.ts < interval '6 hours'")
def asof_join(spark, d):
    """Each click with the last view of its user, whose exporter is some seconds late, if it is under six hours old."""
    a, b = _clicks_and_views(spark, d)
    return S.asof(a, b, ["user_id"], 6 * 3600)


@query(f"with {METRICS_SQL} " + _grid_sql("select series, ts, value from x where metric = 'slot_lag_bytes'", "series"))
def grid_values(spark, d):
    """Slot lags at each minute."""
    return S.evaluated(alerts.series_of(metrics(spark, d), ["slot_lag_bytes"]), ["series"])


@query(f"with {METRICS_SQL}, i as ({_over_sql("select series, ts, value from x where metric = 'events_total'", "series", 900)}), c as ({_over_sql("select series, ts, value from x where metric = 'events_total'", "series", 900, "changes")}), g as ({_over_sql("select series, ts, value from x where metric = 'events_total'", "series", 900, "delta")}) select series, ts, round(i.value / 900, 9) as rate, c.value::bigint as changes, g.value as delta from i join c using (series, ts) join g using (series, ts)")
def grid_rates(spark, d):
    """Rate, changes and difference of counters over a quarter of an hour, at each minute."""
    x = S.over_window(alerts.series_of(metrics(spark, d), ["events_total"]), ["series"], 900)
    return x.select("series", "ts", F.round(F.col("increase") / 900, 9).alias("rate"), F.col("changes").cast("bigint").alias("changes"), "delta")


BEHIND = next(r for r in alerts.RULES if r.name == "checkpoint_behind_slot")


@query(f"with {METRICS_SQL} select pipeline, ts, value from ({_compared_sql(BEHIND)})")
def grid_difference(spark, d):
    """Checkpoint less slot restart of each pipeline at each minute, two exporters that never share an instant."""
    rows = alerts.made(alerts.series_of(metrics(spark, d), [BEHIND.metric, BEHIND.minus], ON), "value", 0, ON)
    return alerts.less(rows, BEHIND.metric, BEHIND.minus, ON).select("pipeline", "ts", "value")


@query(f"with {METRICS_SQL}, a as ({_grid_sql("select pipeline, ts, value from x where metric = 'sometimes'", 'pipeline')}), b as ({_grid_sql("select pipeline, ts, -value as value from x where metric = 'up'", 'pipeline')}) select pipeline, ts, value from a union all select pipeline, ts, value from b where (pipeline, ts) not in (select (pipeline, ts) from a)")
def grid_fallback(spark, d):
    """One metric where it is seen, else another with the same labels at that minute."""
    rows = alerts.made(alerts.series_of(metrics(spark, d), ["sometimes", "up"], ON), "value", 0, ON)
    a = rows.filter("metric = 'sometimes'").select("pipeline", "ts", "value")
    b = rows.filter("metric = 'up'").select("pipeline", "ts", (-F.col("value")).alias("value"))
    return S.otherwise(a, b, ["pipeline", "ts"])


# --- alerts ------------------------------------------------------------------------------------------


@query(_rules_sql())
def alert_rules(spark, d):
    return alerts.all_fired(metrics(spark, d), on=ON)


DISK_SQL = f"""with {METRICS_SQL}, y as (select pipeline, ts, f.value / greatest(w.value / 600, 1) as left_s from ({_grid_sql("select pipeline, ts, value from x where metric = 'disk_available_bytes'", 'pipeline')}) f
  join ({_over_sql("select pipeline, ts, value from x where metric = 'wal_bytes_total'", 'pipeline', 600)}) w using (pipeline, ts))"""


@query(DISK_SQL + " select pipeline, ts, round(left_s, 6) as seconds_left, left_s < 3600 as short from y")
def disk_headroom(spark, d):
    return alerts.disk_runs_out(metrics(spark, d), on=ON).withColumn("seconds_left", F.round("seconds_left", 6))


@query(DISK_SQL + " " + _held_sql("select 'disk' as alert, pipeline, ts, left_s < 3600 as ok, 300 as hold from y", "alert, pipeline"))
def alert_disk(spark, d):
    return alerts.disk_alert(metrics(spark, d), on=ON)


ABSENT_SQL = "select 'absent_{0}' as alert, ts, max(own) = 0 as ok, 60 as hold from ({1}) group by ts"


def _absent_sql(name: str) -> str:
    own = _grid_sql(f"select distinct case when metric = '{name}' then 1 else 0 end as own, ts, 1.0 as value from x", "own")
    return ABSENT_SQL.format(name, own)


@query(f"with {METRICS_SQL} " + _held_sql(_absent_sql("no_such") + " union all " + _absent_sql("sometimes"), "alert"))
def alert_absent(spark, d):
    """A metric that never occurred and one that stops for a while."""
    m = metrics(spark, d)
    return alerts.absent_metric(m, "no_such").unionByName(alerts.absent_metric(m, "sometimes"))


#: Row counts of both sides and letters of each pipeline's table: metric, status, by how many seconds later, value.
COUNTED = (
    ("source_rows", "", 0, "100 + user_id"), ("target_rows", "", 29, "100 + user_id - case when (floor(k / 8.0) + user_id) % 5 = 0 then 3 else 0 end"),
    ("dlq_rows", "PENDING", 43, "case when (floor(k / 8.0) + user_id) % 10 = 0 then 3 else 0 end"), ("dlq_rows", "RESOLVED", 43, "e"),
)
COUNTED_SQL = f"with {FACTS_SQL}, x as (" + " union all ".join(f"select '{n}' as metric, '{status}' as status, 't' || user_id as table_name, timestamp '2024-01-01 00:00:00' + to_seconds(k * 100 + user_id % 17 + {later}) as ts, ({v})::double as value from f" for n, status, later, v in COUNTED) + ")"


@query(COUNTED_SQL + f""", y as (select table_name, ts, sum(value) filter (where metric = 'source_rows') as s, sum(value) filter (where metric = 'target_rows') as t, coalesce(sum(value) filter (where metric = 'dlq_rows'), 0) as l
  from ({_grid_sql("select metric, table_name, ts, value from x where status <> 'RESOLVED'", 'metric, table_name')}) group by all)
""" + _held_sql("select 'reconcile_mismatch' as alert, table_name, ts, abs(s - t) - l <> 0 as ok, 600 as hold from y where s is not null and t is not null", "alert, table_name"))
def alert_reconcile(spark, d):
    made = [F.struct(F.lit(n).alias("metric"), F.create_map(F.lit("table_name"), F.concat(F.lit("t"), "user_id"), F.lit("status"), F.lit(status)).alias("labels"), _instant(later).alias("ts"), F.expr(v).cast("double").alias("value")) for n, status, later, v in COUNTED]
    return alerts.reconcile_mismatch(facts(spark, d).select(F.explode(F.array(*made)).alias("r")).select("r.*"))


@query(f"with {METRICS_SQL} select 'slot:lag' as metric, pipeline, ts, value from x where metric = 'slot_lag_bytes' union all select 'pipeline:behind_seconds', pipeline, ts, value * 1000 from x where metric = 'lag_max_seconds'")
def recording_rules(spark, d):
    """Two exporters' metrics under names of the rules' own."""
    m = metrics(spark, d)
    parts = {"slot:lag": (m.filter("metric = 'slot_lag_bytes'"), "value"), "pipeline:behind_seconds": (m.filter("metric = 'lag_max_seconds'"), "value * 1000")}
    return alerts.recorded(parts).select("metric", F.element_at("labels", "pipeline").alias("pipeline"), "ts", "value")
