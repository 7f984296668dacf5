"""Alert rules as data: a condition over a metric and how long it must hold.

Metrics come as (metric, labels, ts, value), each exporter sampled at instants of its own. Rules are looked at
on a grid: at each multiple of ``every`` seconds a series has the value of its last sample within five minutes,
and a window holds the samples of the time before. A rule names its metric, what is made of it first (the
value itself, its increase or its number of changes over a window), a comparison, the time for which it must
hold, and perhaps a gate: another rule that must hold at the same instant. Where two metrics or a gate are
joined, it is on the instant and the labels in ``on``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import timeseries as S

MIB = 1 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    test: str
    hold: int = 0
    make: str = "value"
    window: int = 0
    minus: str | None = None
    total: bool = False
    gate: Rule | None = None


# fixed values: what is compared, with which limit, and for how many seconds
LAG_TRUSTED = Rule("clock", "clock_skew_seconds", "abs(value) <= 0.5")
LAG_UNTRUSTED = Rule("clock", "clock_skew_seconds", "abs(value) > 0.5")
FLOWING = Rule("flow", "events_total", "value / 900 > 0", make="increase", window=900, total=True)
IDLE = Rule("idle", "events_total", "value / 1800 < 0.01", make="increase", window=1800, total=True)

RULES = (
    Rule("service_down", "up", "value = 0", 60),
    Rule("restarts", "start_time", "value > 3", 60, make="changes", window=900),
    Rule("capture_gap", "capture_gap", "value = 1", 60),
    Rule("checkpoint_behind_slot", "checkpoint_lsn", "value < 0", 60, minus="slot_restart_lsn"),
    Rule("halts", "halts_total", "value > 0", make="increase", window=600),
    Rule("slot_inactive", "slot_active", "value = 0", 120),
    Rule("wal_unreserved", "wal_status", "value >= 2", 60),
    Rule("wal_lost", "wal_status", "value = 3"),
    Rule("slot_lag_high", "slot_lag_bytes", f"value > {512 * MIB}", 300),
    Rule("slot_lag_critical", "slot_lag_bytes", f"value > {2048 * MIB}", 60),
    Rule("lag_over_goal", "lag_max_seconds", "value > 5", 120, gate=LAG_TRUSTED),
    Rule("lag_unverifiable", "lag_max_seconds", "value > 5", 120, gate=LAG_UNTRUSTED),
    Rule("clock_skew", "clock_skew_seconds", "abs(value) > 0.5", 300),
    Rule("db_clock_skew", "db_epoch", "abs(value) > 0.5", 300, make="since"),
    Rule("dead_letters", "dlq_pending", "value > 0", 300),
    Rule("orphans", "orphan_rows", "value > 0", 600),
    Rule("slot_stuck", "slot_confirmed_lsn", "value = 0", 900, make="increase", window=900, gate=FLOWING),
    Rule("checkpoint_ahead", "checkpoint_lsn", f"value > {1024 * MIB}", 600, minus="slot_confirmed_lsn"),
    Rule("idle_stuck", "slot_confirmed_lsn", "value = 0", 1800, make="increase", window=1800, gate=IDLE),
)
#: What is made over a window; anything else is made of single samples.
WINDOWED = ("increase", "changes")
#: Seconds a metric must be absent, free disk must be short, and row counts must differ.
ABSENT_HOLD, DISK_HOLD, MISMATCH_HOLD = 60, 300, 600


def series_of(metrics: DataFrame, names: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """(metric, series, ts, value) with a column for each label in on; all labels as one comparable text."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    own = [F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).alias(k) for k in on]
    return metrics.filter(F.col("metric").isin(*names)).select("metric", text.alias("series"), *own, "ts", "value")


def made(rows: DataFrame, make: str, window: int, on: tuple[str, ...] = (), every: int = 60) -> DataFrame:
    """(metric, series, on, ts, value): what is made of samples before they are compared, at each instant of the grid."""
    by = ["metric", "series", *on]
    if make in WINDOWED:
        rows = S.over_window(rows, by, window, every).withColumn("value", F.col(make).cast("double"))
    else:
        if make == "since":
            rows = rows.withColumn("value", F.col("value") - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
        rows = S.evaluated(rows, by, every)
    return rows.select(*by, "ts", "value")


def less(rows: DataFrame, one: str, other: str, on: tuple[str, ...] = ()) -> DataFrame:
    """The greatest series of one metric less that of another at the instants of a grid, told by the labels in on."""
    top = rows.groupBy("ts", *on).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in ((one, "a"), (other, "b"))])
    top = top.filter("a is not null and b is not null")
    text = F.to_json(F.struct(*on)) if on else F.lit("{}")
    return top.select(F.lit(one).alias("metric"), text.alias("series"), *on, "ts", (F.col("a") - F.col("b")).alias("value"))


def _told(found: DataFrame, rules: list[Rule], on: tuple[str, ...]) -> DataFrame:
    """(alert, hold, gate, series, on, ts) of the instants at which rules are met by what is made for them."""
    told = [F.struct(F.lit(r.metric).alias("of"), F.lit(r.make).alias("make"), F.lit(r.window).alias("window"), F.lit(r.name).alias("alert"), F.lit(r.hold).alias("hold"), F.lit(r.gate and f"{r.gate}").cast("string").alias("gate"), F.expr(r.test).alias("ok")) for r in rules]
    met = F.filter(F.array(*told), lambda r: r["ok"] & (r["of"] == F.col("metric")) & (r["make"] == F.col("make")) & (r["window"] == F.col("window")))
    return found.select("series", *on, "ts", F.explode(met).alias("r")).select("r.alert", "r.hold", "r.gate", "series", *on, "ts")


def _made(rows: DataFrame, rules: list[Rule], on: tuple[str, ...], every: int) -> DataFrame:
    """(metric, series, on, make, window, ts, value) of what such rules compare, each metric gone through once."""
    ways = sorted({(r.metric, r.make, r.window) for r in rules})
    own = F.filter(F.array(*[F.struct(F.lit(m).alias("of"), F.lit(k).alias("make"), F.lit(w).alias("window")) for m, k, w in ways]), lambda w: w["of"] == F.col("metric"))
    by = ["metric", "series", *on, "make", "window"]
    each = rows.filter(F.col("metric").isin(*{m for m, _, _ in ways})).withColumn("_w", F.explode(own)).select("metric", "series", *on, "_w.make", "_w.window", "ts", "value")
    if rules[0].make in WINDOWED:
        found = S.over_window(each, by, F.col("window"), every).withColumn("value", F.when(F.col("make") == "changes", F.col("changes").cast("double")).otherwise(F.col("increase")))
    else:
        found = S.evaluated(each.withColumn("value", F.when(F.col("make") == "since", F.col("value") - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).otherwise(F.col("value"))), by, every)
    return found.select(*by, "ts", "value")


def all_fired(metrics: DataFrame, rules=RULES, every: int = 60, on: tuple[str, ...] = ()) -> DataFrame:
    """(alert, series, began, ended) of the times rules fired, on a grid of ``every`` seconds.

    The samples of all rules of a kind are gone through once: rules are rows that what is made of the samples meets.
    Only instants at which a rule is met are kept; on a grid those of a run follow each other by ``every`` seconds.
    """
    gates = list(dict.fromkeys(r.gate for r in rules if r.gate))
    names = sorted({n for r in [*rules, *gates] for n in (r.metric, r.minus) if n})
    rows = series_of(metrics, names, on)

    def groups(some) -> list[tuple[DataFrame, list[Rule]]]:
        """What is made for rules, by kind: windows, values, and each pair of metrics."""
        kinds: dict[tuple, list[Rule]] = {}
        for r in some:
            kinds.setdefault((r.make in WINDOWED, r.minus and (r.metric, r.minus, r.make, r.window)), []).append(r)
        out = []
        for (_, pair), own in kinds.items():
            if pair:
                found = made(rows.filter(F.col("metric").isin(*pair[:2])), pair[2], pair[3], on, every)
                out.append((less(found, *pair[:2], on).withColumns({"make": F.lit(pair[2]), "window": F.lit(pair[3])}), own))
            else:
                out.append((_made(rows, own, on, every), own))
        return out

    parts = [(_told(found, own, on), gated) for gated in (False, True) for found, own in groups(r for r in rules if bool(r.gate) == gated)]
    opened = None
    for g in gates:
        [(of, _)] = groups([g])
        of = of.groupBy("ts", *on).agg(F.sum("value").alias("value")) if g.total else of
        one = of.filter(F.expr(g.test)).select(F.lit(f"{g}").alias("gate"), "ts", *on)
        opened = one if opened is None else opened.unionByName(one)
    out = None
    for part, gated in parts:
        one = part.join(opened, ["gate", "ts", *on], "left_semi") if gated else part
        out = one.select("alert", "hold", "series", "ts") if out is None else out.unionByName(one.select("alert", "hold", "series", "ts"))
    return S.held_for(out, ["alert", "series"], F.lit(True), F.col("hold"), every)


def fired(metrics: DataFrame, rule: Rule, every: int = 60, on: tuple[str, ...] = ()) -> DataFrame:
    """(alert, series, began, ended) of the times one rule fired."""
    return all_fired(metrics, (rule,), every, on)


def absent_metric(metrics: DataFrame, name: str, hold: int = ABSENT_HOLD, every: int = 60) -> DataFrame:
    """(alert, began, ended) of the times at which others were seen and this metric was not, for as long as that."""
    # of the samples before an instant the last one of each metric is enough, at it and at all that follow
    step = every * 1_000_000
    place = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / step)
    last = metrics.groupBy("metric", place.alias("_g")).agg(F.max("ts").alias("ts"))
    seen = S.evaluated(last.select((F.col("metric") == name).alias("own"), "ts", F.lit(1.0).alias("value")), ["own"], every)
    at = seen.groupBy("ts").agg(F.count_if("own").alias("n")).filter("n = 0").withColumn("alert", F.lit(f"absent_{name}"))
    return S.held_for(at, ["alert"], F.lit(True), hold, every)


def disk_runs_out(metrics: DataFrame, available: str = "disk_available_bytes", written: str = "wal_bytes_total", window: int = 600, least: int = 3600, on: tuple[str, ...] = (), every: int = 60) -> DataFrame:
    """(on, ts, seconds_left, short): how long the free disk lasts at the present rate of log."""
    rows = series_of(metrics, [available, written], on)
    free = made(rows.filter(F.col("metric") == available), "value", 0, on, every).groupBy(*on, "ts").agg(F.max("value").alias("free"))
    speed = made(rows.filter(F.col("metric") == written), "increase", window, on, every).groupBy(*on, "ts").agg(F.max(F.col("value") / window).alias("speed"))
    left = F.col("free") / F.greatest(F.col("speed"), F.lit(1.0))
    return free.join(speed, [*on, "ts"]).select(*on, "ts", left.alias("seconds_left"), (left < least).alias("short"))


def disk_alert(metrics: DataFrame, hold: int = DISK_HOLD, every: int = 60, on: tuple[str, ...] = (), **options) -> DataFrame:
    """(alert, on, began, ended) of the times the disk was short for as long as that."""
    short = disk_runs_out(metrics, on=on, every=every, **options).filter("short").withColumn("alert", F.lit("disk"))
    return S.held_for(short, ["alert", *on], F.lit(True), hold, every)


def row_drift(metrics: DataFrame, source: str = "source_rows", target: str = "target_rows", letters: str = "dlq_rows", every: int = 60) -> DataFrame:
    """(table_name, ts, value): by how much row counts differ beyond the pending letters, on a grid.

    A table without letters has none; one that either side does not count at a time has no row for it.
    """
    label = F.try_element_at("labels", F.lit("table_name"))
    pending = (F.col("metric") != letters) | (F.try_element_at("labels", F.lit("status")) == "PENDING")
    rows = metrics.filter(F.col("metric").isin(source, target, letters) & pending).select("metric", label.alias("table_name"), F.to_json("labels").alias("series"), "ts", "value")
    sums = S.evaluated(rows, ["metric", "table_name", "series"], every).groupBy("table_name", "ts").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in ((source, "s"), (target, "t"), (letters, "l"))])
    return sums.filter("s is not null and t is not null").select("table_name", "ts", (F.abs(F.col("s") - F.col("t")) - F.coalesce("l", F.lit(0.0))).alias("value"))


def reconcile_mismatch(metrics: DataFrame, hold: int = MISMATCH_HOLD, every: int = 60) -> DataFrame:
    """(alert, table_name, began, ended) of the times row counts differed unexplained for as long as that."""
    drift = row_drift(metrics, every=every).withColumn("alert", F.lit("reconcile_mismatch"))
    return S.held_for(drift, ["alert", "table_name"], F.col("value") != 0, hold, every)


def recorded(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Several exporters' metrics under one name each: name -> (samples, what to take as the value)."""
    out = None
    for name, (df, value) in parts.items():
        one = df.select(F.lit(name).alias("metric"), "labels", "ts", F.expr(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
