"""Functions over metric samples: rates, changes, rolling maxima and conditions that must hold on.

A series is told by its label columns; samples have ts and value. Windows look back from each sample and
take those later than ``ts - seconds``; nothing is extrapolated to window edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Writes a DataFrame to a table and reads it again.
Written = Callable[[DataFrame], DataFrame]

#: Seconds for which a sample is seen after its instant.
LOOK_BACK = 300

#: How many times what a sample is seen for are sorted together.
SPANS = 16


def _clock(ts: str) -> Column:
    """Microseconds since the epoch, for exact range frames."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _steps(samples: DataFrame, labels: list[str], ts: str) -> DataFrame:
    by = Window.partitionBy(*labels).orderBy(ts)
    return samples.withColumn("_prev", F.lag("value").over(by)).withColumn("_t", _clock(ts))


def _back(labels: list[str], seconds: int):
    return Window.partitionBy(*labels).orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)


def increase(samples: DataFrame, labels: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """Growth of a counter between the first and the last sample of the window; a drop is a restart from 0."""
    step = F.when(F.col("value") >= F.col("_prev"), F.col("value") - F.col("_prev")).otherwise(F.col("value"))
    rows = _steps(samples, labels, ts).withColumn("_step", F.when(F.col("_prev").isNotNull(), step))
    first = F.first("_step").over(_back(labels, seconds))
    inside = F.sum(F.coalesce("_step", F.lit(0.0))).over(_back(labels, seconds)) - F.coalesce(first, F.lit(0.0))
    return rows.withColumn("increase", inside).drop("_prev", "_t", "_step")


def rate(samples: DataFrame, labels: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """Increase a second over the window."""
    return increase(samples, labels, seconds, ts).withColumn("rate", F.col("increase") / seconds)


def rate_ratio(over: DataFrame, under: DataFrame, labels: list[str], seconds: int, least: float | None = None, ts: str = "ts") -> DataFrame:
    """Rate of one counter over the rate of another at equal times: where that is 0 no row, or with ``least`` no smaller divisor."""
    a = rate(over, labels, seconds, ts).select(*labels, ts, F.col("rate").alias("_a"))
    b = rate(under, labels, seconds, ts).select(*labels, ts, F.col("rate").alias("_b"))
    both = a.join(b, [*labels, ts])
    both = both.filter("_b > 0") if least is None else both.withColumn("_b", F.greatest("_b", F.lit(least)))
    return both.withColumn("ratio", F.col("_a") / F.col("_b")).drop("_a", "_b")


def delta(samples: DataFrame, labels: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """Last minus first value of the window, for gauges."""
    rows = samples.withColumn("_t", _clock(ts))
    return rows.withColumn("delta", F.col("value") - F.first("value").over(_back(labels, seconds))).drop("_t")


def changes(samples: DataFrame, labels: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """How often the value changed between samples of the window."""
    rows = _steps(samples, labels, ts).withColumn("_c", F.when(F.col("_prev") != F.col("value"), 1).otherwise(0))
    w = _back(labels, seconds)
    return rows.withColumn("changes", F.sum("_c").over(w) - F.first("_c").over(w)).drop("_prev", "_t", "_c")


def asof(left: DataFrame, right: DataFrame, labels: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """left with the last value of right at or before its instant, and that sample's own instant (``value_at``).

    A sample is seen for less than ``seconds``; rows that see none are left out. Of samples of one instant the
    greatest value counts. Both sides are dealt by series and spans of that length, a sample going to its own
    span and the next, and sorted together there: a series of any length is shared by many tasks.
    """
    width = seconds * 1_000_000
    rest = [c for c in left.columns if c not in labels]
    mine = left.select(*labels, _clock(ts).alias("_t"), F.lit(1).alias("_kind"), F.floor(_clock(ts) / width).alias("_span"), F.struct(*rest).alias("_row"))
    theirs = right.filter("value is not null").select(*labels, _clock(ts).alias("_t"), F.lit(0).alias("_kind"), F.col(ts).alias("_at"), "value")
    own = F.floor(F.col("_t") / width)
    theirs = theirs.withColumn("_span", F.explode(F.array(own, own + 1)))
    by = Window.partitionBy(*labels, "_span").orderBy("_t", "_kind", "value")
    sample = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_at").alias("at"), "value"))
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_seen", F.last(sample, ignorenulls=True).over(by))
    found = both.filter(F.col("_kind") == 1).filter(F.col("_t") - F.col("_seen.t") < width)
    return found.select(*labels, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_seen.value").alias("value"), F.col("_seen.at").alias("value_at"))


def _on_grid(rows: DataFrame, first: Column, last: Column, every: int) -> DataFrame:
    """rows once for each multiple of so many seconds from first to last (microseconds), as ``_g``."""
    step = every * 1_000_000
    some = rows.withColumns({"_lo": F.ceil(first / step), "_hi": F.floor(last / step)}).filter("_lo <= _hi")
    return some.withColumn("_n", F.explode(F.sequence("_lo", "_hi"))).withColumn("_g", F.col("_n") * step)


def _dealt(rows: DataFrame, width: Column) -> tuple[DataFrame, Column, Column]:
    """rows dealt by spans of ``SPANS`` widths, those that are seen beyond the end of theirs to the next as well; a span's first and last microsecond."""
    span = width * SPANS
    near = rows.withColumn("_span", F.explode(F.sequence(F.floor(F.col("_t") / span), F.floor((F.col("_t") + width - 1) / span))))
    return near, F.col("_span") * span, (F.col("_span") + 1) * span - 1


def _at(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def evaluated(samples: DataFrame, labels: list[str], every: int = 60, seconds: int = LOOK_BACK, ts: str = "ts") -> DataFrame:
    """(labels, ts, value): each series at the multiples of ``every``, as its last sample within ``seconds`` tells.

    Samples are dealt by series and spans of time and sorted there, so a series of any length is shared by tasks. Each
    is then told at the instants before the next one only, so nothing is made that is not kept.
    """
    width = F.lit(seconds).cast("bigint") * 1_000_000
    rows, begin, end = _dealt(samples.filter("value is not null").select(*labels, _clock(ts).alias("_t"), "value"), width)
    after = F.lead("_t").over(Window.partitionBy(*labels, "_span").orderBy("_t", "value"))
    out = _on_grid(rows.withColumn("_after", after), F.greatest("_t", begin), F.least(F.col("_t") + width - 1, F.col("_after") - 1, end), every)
    return out.select(*labels, _at(F.col("_g")).alias(ts), "value")


def over_window(samples: DataFrame, labels: list[str], seconds: int | Column, every: int = 60, ts: str = "ts") -> DataFrame:
    """(labels, ts, increase, changes, delta) over the ``seconds`` before each multiple of ``every`` (a label may say).

    Instants with fewer than two samples in their window have no row. A counter's drop is a restart from 0. Samples are
    dealt by series and spans of time. What a window holds changes when a sample comes and when one goes, so these
    are sorted together, with running sums; the instants between two such changes all see the same.
    """
    width = (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("bigint") * 1_000_000
    rows, begin, end = _dealt(samples.filter("value is not null").select(*labels, _clock(ts).alias("_t"), F.col("value").cast("double").alias("value")), width)
    by = Window.partitionBy(*labels, "_span").orderBy("_t", "value")
    rows = rows.withColumn("_was", F.lag("value").over(by))
    step = F.when(F.col("_was").isNull(), 0.0).when(F.col("value") >= F.col("_was"), F.col("value") - F.col("_was")).otherwise(F.col("value"))
    rows = rows.withColumn("_step", step)
    finite = F.abs("_step") < float("inf")  # false for NaN as well, which stands above all
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"sum": F.sum(F.when(finite, F.col("_step")).otherwise(0.0)), "odd": F.sum(F.when(finite, 0).otherwise(1)), "changes": F.sum(F.when(F.col("_was") != F.col("value"), 1).otherwise(0)), "first": F.first("value")}
    rows = rows.withColumn("_s", F.struct(F.row_number().over(by).alias("n"), "value", *[c.over(upto).alias(n) for n, c in sums.items()]))
    rows = rows.withColumn("_next", F.lead("_s").over(by))
    gone = F.struct((F.col("_s.n") + 1).alias("n"), *[F.col(f"_next.{c}").alias(c) for c in ("value", "sum", "odd", "changes")])
    come = F.struct(F.col("_t").alias("at"), F.col("_s.n").alias("n"), F.col("_s").alias("last"), F.when(F.lit(False), gone).alias("first"))
    go = F.struct((F.col("_t") + width).alias("at"), F.col("_s.n").alias("n"), F.when(F.lit(False), F.col("_s")).alias("last"), gone.alias("first"))
    events = rows.select(*labels, "_span", F.explode(F.array(come, go)).alias("_e")).select(*labels, "_span", "_e.*").filter(F.col("at") <= end)
    order = Window.partitionBy(*labels, "_span").orderBy("at", "n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select(*labels, "_span", "at", F.lead("at").over(order).alias("_after"), F.last("last", ignorenulls=True).over(upto).alias("_l"), F.last("first", ignorenulls=True).over(upto).alias("_f"))
    seen = seen.filter(F.col("_l.n") - F.coalesce("_f.n", F.lit(1)) >= 1)
    first = {c: F.coalesce(F.col(f"_f.{c}"), F.lit(0)) for c in ("sum", "odd", "changes")}
    grown = F.when(F.col("_l.odd") > first["odd"], F.lit(float("nan"))).otherwise(F.col("_l.sum") - first["sum"])
    delta = F.col("_l.value") - F.coalesce("_f.value", F.col("_l.first"))
    seen = seen.select(*labels, "_span", "at", "_after", grown.alias("increase"), (F.col("_l.changes") - first["changes"]).alias("changes"), delta.alias("delta"))
    out = _on_grid(seen, F.greatest("at", begin), F.least(F.col("_after") - 1, end), every)
    return out.select(*labels, _at(F.col("_g")).alias(ts), "increase", "changes", "delta")


def _next_starts(points: DataFrame, width: int) -> DataFrame:
    """(_key, _t, _next): the first instant ``width`` or more past _t; rows without one are starts whatever came before.

    An instant that stands ``width`` or more behind the one before it is always a start, so no pointer leads over
    such a hole and each is found within two spans of its own.
    """
    span = F.floor(F.col("_t") / width)
    times = points.select("_key", F.col("_t").alias("_pos"), F.lit(0).alias("_kind"), "_t", span.alias("_home"), F.explode(F.array(span - 1, span, span + 1)).alias("_span"))
    asked = points.select("_key", (F.col("_t") + width).alias("_pos"), F.lit(1).alias("_kind"), "_t", span.alias("_home"), (span + 1).alias("_span"))
    seen = F.when(F.col("_kind") == 0, F.col("_t"))
    by = Window.partitionBy("_key", "_span")
    after = F.last(seen, ignorenulls=True).over(by.orderBy(F.desc("_pos"), "_kind"))
    was = F.last(seen, ignorenulls=True).over(by.orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, -1))
    both = times.unionByName(asked).withColumns({"_next": after, "_was": was})
    first = (F.col("_kind") == 0) & (F.col("_span") == F.col("_home")) & (F.col("_was").isNull() | (F.col("_t") - F.col("_was") >= width))
    return both.filter(first | ((F.col("_kind") == 1) & (F.col("_next") - F.col("_t") < 2 * width))).select("_key", "_t", F.when(F.col("_kind") == 1, F.col("_next")).alias("_next"))


def _starts(points: DataFrame, width: int, written: Written) -> DataFrame:
    """(_key, _t): where slots start, by pointers doubled until none is left.

    Pointers of level n lead out of aligned blocks of 2^n spans and are kept for the first two spans of a block, as
    no other can be come to from outside. Levels thus halve, and all together hold twice the instants. Starts
    are spread up the levels and down again.
    """
    links = written(_next_starts(points, width))
    levels, blocks = [links.filter("_next is not null")], 1
    while not levels[-1].isEmpty():
        blocks *= 2
        span, block = F.floor(F.col("_t") / width), lambda c, n=blocks: F.floor(F.floor(F.col(c) / width) / n)
        a = levels[-1].filter(F.pmod(span, F.lit(blocks)) < 2).withColumn("_via", F.when(block("_t") == block("_next"), F.col("_next")))
        b = levels[-1].select("_key", F.col("_t").alias("_via"), F.col("_next").alias("_on"))
        out = F.when(F.col("_via").isNull(), F.col("_next")).otherwise(F.col("_on"))
        levels.append(written(a.join(b, ["_key", "_via"], "left").select("_key", "_t", out.alias("_next")).filter("_next is not null")))
    found = links.filter("_next is null").select("_key", "_t")
    for level in [*levels[:-1], *levels[-2::-1]]:
        found = found.join(level, ["_key", "_t"], "left").select("_key", F.explode(F.array_compact(F.array("_t", "_next"))).alias("_t")).distinct()
    return found


def rolling_max(samples: DataFrame, labels: list[str], slot: int, written: Written, ts: str = "ts") -> DataFrame:
    """(labels, start, top, rolling_max) a slot: its own maximum, and the greater of that and, unless it began two slots' time ago, the one before's.

    A slot starts at the first sample of the series that is ``slot`` seconds or more past the start of the one
    before. Samples without an instant are left out, those without a value count as times only; null labels are
    labels like others. Everything is dealt by series and spans of a slot's time, so a series of any length is
    shared by tasks. ``written`` keeps a table where all executors see it.
    """
    width = slot * 1_000_000
    rows = samples.select(F.struct(*labels).alias("_key"), _clock(ts).alias("_t"), F.col("value").cast("double").alias("value")).filter("_t is not null")
    points = written(rows.groupBy("_key", "_t").agg(F.max("value").alias("value")))
    span = F.floor(F.col("_t") / width)
    # starts are a slot's time apart, so a span has one at most and its instants see that or the one of the span before
    offered = _starts(points, width, written).select("_key", F.col("_t").alias("_s"), F.explode(F.array(span, span + 1)).alias("_span"))
    opened = offered.groupBy("_key", "_span").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    placed = points.withColumn("_span", span).join(opened, ["_key", "_span"])
    slots = placed.groupBy("_key", F.when(F.col("_b") <= F.col("_t"), F.col("_b")).otherwise(F.col("_a")).alias("start")).agg(F.max("value").alias("top"))
    home = F.floor(F.col("start") / width)
    near = slots.withColumn("_home", home).withColumn("_span", F.explode(F.array(home, home + 1, home + 2)))
    by = Window.partitionBy("_key", "_span").orderBy("start")
    prior = F.when(F.col("start") - F.lag("start").over(by) < 2 * width, F.lag("top").over(by))
    out = near.withColumn("rolling_max", F.greatest("top", prior)).filter("_span = _home")
    return out.select(*[F.col("_key")[c].alias(c) for c in labels], "start", "top", "rolling_max")


def rolling_max_at(samples: DataFrame, labels: list[str], slot: int, now: str, written: Written, ts: str = "ts") -> DataFrame:
    """The rolling maximum of each series as read at an instant: it fades once a slot has passed, and is 0 after two."""
    at, width = F.unix_micros(F.lit(now).cast("timestamp")), slot * 1_000_000
    past = samples.filter(_clock(ts) <= at)
    last = rolling_max(past, labels, slot, written, ts).groupBy(*labels).agg(F.max_by(F.struct("start", "top", "rolling_max"), "start").alias("l"))
    age = at - F.col("l.start")
    value = F.when(age >= 2 * width, 0.0).when(age >= width, F.col("l.top")).otherwise(F.col("l.rolling_max"))
    every = samples.select(*labels).distinct()
    return every.join(last.select(*labels, value.alias("rolling_max")), labels, "left").withColumn("rolling_max", F.coalesce("rolling_max", F.lit(0.0)))


def held_for(rows: DataFrame, labels: list[str], condition: Column, seconds: int | Column, every: int, ts: str = "ts") -> DataFrame:
    """Runs of samples, no more than ``every`` seconds apart, on which the condition holds for that long (a column may say).

    One row a run: when it began, when it had held long enough and when it ended.
    """
    by = Window.partitionBy(*labels).orderBy("_t")
    least = seconds if isinstance(seconds, Column) else F.lit(seconds)
    rows = rows.withColumn("_t", _clock(ts)).withColumn("_ok", F.coalesce(condition, F.lit(False))).withColumn("_least", least)
    apart = (F.col("_t") - F.lag("_t").over(by)) > every * 1_000_000
    new = ~F.col("_ok") | ~F.coalesce(F.lag("_ok").over(by), F.lit(False)) | F.coalesce(apart, F.lit(True))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(by)).filter("_ok")
    out = rows.groupBy(*labels, "_run").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.max(F.col("_least").cast("bigint")).alias("_least"))
    return out.filter(F.col("_b") - F.col("_a") >= F.col("_least") * 1_000_000).drop("_run", "_a", "_b", "_least")


def gate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a if b has any row."""
    return a.join(F.broadcast(b.limit(1).select(F.lit(1).alias("_gate"))), F.lit(True), "left_semi")


def otherwise(a: DataFrame, b: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of a, and those of b whose labels a does not have."""
    return a.unionByName(b.join(a.select(*labels).distinct(), labels, "left_anti"))


def or_zero(a: DataFrame) -> DataFrame:
    """The values of a, or one 0 if it has no row."""
    none = a.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(0.0).alias("value"))
    return a.select(F.col("value").cast("double").alias("value")).unionByName(none)


def seconds_since(samples: DataFrame, now: str) -> DataFrame:
    """Samples whose value is a time in seconds, as ages at an instant."""
    return samples.withColumn("value", F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.col("value"))


def absent(a: DataFrame) -> DataFrame:
    """One row (value 1) if a has none."""
    return a.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(1.0).alias("value"))


def match_labels(samples: DataFrame, equal=None, unequal=None, like=None, unlike=None) -> DataFrame:
    """Samples by label: equal, unequal, matching and not matching whole patterns; an absent label is ''."""
    def label(k: str) -> Column:
        return F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))

    for k, v in (equal or {}).items():
        samples = samples.filter(label(k) == v)
    for k, v in (unequal or {}).items():
        samples = samples.filter(label(k) != v)
    for k, v in (like or {}).items():
        samples = samples.filter(label(k).rlike(f"^(?:{v})$"))
    for k, v in (unlike or {}).items():
        samples = samples.filter(~label(k).rlike(f"^(?:{v})$"))
    return samples
