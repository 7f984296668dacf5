"""Slots found by doubled pointers, against going through each series in order."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeseries
from tidemark.query_base import written


def one_by_one(rows, width):
    """(key, start) -> (top, rolling maximum) of (key, microseconds, value)."""
    out, slots = {}, {}
    for key, t, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        mine = slots.setdefault(key, [])
        if not mine or t - mine[-1][0] >= width:
            mine.append([t, None])
        if v is not None:
            mine[-1][1] = v if mine[-1][1] is None else max(v, mine[-1][1])
    for key, mine in slots.items():
        for i, (start, top) in enumerate(mine):
            seen = [top] + ([mine[i - 1][1]] if i and start - mine[i - 1][0] < 2 * width else [])
            out[key, start] = (top, max((x for x in seen if x is not None), default=None))
    return out


def samples(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, value double").select("k", F.timestamp_micros("t").alias("ts"), "value")


def found(spark, rows, slot):
    out = timeseries.rolling_max(samples(spark, rows), ["k"], slot, written(spark)).collect()
    got = {(r["k"], r["start"]): (r["top"], r["rolling_max"]) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_same_as_in_order(spark, seed):
    r = random.Random(seed)
    rows, at = [], {k: r.randrange(-3_000_000_000, 3_000_000_000) for k in ("a", "b", None, "")}
    for i in range(900):
        key = "a" if i % 3 else r.choice(["b", None, ""])
        at[key] += r.choice([0, 1, r.randrange(2_000_000), r.randrange(2_000_000), 9_999_999, 10_000_000, r.randrange(40_000_000)])
        rows.append((key, at[key], r.choice([None, r.random(), -r.random()])))
    rows += [("a", None, 5.0), ("never", None, 1.0), *rows[:40]]
    assert found(spark, rows, 10) == one_by_one(rows, 10_000_000)


def test_regular_times_and_long_runs(spark):
    """Starts exactly a slot apart, at the edges of spans, and one run over 300 slots, which takes nine levels."""
    rows = [("even", i * 5_000_000, float(i % 7)) for i in range(-50, 50)] + [("odd", 3 + i * 3_333_333, float(i % 5)) for i in range(900)]
    want = one_by_one(rows, 10_000_000)
    assert len([k for k in want if k[0] == "odd"]) > 200
    assert found(spark, rows, 10) == want


def test_empty_and_single(spark):
    assert found(spark, [], 10) == {}
    assert found(spark, [("a", 7, None)], 10) == {("a", 7): (None, None)}


def test_levels_halve_and_no_series_meets_in_one_task(spark):
    """What the levels keep, and the most rows of a hot series that are sorted together."""
    rows = [("hot", i * 2_000_000 + i % 7, 1.0) for i in range(4000)]
    keep, sizes = written(spark), []

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    timeseries.rolling_max(samples(spark, rows), ["k"], 10, counted).collect()
    points, links, *levels = sizes
    assert points == 4000 and links <= points + 1 and levels[-1] == 0
    assert all(b <= a * 0.6 + 12 for a, b in zip(levels, levels[1:], strict=False)) and sum(levels) <= 2 * points
    span = F.floor(F.col("_t") / 10_000_000)
    dealt = samples(spark, rows).select("k", F.unix_micros("ts").alias("_t")).select("k", F.explode(F.array(span - 1, span, span + 1)).alias("s"))
    assert dealt.groupBy("k", "s").count().agg(F.max("count")).first()[0] <= 18
