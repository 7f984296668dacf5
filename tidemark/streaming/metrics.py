"""Figures of a running stream: counters by table and operation, lag, and progress of its batches."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.clock import lag_seconds
from tidemark.schemas import METRIC


class Progress(StreamingQueryListener):
    """Keeps the newest figures of each query; failures in a row and batches are counted."""

    def __init__(self):
        self.lock = threading.Lock()
        self.values: dict[str, dict] = defaultdict(lambda: {"batches": 0, "rows": 0, "failures": 0})

    def onQueryStarted(self, event):
        with self.lock:
            self.values[str(event.id)]

    def onQueryProgress(self, event):
        p = event.progress
        with self.lock:
            v = self.values[str(p.id)]
            v["batches"] += 1
            v["rows"] += p.numInputRows
            v["failures"] = 0
            v["batch"] = p.batchId

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.lock:
            if event.exception:
                self.values[str(event.id)]["failures"] += 1


class Meters:
    """Counters, gauges and timers of one process, told by name and labels; read as metric samples."""

    def __init__(self, clock=time.time):
        self.lock, self.clock = threading.Lock(), clock
        self.values: dict[tuple, float] = defaultdict(float)
        self.failures, self.last_cycle = 0, clock()
        self.set("capture_gap", 0.0)

    def add(self, name: str, n: float = 1.0, **labels: str) -> None:
        with self.lock:
            self.values[name, tuple(sorted(labels.items()))] += n

    def set(self, name: str, value: float, **labels: str) -> None:
        with self.lock:
            self.values[name, tuple(sorted(labels.items()))] = float(value)

    def time(self, name: str, seconds: float, **labels: str) -> None:
        """A timer: its count, sum and greatest value."""
        key = tuple(sorted(labels.items()))
        with self.lock:
            self.values[f"{name}_count", key] += 1
            self.values[f"{name}_sum", key] += seconds
            self.values[f"{name}_max", key] = max(self.values[f"{name}_max", key], seconds)

    def get(self, name: str, **labels: str) -> float:
        with self.lock:
            return self.values.get((name, tuple(sorted(labels.items()))), 0.0)

    def cycle(self) -> None:
        """A cycle that ended well."""
        self.failures, self.last_cycle = 0, self.clock()

    def failed(self, reason: str, halted: bool = False) -> None:
        """A cycle that failed; a halt is counted by its reason."""
        self.failures += 1
        self.add("halts_total" if halted else "sink_errors_total", reason=reason)

    def healthy(self, most_failures: int = 3, most_idle: float = 60.0) -> bool:
        """A backlog is not ill health; failures in a row or a long time without a cycle are."""
        return self.failures < most_failures and self.clock() - self.last_cycle <= most_idle

    def samples(self, spark: SparkSession) -> DataFrame:
        """All of them as metric samples of this moment."""
        with self.lock:
            rows = [(name, dict(labels), datetime.fromtimestamp(self.clock(), UTC), v) for (name, labels), v in self.values.items()]
        return spark.createDataFrame(rows, METRIC)


class SkewProbe:
    """How far the source's clock is from ours, in seconds; a reading that fails leaves the last value standing."""

    def __init__(self, read: Callable[[], float], meters: Meters, clock=time.time):
        self.read, self.meters, self.clock = read, meters, clock

    def __call__(self) -> float:
        began = self.clock()
        try:
            there = self.read()
        except Exception:
            self.meters.add("skew_probe_errors_total")
            return self.meters.get("clock_skew_seconds")
        # the reading stands for the middle of its own round trip
        skew = there - (began + self.clock()) / 2
        self.meters.set("clock_skew_seconds", skew)
        return skew


def observed(events: DataFrame, name: str = "events") -> DataFrame:
    """Events that report their count, highest position and deletes as they pass."""
    return events.observe(name, F.count(F.lit(1)).alias("n"), F.max("lsn").alias("position"), F.count_if(F.col("op") == "d").alias("deletes"))


def counters(events: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """(table, op, n); only registered tables count where they are given."""
    if tables is not None:
        events = events.filter(F.col("table").isin(*tables))
    return events.groupBy("table", "op").agg(F.count(F.lit(1)).alias("n"))


def lags(events: DataFrame, now: str) -> DataFrame:
    """(table, lag_max, lag_avg) in seconds of events whose source time is known."""
    lag = lag_seconds(F.unix_micros(F.lit(now).cast("timestamp")), F.col("source_ts_ms"))
    return events.groupBy("table").agg(F.max(lag).alias("lag_max"), F.avg(lag).alias("lag_avg"))


def heartbeat(spark: SparkSession, seconds: int = 10) -> DataFrame:
    """A stream of one beat every so many seconds, so that progress moves while nothing changes."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load().select(F.lit("main").alias("pipeline"), F.col("timestamp").alias("beat_at"))
