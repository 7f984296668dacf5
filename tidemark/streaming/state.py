"""State kept by key in a stream: the guard of a table, and batches closed by count or age.

Both are processors for ``transformWithState`` on the RocksDB state store, so state is as large as the keys are
many, stands on the executors' disks and is checkpointed with the stream's progress. Rows of a key in one
micro-batch are sorted by arrival, those of one arrival by position; the reader bounds how many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """State stores of streams started from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Guard(StatefulProcessor):
    """One row a key: the highest position taken. A change passes at a higher one only; a delete of no row passes nothing.

    Input: key, arrival, op, lsn and values; output: the changes that passed, as the row is afterwards, with
    ``deleted`` and the values of the last upsert.
    """

    def __init__(self, key: str, values: list[str], state: str):
        self.key, self.values, self.state_schema = key, values, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.state_schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.row.update((initialState["source_lsn"], *[initialState[v] for v in self.values]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.row.get()
        out = []
        for r in sorted(rows, key=lambda r: (r["arrival"], r["lsn"])):
            gone = r["op"] == "d"
            if (held is None and gone) or (held is not None and r["lsn"] <= held[0]):
                continue
            held = (r["lsn"], *(held[1:] if gone else [r[v] for v in self.values]))
            out.append(Row(**{self.key: key[0], "arrival": r["arrival"], **dict(zip(self.values, held[1:], strict=True)), "deleted": gone, "source_lsn": r["lsn"]}))
        if out:
            self.row.update(tuple(held))
        return iter(out)

    def close(self) -> None:
        pass


def guarded_stream(changes: DataFrame, key: str, values: dict[str, str], stored: DataFrame | None = None) -> DataFrame:
    """The changes of a stream (key, arrival, op, lsn, values) that the guard lets through.

    values: name -> SQL type. stored (key, values, source_lsn): rows that are there before the first batch.
    """
    types = ", ".join(f"{n} {t}" for n, t in values.items())
    kind = changes.schema[key].dataType.simpleString()
    start = stored.select(key, "source_lsn", *values).groupBy(key) if stored is not None else None
    return changes.select(key, "arrival", "op", "lsn", *values).groupBy(key).transformWithState(
        Guard(key, list(values), f"source_lsn long, {types}"), f"{key} {kind}, arrival long, {types}, deleted boolean, source_lsn long", "Append", "None", start
    )


class Batches(StatefulProcessor):
    """Batches of a key: closed by the event that makes them ``most``, or ``wait`` after their first by event time.

    Input: key, ts, position; output: key, batch, n, first and last position of each batch closed. An event that comes
    when the batch's time is over closes it and begins the next; a key without further events is closed by a timer,
    once the watermark has passed. Only the batch that a micro-batch leaves open needs one. Rows come as frames and are
    gone through a batch at a time, not one by one.
    """

    def __init__(self, key: str, most: int, wait: float):
        self.key, self.most, self.wait = key, most, int(wait * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "batch long, n long, lo long, hi long, began long")

    def _closed(self, key, done: list[tuple]) -> Iterator[pd.DataFrame]:
        if done:
            frame = pd.DataFrame(done, columns=["batch", "n", "lo", "hi"])
            frame.insert(0, self.key, key[0])
            yield frame

    def _due(self, began: int) -> int:
        """The first whole millisecond at which a batch's time is over."""
        return -(-(began + self.wait) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, n, lo, hi, began = self.open.get() or (0, 0, 0, 0, 0)
        came = pd.concat([r[["position", "us"]] for r in rows]).sort_values("position", kind="stable")
        position, us = came["position"].to_numpy(), came["us"].to_numpy()
        done, i = [], 0
        while i < len(us):
            if not n:
                n, lo, hi, began = 1, int(position[i]), int(position[i]), int(us[i])
                i += 1
            over = us[i : i + self.most - n] - began >= self.wait
            late = bool(over.any())
            took = int(over.argmax()) if late else len(over)
            if took:
                n, hi, i = n + took, int(position[i + took - 1]), i + took
            if late or n == self.most:
                done.append((batch, n, lo, hi))
                batch, n, lo, hi, began = batch + 1, 0, 0, 0, 0
        if n:
            self.handle.registerTimer(self._due(began))
        self.open.update((batch, n, lo, hi, began))
        return self._closed(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is None or not held[1] or self._due(held[4]) > expiredTimerInfo.getExpiryTimeInMs():
            return iter([])  # it was closed before, and another has begun since
        self.open.update((held[0] + 1, 0, 0, 0, 0))
        return self._closed(key, [tuple(held[:4])])

    def close(self) -> None:
        pass


def batches(events: DataFrame, key: str, most: int = 500, wait: float = 0.2, late: str = "1 second") -> DataFrame:
    """(key, batch, n, lo, hi) of a stream of (key, ts, position), positions rising with ts in each key.

    An event may be up to ``late`` behind the newest of the batches before; the timers of idle keys wait as long.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.selectExpr(key, "position", "unix_micros(cast(ts as timestamp)) as us", "cast(ts as timestamp) as ts").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(Batches(key, most, wait), f"{key} {kind}, batch long, n long, lo long, hi long", "Append", "EventTime")
