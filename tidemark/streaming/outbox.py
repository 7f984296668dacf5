"""The key-only log end to end: poll, fold, look the rows up, apply, move the checkpoint, prune, report.

The log tells only which rows changed; what they hold is read from the source when the batch is applied. So
a batch is a set of keys, folded to one operation each; keys to delete go first, then the present rows of
the others are upserted, rows that are gone meanwhile being skipped. Tables and checkpoint are one commit.
The log is pruned after it; a crash between the two only leaves entries that the checkpoint skips.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chunks, merge
from tidemark.operators.fold import fold
from tidemark.operators.mapping import mapped
from tidemark.schemas import OUTBOX, SPECS, TableSpec
from tidemark.sources import changes
from tidemark.streaming.metrics import Meters
from tidemark.streaming.store import BUCKET, Store, bucket_of


def applied(target: DataFrame | None, source: DataFrame, folded: DataFrame, spec: TableSpec, seq: int) -> DataFrame:
    """A target table after one folded batch (row_id, is_delete) whose highest position is seq.

    Guarded tables keep deleted rows, marked, with the position that deleted them; others lose them.
    """
    keys = folded.select(F.col("row_id").alias(spec.key), "is_delete")
    fresh = mapped(changes.current_rows(source, keys.filter("not is_delete"), spec.key), spec)
    gone = keys.filter("is_delete").select(spec.key)
    if spec.guarded:
        fresh = fresh.withColumn("deleted", F.lit(False)).withColumn("source_seq", F.lit(seq).cast("bigint"))
        kept = None if target is None else merge.bulk_soft_delete(target, gone, spec.key, seq)
    else:
        kept = None if target is None else merge.bulk_delete(target, gone, spec.key)
    return fresh if kept is None else merge.bulk_upsert(kept.select(*fresh.columns), fresh, spec.key)


def caught_up(target: DataFrame | None, source: DataFrame, folded: DataFrame, spec: TableSpec) -> DataFrame:
    """A target table after several folded batches at once (row_id, is_delete, _cycle, _top: its highest position), as after one by one.

    The source's rows are the same for all of them. So of a key its last delete counts, and its last upsert if the
    source has the row; a delete takes effect if there is a row by then.
    """
    last = lambda gone: F.max(F.when(F.col("is_delete") == gone, F.col("_top")))
    keys = folded.groupBy(F.col("row_id").alias(spec.key)).agg(last(False).alias("_up"), last(True).alias("_down"))
    fresh = mapped(changes.current_rows(source, keys.filter("_up is not null").select(spec.key), spec.key), spec)
    fresh = fresh.join(keys.select(spec.key, "_up", "_down"), spec.key)
    later = F.coalesce(F.col("_down") > F.col("_up"), F.lit(False))
    if not spec.guarded:
        fresh = fresh.filter(~later).drop("_up", "_down")
        return fresh if target is None else target.select(*fresh.columns).join(keys.filter("_down is not null").select(spec.key), spec.key, "left_anti").join(fresh.select(spec.key), spec.key, "left_anti").unionByName(fresh)
    fresh = fresh.withColumn("deleted", later).withColumn("source_seq", F.when(later, F.col("_down")).otherwise(F.col("_up"))).drop("_up", "_down")
    if target is None:
        return fresh
    old = target.select(*fresh.columns).join(keys.select(spec.key, "_down"), spec.key, "left").join(fresh.select(spec.key), spec.key, "left_anti")
    hit = F.col("_down").isNotNull()
    old = old.withColumn("deleted", hit | F.col("deleted")).withColumn("source_seq", F.when(hit, F.col("_down")).otherwise(F.col("source_seq")))
    return old.drop("_down").unionByName(fresh)


class Outbox:
    """A key-only log kept in a store, as its source would keep it.

    Pruning moves a mark, below which nothing is read any more; ``vacuum`` rewrites the log without it.
    """

    def __init__(self, store: Store, table: str = "sync_outbox"):
        self.store, self.table = store, table

    def pruned(self) -> int | None:
        return self.store.manifest()["marks"].get(self.table)

    def rows(self) -> DataFrame:
        kept, upto = self.store.read(self.table, OUTBOX), self.pruned()
        return kept if upto is None else kept.filter(F.col("seq") > upto)

    def append(self, entries: DataFrame) -> None:
        self.store.commit(None, None, append={self.table: entries.select(*OUTBOX.names)})

    def poll(self, after: int, most: int) -> DataFrame:
        return changes.poll(self.rows(), after, most)

    def pending(self, after: int) -> int:
        return self.rows().filter(F.col("seq") > after).count()

    def prune(self, upto: int) -> None:
        """Let go of what has been applied; harmless to repeat."""
        old = self.pruned()
        self.store.commit(None, None, marks={self.table: upto if old is None else max(old, upto)})

    def vacuum(self) -> None:
        """Rewrite the log without what was pruned; its files go with the store's next ``prune``."""
        self.store.commit(None, None, {self.table: self.rows()})


class Worker:
    """Cycles of the log over a store of targets. source gives the present rows of a source table."""

    def __init__(self, outbox: Outbox, source: Callable[[str], DataFrame], store: Store, specs: dict[str, TableSpec] = SPECS, size: int = 5000, buckets: int = 16, meters: Meters | None = None, clock=time.time):
        self.outbox, self.source, self.store, self.specs, self.size, self.buckets = outbox, source, store, specs, size, buckets
        self.meters, self.clock = meters or Meters(), clock

    def run_once(self, cycles: int = 1) -> int:
        """One cycle, or several of the same size in one commit; the number of keys applied, 0 when nothing is waiting."""
        after = self.store.manifest()["position"] or 0
        ranged = None if cycles == 1 else chunks.by_ranges(self.outbox.rows().filter(F.col("seq") > after), "seq")
        batch = (self.outbox.poll(after, self.size) if ranged is None else self._ahead(ranged, cycles)).persist()
        try:
            by_table = batch.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"), F.min(F.unix_micros(F.col("changed_at").cast("timestamp"))).alias("oldest")).collect()  # one row a table
            if not by_table:
                self.meters.set("outbox_pending", 0)
                self.meters.cycle()
                return 0
            raw, top = sum(r["n"] for r in by_table), max(r["top"] for r in by_table)
            folded = (fold(batch) if ranged is None else fold(batch, "_cycle", "_top")).persist()
            figures = folded.groupBy("table_name", "is_delete", bucket_of("row_id", self.buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by tables and buckets
            counts = Counter()
            for r in figures:
                counts[r["table_name"], r["is_delete"]] += r["n"]
            replace, touched = {}, {}
            for name in sorted({t for t, _ in counts} & set(self.specs)):
                spec, own = self.specs[name], folded.filter(F.col("table_name") == name)
                touched[name] = sorted({r["bucket"] for r in figures if r["table_name"] == name})
                target = self.store.read(name, buckets=touched[name])
                after_it = applied(target, self.source(name), own, spec, top) if ranged is None else caught_up(target, self.source(name), own, spec)
                replace[name] = after_it.withColumn(BUCKET, bucket_of(spec.key, self.buckets))
            self.store.commit(None, top, replace, touched=touched)
            for (table, gone), n in counts.items():
                if table in self.specs:
                    self.meters.add("applied_total", n, table=table, op="d" if gone else "u")
            self.meters.add("outbox_read_total", raw)
            self.meters.add("outbox_folded_total", sum(counts.values()))
            for r in by_table:
                self.meters.time("lag_seconds", max(0.0, self.clock() - r["oldest"] / 1e6), table=r["table_name"])
            folded.unpersist()
        finally:
            batch.unpersist()
            if ranged is not None:
                ranged.unpersist()
        self.outbox.prune(top)
        self.meters.set("outbox_pending", self.outbox.pending(top))
        self.meters.cycle()
        return sum(n for (t, _), n in counts.items() if t in self.specs) or raw


    def _ahead(self, ranged: DataFrame, cycles: int) -> DataFrame:
        """The entries of the next cycles, each with its cycle's number and highest position."""
        rows = chunks.numbered(ranged, "seq", self.size).filter(F.col("page") < cycles)
        tops = rows.groupBy("page").agg(F.max("seq").alias("_top"))  # a row a cycle
        return rows.join(F.broadcast(tops), "page").withColumnRenamed("page", "_cycle")


def catch_up(worker: Worker, more: int = 8) -> None:
    """Cycles until nothing is waiting, so many times as many a commit each time: a long backlog takes few commits."""
    cycles = 1
    while worker.run_once(cycles):
        cycles *= more


def poll_wait(failures: int, poll: float = 0.2, most: float = 30.0) -> float:
    """Seconds to the next poll after that many failures in a row."""
    return min(poll * 2 ** min(failures, 6), most)


def run(worker: Worker, running: Callable[[], bool], poll: float = 0.2, sleep=time.sleep) -> None:
    """Cycles for as long as wanted: no rest while entries are waiting, longer and longer ones after failures.

    A failed cycle has not moved the checkpoint, and upserts may be repeated: it is simply done again.
    """
    while running():
        try:
            if worker.run_once() == 0:
                sleep(poll)
        except Exception as e:
            worker.meters.failed(type(e).__name__)
            sleep(poll_wait(worker.meters.failures, poll))
