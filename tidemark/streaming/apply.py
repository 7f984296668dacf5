"""The stream: parse, split good from bad, merge, and commit tables, letters and progress together."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.verdict import verdict_of
from tidemark.operators import diff, guard, merge, quarantine
from tidemark.operators.mapping import typed
from tidemark.schemas import CHANGE_AUDIT, DEAD_LETTER, SPECS, TableSpec
from tidemark.sources.changes import parse_envelopes, route
from tidemark.streaming.metrics import Meters
from tidemark.streaming.store import BUCKET, Store, bucket_of


class Halted(RuntimeError):
    """Too much of a batch failed, or the failure is not the data's: never tried again by itself."""

    verdict = "HALT"


def with_retry(work: Callable[[], object], tries: int = 3, wait: float = 0.2, sleep=time.sleep) -> object:
    """Run work again after failures that may pass, waiting twice as long each time; others are raised at once."""
    for n in range(tries + 1):
        try:
            return work()
        except Exception as e:
            if verdict_of(e) != "RETRY" or n == tries:
                raise
            sleep(wait * 2**n)


class Applier:
    """Applies batches of envelopes to a store.

    Each batch is read in order of arrival (the order of its lines); guarded tables take a change at a higher
    position only, others the last arrival. A table is written only if the batch has changes of it, and of it
    only the buckets that hold the keys changed.
    """

    def __init__(self, store: Store, specs: dict[str, TableSpec] = SPECS, audited: str = "", halt_ratio: float = 0.5, least_failures: int = 1, pipeline: str = "main", now: str = "1970-01-01 00:00:00", buckets: int = 16, meters: Meters | None = None):
        self.store, self.specs, self.audited = store, specs, audited
        self.halt_ratio, self.least_failures, self.pipeline, self.now = halt_ratio, least_failures, pipeline, now
        self.buckets, self.meters = buckets, meters or Meters()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            with_retry(lambda: self.apply(parse_envelopes(batch), batch_id))
        except Exception as e:
            self.meters.failed(type(e).__name__, halted=isinstance(e, Halted))
            raise
        self.meters.cycle()

    def apply(self, events: DataFrame, batch_id: int) -> dict:
        """One batch of change events (with broken and raw, as parsed); returns its counts."""
        manifest = self.store.manifest()
        if batch_id <= manifest["batch"]:
            return {"skipped": True}
        events = route(events, list(self.specs)).withColumn("arrival", F.monotonically_increasing_id()).persist()
        bad = None
        try:
            figures = events.groupBy("broken", F.when(F.col("routed") == "handled", F.col("table")).alias("table"), F.col("op").isin("d").alias("gone")).agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("lsn")).collect()
            total = sum(r["n"] for r in figures)
            position = max((r["lsn"] for r in figures if not r["broken"]), default=None)
            passed = sum(r["n"] for r in figures if not r["broken"] and r["table"] is None)
            seen = [name for name in self.specs if any(r["table"] == name and not r["broken"] for r in figures)]
            bad = events.filter("broken").withColumn("fault", F.lit("broken json"))
            parts = {}
            for name in seen:
                rows = typed(events.filter(~F.col("broken") & (F.col("table") == name)), self.specs[name])
                bad = bad.unionByName(rows.filter("fault is not null").select(*bad.columns))
                parts[name] = rows.filter("fault is null")
            bad = bad.persist()
            by_table = {r["table"]: r["n"] for r in bad.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()}
            failed = sum(by_table.values())
            if quarantine.must_halt(failed, total, self.halt_ratio, self.least_failures):
                raise Halted(f"{failed} of {total} events failed")
            replace, touched = {}, {}
            for name, rows in parts.items():
                replace[name], touched[name] = self.merged(name, rows, None if total <= merge.SPAN else merge.SPAN)
            letters = manifest.get("marks", {}).get("letters", 0)
            append = {"cdc_dead_letter": quarantine.dead_letters(quarantine.numbered(bad, letters), self.pipeline, self.now)} if failed else {}
            if self.audited and seen:
                append["cdc_change_audit"] = diff.audit(events.filter("not broken and routed = 'handled'"), self.audited, self.pipeline, self.now)
            self.store.commit(batch_id, position, replace, append, touched, {"letters": letters + failed})
            for r in figures:
                if r["table"] and not r["broken"]:
                    self.meters.add("events_total", r["n"], table=r["table"], op="d" if r["gone"] else "u")
            for name, n in by_table.items():
                self.meters.add("dead_letters_total", n, table=name or "unknown")
            return {"total": total, "failed": failed, "passed": passed, "position": position}
        finally:
            events.unpersist()
            if bad is not None:
                bad.unpersist()

    def merged(self, name: str, rows: DataFrame, span: int | None = merge.SPAN) -> tuple[DataFrame, list[int]]:
        """The buckets of a table that rows change, as they are afterwards, and their numbers."""
        spec = self.specs[name]
        values = [c for c in spec.fields if c != spec.key]
        bucket = bucket_of(spec.key, self.buckets)
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # bounded by the buckets
        stored = self.store.read(name, buckets=touched)
        out = merge.guarded(rows, spec.key, values, stored, span) if spec.guarded else merge.last_arrival(stored, rows, spec.key, values)
        return out.withColumn(BUCKET, bucket), touched

    def reprocess(self, most: int = 50) -> dict:
        """One round over the dead letters that were asked for again, the oldest first."""
        letters = self.store.read("cdc_dead_letter", DEAD_LETTER)
        claimed = quarantine.claim(letters, most).persist()
        back = quarantine.from_payload(claimed)
        done = None
        replace, touched = {}, {}
        for name, spec in self.specs.items():
            own = back.filter("restored").filter(F.col("table") == name)
            events = own.select(F.col("id").alias("letter"), F.col("id").alias("arrival"), F.col("op_").alias("op"), "before", "after", "lsn")
            good = typed(events, spec).filter("fault is null")
            done = good.select(F.col("letter").alias("id")) if done is None else done.unionByName(good.select(F.col("letter").alias("id")))
            table, numbers = self.merged(name, good)
            if numbers:
                replace[name], touched[name] = table, numbers
        failed = claimed.select("id").join(done, "id", "left_anti")
        replace["cdc_dead_letter"] = quarantine.settled(letters, done, failed, self.now)
        out = {"claimed": claimed.count(), "resolved": done.count()}
        self.store.commit(None, None, replace, touched=touched)
        claimed.unpersist()
        return out

    def resync(self, name: str, rows: DataFrame, lsn: int) -> None:
        """Load a table anew from its source: every row is upserted, rows that vanished are deleted."""
        spec = self.specs[name]
        fresh = rows.select(*[F.expr(e).alias(t) for t, e in spec.fields.items()])
        stored = self.store.read(name)
        if spec.guarded:
            fresh = fresh.withColumn("deleted", F.lit(False)).withColumn("source_lsn", F.lit(lsn).cast("bigint"))
            if stored is not None:
                gone = stored.join(fresh.select(spec.key), spec.key, "left_anti").withColumn("deleted", F.lit(True)).withColumn("source_lsn", F.greatest("source_lsn", F.lit(lsn)))
                fresh = fresh.unionByName(gone.select(*fresh.columns))
        fresh = fresh.withColumn(BUCKET, bucket_of(spec.key, self.buckets))
        self.store.commit(None, lsn, {name: fresh}, touched={name: list(range(self.buckets))})


def start(
    spark: SparkSession, path: str, checkpoint: str, applier: Applier, files_per_batch: int = 1, once: bool = True, every: str = "200 milliseconds", bytes_per_batch: str | None = None,
    checkpoints: DataFrame | None = None, slots: DataFrame | None = None, fail_on_gap: bool = True,
):
    """A query over a folder of envelope text files; batches follow each other, the oldest file first.

    A batch ends by size (so many files, or bytes) or by time (what has come since the last trigger). With
    checkpoints and slots the log is looked at for a gap first: one stops the start, or only shows in the
    gauge ``capture_gap``.
    """
    if checkpoints is not None and slots is not None:
        found = guard.check(checkpoints, slots, fail=False)
        applier.meters.set("capture_gap", 1.0 if found else 0.0)
        if found and fail_on_gap:
            raise guard.CaptureGap("; ".join(f"{p}: {why}" for p, _, _, why in found))
    reader = spark.readStream.format("text")
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.load(path).writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


__all__ = ["CHANGE_AUDIT", "Applier", "Halted", "start", "with_retry"]
