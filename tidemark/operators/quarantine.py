"""Bad events: split, judge, quarantine, claim and settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.verdict import clipped

PAYLOAD = "struct<`table`: string, op: string, lsn: bigint, sourceTsMs: bigint, before: map<string,string>, after: map<string,string>>"


def to_payload() -> Column:
    """An event as the text a dead letter keeps."""
    return F.to_json(F.struct(F.col("table"), "op", "lsn", F.col("source_ts_ms").alias("sourceTsMs"), "before", "after"), {"ignoreNullFields": "false"})


def from_payload(letters: DataFrame) -> DataFrame:
    """Dead letters with their event restored; ``restored`` is false where that cannot be done."""
    p = letters.withColumn("p", F.from_json("payload", PAYLOAD))
    out = p.select(*letters.columns, F.col("p.table").alias("table"), F.col("p.op").alias("op_"), F.col("p.lsn").alias("lsn"), F.col("p.sourceTsMs").alias("source_ts_ms"), "p.before", "p.after")
    return out.withColumn("restored", F.col("table").isNotNull() & F.col("op_").isNotNull() & F.col("lsn").isNotNull())


def numbered(bad: DataFrame, base: int = 0) -> DataFrame:
    """bad with letter ids that rise with arrival from base + 1, none used twice.

    Arrival numbers hold the partition read in their upper bits (as monotonically_increasing_id gives them):
    rows are ranked inside it, and only one count a partition is summed up on the driver.
    """
    part = F.shiftright("arrival", 33)
    counts = sorted(tuple(r) for r in bad.groupBy(part.alias("p")).count().collect())
    start, upto = {}, base
    for p, n in counts:
        start[p], upto = upto, upto + n
    offset = F.element_at(F.create_map(*[F.lit(x) for p in start for x in (p, start[p])]), part) if start else F.lit(base)
    rank = F.row_number().over(Window.partitionBy(part).orderBy("arrival"))
    return bad.withColumn("letter", (offset + rank).cast("bigint"))


def dead_letters(bad: DataFrame, pipeline: str, now: str) -> DataFrame:
    """Rows of the quarantine for events with a fault (or raw text that is no event); their ids are in ``letter``."""
    broken = F.col("broken") if "broken" in bad.columns else F.lit(False)
    raw = F.col("raw") if "raw" in bad.columns else F.lit(None).cast("string")
    at = F.lit(now).cast("timestamp")
    return bad.select(
        F.col("letter").alias("id"), F.lit(pipeline).alias("pipeline"),
        F.when(broken, "unknown").otherwise(F.col("table")).alias("source_table"), F.when(broken, "unknown").otherwise(F.col("op")).alias("op"),
        F.when(broken, 0).otherwise(F.col("lsn")).cast("bigint").alias("source_lsn"), F.when(broken, clipped(raw)).otherwise(to_payload()).alias("payload"),
        F.when(broken, "unparsable").otherwise(F.lit("data")).alias("failure_type"), F.lit("22018").alias("failure_sql_state"), clipped(F.coalesce("fault", F.lit("broken json"))).alias("failure_message"),
        F.lit(1).alias("attempts"), F.lit("PENDING").alias("status"), at.alias("first_failed_at"), at.alias("last_failed_at"),
    )


def must_halt(failed: int, total: int, ratio: float = 0.5, least: int = 1) -> bool:
    """Too many of a batch failed for it to be the events' fault."""
    return failed >= least and total > 0 and failed / total > ratio


def claim(letters: DataFrame, most: int) -> DataFrame:
    """The oldest letters that somebody asked to be tried again, as ids rise with arrival; pending ones are never taken."""
    return letters.filter("status = 'RETRY_REQUESTED'").orderBy("id").limit(most)


def settled(letters: DataFrame, done: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """Letters after a round: done ones resolved, failed ones pending again with one more attempt."""
    d, f = done.select(F.col("id").alias("_d")).distinct(), failed.select(F.col("id").alias("_f")).distinct()
    out = letters.join(d, F.col("id") == F.col("_d"), "left").join(f, F.col("id") == F.col("_f"), "left")
    hit = F.col("_d").isNotNull() | F.col("_f").isNotNull()
    out = (
        out.withColumn("status", F.when(F.col("_d").isNotNull(), "RESOLVED").when(F.col("_f").isNotNull(), "PENDING").otherwise(F.col("status")))
        .withColumn("attempts", F.col("attempts") + F.when(F.col("_f").isNotNull(), 1).otherwise(0))
        .withColumn("last_failed_at", F.when(hit & F.col("_f").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_failed_at")))
    )
    return out.drop("_d", "_f")


def status_pivot(letters: DataFrame) -> DataFrame:
    """One row, also of an empty table: letters by status and in all."""
    return letters.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "RETRY_REQUESTED", "RESOLVED", "DISCARDED")], F.count(F.lit(1)).alias("total"))
