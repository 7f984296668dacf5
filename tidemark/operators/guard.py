"""Whether the log still holds everything since the last applied position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaps(checkpoints: DataFrame, slots: DataFrame) -> DataFrame:
    """(pipeline, last_applied, restart, reason): one row where changes may be lost.

    checkpoints: pipeline, last_applied; slots: pipeline, restart (null counts as 0). No history means no
    gap; a slot that is gone is a gap; a slot that restarts after the last applied position is one.
    """
    c = checkpoints.filter("last_applied is not null and last_applied > 0")
    s = slots.select(F.col("pipeline").alias("slot"), F.coalesce("restart", F.lit(0)).alias("restart"))
    both = c.join(s, c["pipeline"] == s["slot"], "left")
    reason = F.when(F.col("slot").isNull(), "slot missing").when(F.col("restart") > F.col("last_applied"), "restart after last applied")
    return both.select("pipeline", "last_applied", "restart", reason.alias("reason")).filter("reason is not null")


def slot_states(pipelines: DataFrame, log: DataFrame) -> DataFrame:
    """(pipeline, present, restart): whether a log still has anything for a pipeline, and from where on (0 if not)."""
    kept = log.groupBy(F.col("pipeline").alias("_p")).agg(F.min("lsn").alias("_restart"))
    both = pipelines.join(kept, pipelines["pipeline"] == kept["_p"], "left")
    return both.select("pipeline", F.col("_p").isNotNull().alias("present"), F.coalesce("_restart", F.lit(0)).cast("bigint").alias("restart"))


class CaptureGap(RuntimeError):
    """Raised before a stream starts on a log with a gap."""


def check(checkpoints: DataFrame, slots: DataFrame, fail: bool = True) -> list[tuple]:
    """The gaps; an error where there are any, unless told otherwise. There is one row a pipeline at most."""
    found = [tuple(r) for r in gaps(checkpoints, slots).collect()]
    if found and fail:
        raise CaptureGap("; ".join(f"{p}: {why}" for p, _, _, why in found))
    return found
