"""Folding a change log: one operation a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(log: DataFrame, *within: str) -> DataFrame:
    """Last operation of each (table_name, row_id), within columns that tell batches, by seq; anything but d is an upsert."""
    last = log.groupBy("table_name", "row_id", *within).agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return last.withColumn("is_delete", F.col("op") == "d")


def batch_stats(log: DataFrame, size: int) -> DataFrame:
    """For each run of ``size`` positions: entries, keys left by folding, their ratio, highest position."""
    batch = F.floor((F.col("seq") - 1) / size).cast("bigint")
    out = log.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("table_name", "row_id").alias("folded"), F.max("seq").alias("max_seq")
    )
    return out.withColumn("ratio", F.round(F.col("entries") / F.col("folded"), 6))


def oldest_change(log: DataFrame) -> DataFrame:
    """First change of each table in the batch, what lag is measured from."""
    return log.groupBy("table_name").agg(F.min("changed_at").alias("oldest"))
