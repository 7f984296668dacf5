"""Applying changes to target tables as set operations.

Guarded tables take a change only if its position is strictly higher than all taken before for the key.
Applied in order of arrival that is a running maximum, which is computed as a segmented scan: a key's changes are
cut into segments of ``SPAN`` arrivals, each sorted by itself, and what the segments before tell - whether the
row exists, and the highest position since it does - is carried in. Changes of a key that arrive at once are taken in
order of position, those of one position by their operation's letter, so nothing is left to chance. The state is associative, so a key that
holds a third of all changes is shared by as many tasks as it has segments. Where a batch is known to be in
order, a plain aggregation with map-side partial maxima does the same without the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Arrivals, numbered by whole numbers, of one key that are sorted together.
SPAN = 1 << 16


def last_arrival(stored: DataFrame | None, events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Unguarded upsert and hard delete: the last arrival of each key wins; deleted keys are gone.

    events: key, arrival, op and values; stored: key and values.
    """
    last = events.groupBy(key).agg(F.max_by(F.struct("op", *values), "arrival").alias("l"))
    fresh = last.filter("l.op <> 'd'").select(key, *[F.col(f"l.{v}").alias(v) for v in values])
    if stored is None:
        return fresh
    return stored.select(key, *values).join(last.select(key), key, "left_anti").unionByName(fresh)


def guarded_in_order(events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Guarded state of keys that have an upsert, for positions that rise with arrival.

    Deletes before the first upsert find no row and leave none.
    """
    upsert = F.col("op") != "d"
    first = F.min(F.when(upsert, F.col("lsn")))
    out = events.groupBy(key).agg(
        F.max_by(F.struct(*values), F.when(upsert, F.col("lsn"))).alias("v"), F.max_by("op", "lsn").alias("o"), F.max("lsn").alias("m"), first.alias("f")
    )
    out = out.filter(F.col("f").isNotNull())
    return out.select(key, *[F.col(f"v.{v}").alias(v) for v in values], (F.col("o") == "d").alias("deleted"), F.col("m").alias("source_lsn"))


def accepted(rows: DataFrame, key: str, span: int | None = SPAN) -> DataFrame:
    """Of rows (key, arrival, op, lsn, ...) those that the guard lets through, in order of arrival.

    A key's row exists from its first change that is no delete. A span of None sorts each key in one place, for
    batches that are known to be small.
    """
    upsert = (F.col("op") != "d").cast("int")
    if span is None:
        by = Window.partitionBy(key).orderBy("arrival", "lsn", "op")
    else:  # in one column, so that rows without a key meet their segment's state too
        rows = rows.withColumn("_own", F.struct(key, F.floor(F.col("arrival") / span).alias("segment")))
        by = Window.partitionBy("_own").orderBy("arrival", "lsn", "op")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_there", F.max(upsert).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    counted = F.when(F.col("_there") == 1, F.col("lsn"))
    seen = seen.withColumn("_top", F.max(counted).over(before)).withColumn("_all", F.max("lsn").over(before))
    if span is None:
        return seen.filter("_there = 1 and (_top is null or lsn > _top)").drop("_there", "_top", "_all")
    # a segment's state: whether it has an upsert, the highest position since, and the highest of all
    states = seen.groupBy("_own").agg(F.max("_there").alias("there"), F.max(counted).alias("top"), F.max("lsn").alias("all"))
    earlier = Window.partitionBy(f"_own.{key}").orderBy("_own.segment").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("was", F.coalesce(F.max("there").over(earlier), F.lit(0)))
    carried = F.max(F.when(F.col("was") == 1, F.col("all")).otherwise(F.col("top"))).over(earlier)
    states = states.select("_own", "was", carried.alias("carried"))
    both = seen.join(states, "_own")
    top = F.when(F.col("was") == 1, F.greatest("carried", "_all")).otherwise(F.col("_top"))
    both = both.filter(F.greatest("was", "_there") == 1).withColumn("_top", top)
    return both.filter("_top is null or lsn > _top").drop("_own", "_there", "_top", "_all", "was", "carried")


def guarded(events: DataFrame, key: str, values: list[str], stored: DataFrame | None = None, span: int | None = SPAN) -> DataFrame:
    """Guarded state for any order of arrival, on top of stored rows (key, values, deleted, source_lsn)."""
    rows = events.select(key, F.col("arrival").cast("bigint").alias("arrival"), "op", "lsn", *values)
    if stored is not None:
        old = stored.select(key, F.lit(-1).cast("bigint").alias("arrival"), F.when(F.col("deleted"), "D").otherwise("c").alias("op"), F.col("source_lsn").alias("lsn"), *values)
        rows = old.unionByName(rows)
    last = F.struct("arrival", "lsn")
    out = accepted(rows, key, span).groupBy(key).agg(
        F.max_by(F.struct(*values), F.when(F.col("op") != "d", last)).alias("v"), F.max_by("op", last).alias("o"), F.max("lsn").alias("source_lsn")
    )
    return out.select(key, *[F.col(f"v.{v}").alias(v) for v in values], F.col("o").isin("d", "D").alias("deleted"), "source_lsn")


def applied(events: DataFrame, key: str, stored: DataFrame | None = None, span: int | None = SPAN) -> DataFrame:
    """The events that the guard lets through."""
    rows = events.select(key, F.col("arrival").cast("bigint").alias("arrival"), "op", "lsn")
    if stored is not None:
        rows = stored.select(key, F.lit(-1).cast("bigint").alias("arrival"), F.lit("c").alias("op"), F.col("source_lsn").alias("lsn")).unionByName(rows)
    return accepted(rows, key, span).filter("arrival >= 0").select(key, "arrival", "op", "lsn")


def bulk_upsert(target: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Target with rows of the same key replaced."""
    return target.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def bulk_delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Target without those keys."""
    return target.join(keys.select(key).distinct(), key, "left_anti")


def bulk_soft_delete(target: DataFrame, keys: DataFrame, key: str, seq: int) -> DataFrame:
    """Target with those keys marked deleted at a batch's position."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    hit = F.col("_gone").isNotNull()
    out = target.join(gone, target[key] == gone["_gone"], "left")
    out = out.withColumn("deleted", hit | F.col("deleted")).withColumn("source_seq", F.when(hit, F.lit(seq).cast("bigint")).otherwise(F.col("source_seq")))
    return out.drop("_gone")


def insert_if_absent(target: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Target and the fresh rows whose key it does not have."""
    return target.unionByName(fresh.join(target.select(key), key, "left_anti"))


def advanced(stored: int | None, position: int) -> int:
    """A checkpoint only moves forward."""
    return position if stored is None else max(stored, position)
